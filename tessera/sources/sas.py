"""SAS tables as a Spark data source; reading only."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

CHUNK = 50_000


def _frames(path: str, kind: str | None):
    import pandas as pd

    return pd.read_sas(path.removeprefix("file:"), format=kind, chunksize=CHUNK, encoding="utf-8")


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        for frame in _frames(self.options["path"], self.options.get("format")):
            yield from pa.Table.from_pandas(frame[self.schema.names], schema=arrow, preserve_index=False).to_batches()


class SasSource(DataSource):
    """``spark.read.format("sas")`` after ``register``."""

    @classmethod
    def name(cls):
        return "sas"

    def schema(self):
        import pandas as pd

        frame = next(iter(_frames(self.options["path"], self.options.get("format"))))
        kind = lambda c: T.TimestampNTZType() if pd.api.types.is_datetime64_any_dtype(frame[c]) else T.DoubleType() if pd.api.types.is_numeric_dtype(frame[c]) else T.StringType()
        return T.StructType([T.StructField(str(c), kind(c), True) for c in frame.columns])

    def reader(self, schema):
        return _Reader(schema, dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(SasSource)
