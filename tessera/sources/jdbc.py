"""Named JDBC connections: statements on the driver, queries as tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows fetched at once, by database; MySQL streams.
FETCH_SIZES = {"postgresql": "10000", "mysql": "-2147483648"}


class Connections:
    """Connections by name, with the options that JDBC takes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.known: dict[str, dict[str, str]] = {}

    def add(self, name: str, options: dict[str, str]) -> None:
        if "url" not in options:
            raise ValueError("a connection needs a url")
        self.known[name] = options

    def remove(self, name: str) -> bool:
        return self.known.pop(name, None) is not None

    def _options(self, name: str) -> dict[str, str]:
        if name not in self.known:
            raise ValueError(f"no connection {name}")
        return self.known[name]

    def _connect(self, name: str):
        own = self._options(name)
        jvm = self.spark._jvm
        if own.get("driver"):
            jvm.java.lang.Class.forName(own["driver"])
        properties = jvm.java.util.Properties()
        for key, value in own.items():
            if key not in ("url", "driver"):
                properties.setProperty(key, value)
        return jvm.java.sql.DriverManager.getConnection(own["url"], properties)

    def is_valid(self, name: str, seconds: int = 5) -> bool:
        try:
            connection = self._connect(name)
            try:
                return connection.isValid(seconds)
            finally:
                connection.close()
        except Exception:
            return False

    def execute(self, name: str, sql: str) -> int:
        """A statement without a result, committed by itself; rows it changed."""
        connection = self._connect(name)
        try:
            statement = connection.createStatement()
            try:
                return statement.getUpdateCount() if not statement.execute(sql) else -1
            finally:
                statement.close()
        finally:
            connection.close()

    def query(self, name: str, sql: str, cache: str | None = None, split: tuple[str, int] | None = None) -> DataFrame:
        """A query as a table; with a cache folder it is read once and kept as Parquet.

        ``split`` names a numeric or date column of the result and a number of
        tasks: the column's least and largest values are asked for first, and
        each task reads its share of the range. Rows without a value are in one.
        """
        own, sql = self._options(name), sql.strip().rstrip(";")
        database = own["url"].split(":")[1] if own["url"].count(":") else ""
        reader = self.spark.read.format("jdbc").options(**own)
        bounds = None
        if split is not None and split[1] > 1:
            bounds = reader.option("query", f"select min({split[0]}) as low, max({split[0]}) as high from ({sql}) q").load().first()
        if bounds is not None and bounds[0] is not None:
            reader = self.spark.read.format("jdbc").options(**own).option("dbtable", f"({sql}) q").options(
                partitionColumn=split[0], lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(split[1]))
        else:
            reader = self.spark.read.format("jdbc").options(**own).option("query", sql)
        if database in FETCH_SIZES:
            reader = reader.option("fetchsize", FETCH_SIZES[database])
        df = reader.load()
        if cache is None:
            return df
        path = f"{cache.rstrip('/')}/{uuid.uuid4().hex}"
        df.write.option("compression", "snappy").parquet(path)
        return self.spark.read.parquet(path)

    def query_json(self, name: str, sql: str) -> DataFrame:
        """A query's rows as JSON texts, inferred again as a table."""
        return self.spark.read.json(self.query(name, sql).toJSON())

    def run_ordered(self, name: str, statements: dict[str, str]) -> DataFrame | None:
        """``sql-1``, ``sql-2``, ... in order; the last one's result, if it has one."""
        ordered = [statements[k] for k in sorted((k for k in statements if k.startswith("sql-")), key=lambda k: int(k[4:]))]
        for sql in ordered[:-1]:
            self.execute(name, sql)
        if not ordered:
            return None
        if ordered[-1].lstrip().lower().startswith(("select", "with", "values")):
            return self.query(name, ordered[-1])
        self.execute(name, ordered[-1])
        return None


def cleanup(spark: SparkSession, folder: str, days: float = 2.0) -> list[str]:
    """Remove entries of a cache folder, on whatever file system, that are older than that."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    limit = (time.time() - days * 86400) * 1000
    old = [s.getPath() for s in files.listStatus(where) if s.getModificationTime() < limit]
    return sorted(p.getName() for p in old if files.delete(p, True))
