"""Written tables that cut lineage, kept in the folder the cluster shares.

The folder is the one Spark was given in ``spark.checkpoint.dir``. A folder of
our own is set only where that setting is missing, as in local tests. Results
may read their tables as long as the driver runs; ``clear`` and the driver's
end delete them.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, as a path every executor can reach."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def free_name(df: DataFrame, label: str) -> str:
    """A column name like ``label`` that no column of ``df`` has, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{label}"
    while name.lower() in taken:
        name += "_"
    return name


_stashes: list[Stash] = []


@atexit.register
def clear() -> None:
    """Delete all tables; results that still read them can't be computed again."""
    while _stashes:
        with contextlib.suppress(Exception):  # the session may have ended before
            _stashes.pop().drop("")


class Stash:
    """A set of intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
        _stashes.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it again with the same schema."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables once nothing lazy reads them any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
