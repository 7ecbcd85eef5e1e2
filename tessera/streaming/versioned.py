"""Versioned tables: immutable Parquet parts under manifests.

A table is a folder with ``v<N>.json`` manifests and part folders. A write adds
parts and then one manifest, so a reader sees a whole version or none. All
paths go through Hadoop's file system, which every executor shares.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def exists(self) -> bool:
        return bool(self.versions())

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.path}")
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"version {version} is not there")
        source = self._fs.open(self._at(f"v{version}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def _commit(self, parts: list[str], schema: T.StructType, operation: str) -> int:
        version = (self.versions() or [-1])[-1] + 1
        body = json.dumps({"version": version, "parts": parts, "schema": schema.jsonValue(), "operation": operation, "time": time.time()})
        # Creation fails if another writer made this version first.
        out = self._fs.create(self._at(f"v{version}.json"), False)
        out.write(bytearray(body.encode()))
        out.close()
        return version

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(self._manifest(version)["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        own = self._manifest(version)
        schema = T.StructType.fromJson(own["schema"])
        if not own["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in own["parts"]])

    def write(self, df: DataFrame, mode: str = "overwrite", operation: str | None = None) -> int:
        part = f"part-{uuid.uuid4().hex}"
        old: list[str] = []
        if mode == "append" and self.exists():
            old = self._manifest()["parts"]
            df = df.select(*self.schema().names)
        elif mode not in ("append", "overwrite"):
            raise ValueError(f"mode is 'append' or 'overwrite', not {mode!r}")
        df.write.parquet(f"{self.path}/{part}")
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        return self._commit([*old, part], schema, operation or mode)

    def desc(self) -> DataFrame:
        """(name, type, meta) of each column."""
        rows = [(f.name, f.dataType.simpleString(), json.dumps(f.metadata)) for f in self.schema().fields]
        return self.spark.createDataFrame(rows, "name string, type string, meta string")

    def truncate(self) -> int:
        return self._commit([], self.schema(), "truncate")

    def delete(self, condition: str) -> int:
        """Rows for which the condition is true go; the others are written as a new part."""
        return self.write(self.read().where(~F.coalesce(F.expr(condition), F.lit(False))), "overwrite", "delete")

    def vacuum(self, hours: float = 168.0) -> list[str]:
        """Manifests older than that go, but the last; so do parts that no manifest left names."""
        limit, known = time.time() - hours * 3600, self.versions()
        gone = [v for v in known[:-1] if self._manifest(v)["time"] < limit]
        used = {p for v in known if v not in gone for p in self._manifest(v)["parts"]}
        removed = []
        for status in self._fs.listStatus(self._root):
            name = status.getPath().getName()
            old = name.startswith("part-") and name not in used and status.getModificationTime() / 1000 < limit
            if old or name in {f"v{v}.json" for v in gone}:
                self._fs.delete(status.getPath(), True)
                removed.append(name)
        return removed

    def remove(self) -> None:
        self._fs.delete(self._root, True)


def save_then_load(df: DataFrame, path: str) -> DataFrame:
    """A written copy of a frame, which cuts its lineage."""
    table = VersionedTable(df.sparkSession, path)
    table.write(df, "overwrite")
    return table.read()
