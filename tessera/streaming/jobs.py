"""Stored jobs and connections: small JSON registries on a shared file system."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Names with JSON values, one file each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name.encode().hex()}.json")

    def put(self, name: str, value) -> None:
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(json.dumps({"name": name, "value": value}).encode()))
        out.close()

    def remove(self, name: str) -> bool:
        return self._fs.delete(self._at(name), False)

    def items(self) -> dict:
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        if not self._fs.exists(root):
            return {}
        found = {}
        for status in self._fs.listStatus(root):
            source = self._fs.open(status.getPath())
            entry = json.loads(bytes(source.readAllBytes()).decode())
            source.close()
            found[entry["name"]] = entry["value"]
        return dict(sorted(found.items()))


class StreamJobs:
    """Scripts of streams that start again with the engine."""

    def __init__(self, registry: Registry, run: Callable[[str], object]):
        self.registry, self.run = registry, run

    def persist(self, name: str, script: str) -> None:
        self.registry.put(name, script)

    def remove(self, name: str) -> None:
        self.registry.remove(name)

    def list(self) -> DataFrame:
        rows = list(self.registry.items().items())
        return self.registry.spark.createDataFrame(rows, "name string, script string")

    def start_all(self) -> dict[str, str]:
        """Run each script; a failure of one is its status and stops no other."""
        status = {}
        for name, script in self.registry.items().items():
            try:
                self.run(script)
                status[name] = "started"
            except Exception as error:
                status[name] = f"failed: {error}"
        return status
