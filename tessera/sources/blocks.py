"""Folders as tables of tar blocks, and back."""

from __future__ import annotations

import io
import os
import tarfile

from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 64 * 1024
SCHEMA = "start long, offset long, value binary"


def _keep(info: tarfile.TarInfo) -> tarfile.TarInfo | None:
    return None if ".git" in info.name.split("/") else info


def load_folder(spark: SparkSession, path: str, block: int = BLOCK_BYTES) -> DataFrame:
    """(start, offset, value) of the folder's tar stream, ``.git`` aside.

    The folder is local to the driver; blocks go out batch by batch.
    """
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        tar.add(path, arcname=os.path.basename(os.path.normpath(path)), filter=_keep)
    data = buffer.getvalue()
    rows = [(at, len(data[at : at + block]), data[at : at + block]) for at in range(0, len(data), block)]
    return spark.createDataFrame(rows, SCHEMA)


def save_folder(df: DataFrame, path: str) -> None:
    """Unpack blocks, in order of their start, into a folder; blocks come to the driver one partition at a time."""
    os.makedirs(path, exist_ok=True)
    ordered = df.select("start", "value").repartitionByRange("start").sortWithinPartitions("start")

    class Stream(io.RawIOBase):
        def __init__(self):
            self.rows, self.left = ordered.toLocalIterator(), b""

        def readable(self):
            return True

        def readinto(self, target):
            while not self.left:
                row = next(self.rows, None)
                if row is None:
                    return 0
                self.left = bytes(row["value"])
            n = min(len(target), len(self.left))
            target[:n], self.left = self.left[:n], self.left[n:]
            return n

    with tarfile.open(fileobj=io.BufferedReader(Stream()), mode="r|") as tar:
        tar.extractall(path, filter="data")
