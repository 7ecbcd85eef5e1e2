"""Files through Hadoop's file system: listings, status, copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LISTING = "name string, path string, owner string, group string, permission string, isDir boolean, byteLength string, modificationTime string"


class PathRefused(ValueError):
    """A path that may not be used here."""


def _open(spark: SparkSession, path: str):
    if path.lower().startswith(("http://", "https://")):
        raise PathRefused(f"web addresses are not file systems: {path}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _row(status, size: int | None = None) -> tuple:
    return (
        status.getPath().getName(), status.getPath().toString(), status.getOwner(), status.getGroup(), status.getPermission().toString(),
        status.isDirectory(), str(status.getLen() if size is None else size), str(status.getModificationTime()),
    )


def listing(spark: SparkSession, path: str, count: bool = False, maximum: int | None = None) -> DataFrame:
    """Entries of a folder; ``count`` sums what folders hold, ``maximum`` limits how many entries may be there."""
    fs, where = _open(spark, path)
    found = list(fs.listStatus(where))
    if maximum is not None and len(found) > maximum:
        raise PathRefused(f"{path} has {len(found)} entries; at most {maximum} are listed")
    rows = [_row(s, fs.getContentSummary(s.getPath()).getLength() if count and s.isDirectory() else None) for s in found]
    return spark.createDataFrame(rows, LISTING)


def status(spark: SparkSession, path: str) -> DataFrame:
    fs, where = _open(spark, path)
    return spark.createDataFrame([_row(fs.getFileStatus(where))], LISTING)


def exists(spark: SparkSession, path: str) -> DataFrame:
    fs, where = _open(spark, path)
    return spark.createDataFrame([(str(fs.exists(where)).lower(),)], "isExists string")


def copy_from_local(spark: SparkSession, source: str, target: str) -> DataFrame:
    fs, where = _open(spark, target)
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{source}" if source.startswith("/") else source), where)
    return status(spark, target)


#: File system classes by kind of object store; fixed names of Hadoop modules.
OBJECT_STORES = {
    "s3": "org.apache.hadoop.fs.s3a.S3AFileSystem", "oss": "org.apache.hadoop.fs.aliyun.oss.AliyunOSSFileSystem", "cos": "org.apache.hadoop.fs.CosFileSystem",
    "obs": "org.apache.hadoop.fs.obs.OBSFileSystem", "blob": "org.apache.hadoop.fs.azure.NativeAzureFileSystem",
}


def has_object_store(spark: SparkSession, kind: str) -> bool:
    """Whether the class of an object store can be loaded."""
    try:
        spark._jvm.java.lang.Class.forName(OBJECT_STORES[kind])
        return True
    except KeyError:
        raise ValueError(f"unknown object store: {kind}") from None
    except Exception:
        return False


def configure_object_store(spark: SparkSession, options: dict[str, str]) -> None:
    """Hadoop settings of a store for this session."""
    conf = spark._jsc.hadoopConfiguration()
    for key, value in options.items():
        if key == "fs.defaultFS":
            raise PathRefused("fs.defaultFS may not be changed")
        conf.set(key, value)
