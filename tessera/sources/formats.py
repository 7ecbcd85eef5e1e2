"""Formats of load and save statements."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..registry import OPERATORS
from ..streaming.versioned import VersionedTable
from . import annotations, blocks, excel, hbase, sas

#: Formats of connectors that a cluster may have on its class path, and the options that address a table.
EXTERNAL = {"doris": "doris.table.identifier", "hive": None, "es": "es.resource", "mongo": "collection", "kafka": "subscribe"}


def load(ctx, fmt: str, path: str, options: dict[str, str]) -> DataFrame:
    spark = ctx.spark
    kind = fmt.lower()
    if kind == "jsonstr":
        return _json_lines(spark, ctx.variables.get(path, path))
    if kind == "csvstr":
        return spark.read.options(**options).csv(spark.sparkContext.parallelize(ctx.variables.get(path, path).strip().splitlines()))
    if kind in ("excel", "com.crealytics.spark.excel"):
        excel.register(spark)
        return spark.read.format("excel").options(**options).load(path)
    if kind == "sas":
        sas.register(spark)
        return spark.read.format("sas").options(**options).load(path)
    if kind == "xml":
        return spark.read.format("xml").options(**options).load(path)
    if kind == "xtreme1":
        return annotations.load(spark, path, options.get("imagePath"))
    if kind in ("model", "model2"):
        return blocks.load_folder(spark, path, int(options.get("blockSize", blocks.BLOCK_BYTES)))
    if kind == "delta":
        version = options.get("versionAsOf")
        return VersionedTable(spark, path).read(int(version) if version is not None else None)
    if kind in ("hbase", "hbase2x"):
        return hbase.read(spark, _client(ctx, options), path, options)
    if kind == "modelexplain" and options.get("alg"):
        return _explain_model(ctx, path, options)
    if kind in ("modelparams", "modelexample", "modelexplain"):
        return _explain(ctx, kind, path)
    if kind == "jdbc":
        return spark.read.format("jdbc").options(**options).option("dbtable", options.get("dbtable", path)).load()
    if kind == "hive":
        return spark.table(path)
    if kind in EXTERNAL:
        return _external(spark.read.format(kind).options(**{**options, EXTERNAL[kind]: path}), kind)
    if kind == "csv":
        options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", **options}
    return spark.read.format(fmt).options(**options).load(path)


def save(ctx, df: DataFrame, fmt: str, path: str, mode: str, options: dict[str, str], partition_by: list[str]):
    kind = fmt.lower()
    if df.isStreaming:
        return _start(df, kind, path, mode, options)
    if kind in ("excel", "com.crealytics.spark.excel"):
        excel.register(ctx.spark)
        return df.coalesce(1).write.format("excel").mode("overwrite" if mode == "overwrite" else "append").options(**options).save(path)
    if kind == "sas":
        raise ValueError("sas tables can only be read")
    if kind in ("model", "model2"):
        return blocks.save_folder(df, path)
    if kind == "delta":
        table = VersionedTable(ctx.spark, path)
        if mode == "errorifexists" and table.exists():
            raise FileExistsError(path)
        return None if mode == "ignore" and table.exists() else table.write(df, "append" if mode == "append" else "overwrite")
    if kind == "image":
        return _images(df, path, options)
    if kind in ("hbase", "hbase2x"):
        return hbase.write(df, lambda: _client(ctx, options), path, options)
    if kind == "rest":
        from .http import upload

        return upload(df, path)
    writer = df.write.mode(mode).options(**options)
    if partition_by or options.get("partitionByCol"):
        writer = writer.partitionBy(*(partition_by or options["partitionByCol"].split(",")))
    if kind == "jdbc":
        return writer.format("jdbc").option("dbtable", options.get("dbtable", path)).save()
    if kind == "hive":
        return writer.saveAsTable(path)
    if kind in EXTERNAL:
        return _external(writer.format(kind).option(EXTERNAL[kind], path), kind, save=True)
    return writer.format(fmt).save(path)


def _json_lines(spark, text: str) -> DataFrame:
    """JSON lines held in a variable."""
    lines = [(x,) for x in text.strip().splitlines() if x.strip()]
    raw = spark.createDataFrame(lines, "value string")
    return spark.read.json(raw.rdd.map(lambda r: r[0]))


def _external(handle, kind: str, save: bool = False):
    try:
        return handle.save() if save else handle.load()
    except Exception as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error) or "ClassNotFound" in str(error):
            raise RuntimeError(f"the {kind} connector is not on Spark's class path") from error
        raise


def _client(ctx, options: dict[str, str]):
    client = ctx.functions.get("hbase.client")
    if client is None:
        raise RuntimeError("no HBase client is set; give the context one as functions['hbase.client']")
    return client


def _explain(ctx, kind: str, name: str) -> DataFrame:
    """Parameters, an example or the description of an operator."""
    op = OPERATORS.get(name)
    if op is None:
        raise ValueError(f"unknown operator: {name}")
    if kind == "modelparams":
        rows = [(p.name, p.doc, "" if p.default is None else p.default, json.dumps(list(p.options))) for p in op.params]
        return ctx.spark.createDataFrame(rows, "param string, description string, value string, options string")
    text = op.doc if kind == "modelexplain" else f"run table as {name}.`` where " + " and ".join(f'{p.name}="{p.default or ""}"' for p in op.params) + " as output;"
    return ctx.spark.createDataFrame([(name, text)], "name string, value string")


def _explain_model(ctx, path: str, options: dict[str, str]) -> DataFrame:
    """(name, value) of a trained model: the one of ``algIndex``, or the best."""
    from pyspark.ml.util import DefaultParamsReader

    from ..ml import training

    alg = options["alg"]
    if alg not in OPERATORS or OPERATORS[alg].predict is None:
        raise ValueError(f"{alg} trains no models")
    index = int(options["algIndex"]) if "algIndex" in options else None
    row = training.best_model(ctx.spark, path, index, "rmse" if alg.endswith("Regressor") else "f1")
    rows = training.explain(DefaultParamsReader.loadParamsInstance(row["modelPath"], ctx.spark))
    return ctx.spark.createDataFrame(rows, "name string, value string")


def _images(df: DataFrame, path: str, options: dict[str, str]) -> None:
    """One file for each row, from a binary column and a name column, into a folder that all executors share.

    The folder may be an address of an object store or HDFS; a path without a
    scheme is on the executors' own disks, so only a local session takes it.
    """
    content, name = options.get("imageColumn", "content"), options.get("fileName", "name")
    if "://" not in path and not df.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"images need a folder with a scheme that all executors share, not {path}")
    jvm_free = df.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content"))

    def write(rows):
        import os

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        store.create_dir(root, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{root.rstrip('/')}/{os.path.basename(row['name'])}") as out:
                out.write(row["content"])

    jvm_free.foreachPartition(write)


def _start(df: DataFrame, kind: str, path: str, mode: str, options: dict[str, str]):
    """A streaming query for a sink."""
    options = dict(options)
    trigger = options.pop("duration", None)
    checkpoint = options.pop("checkpointLocation", None)
    writer = df.writeStream.outputMode({"overwrite": "complete", "append": "append"}.get(mode, "append")).options(**options)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{trigger} seconds") if trigger and trigger != "once" else writer.trigger(availableNow=True)
    if kind in ("custom", "rate"):
        from ..streaming.cdc import apply_batch, parse_events

        keys = [k for k in options.get("idCols", "").split(",") if k]
        table, name = path, options.get("dbTable")

        def merge(batch: DataFrame, _: int) -> None:
            apply_batch(VersionedTable(batch.sparkSession, table), parse_events(batch, name), keys)

        return writer.foreachBatch(merge).start()
    return writer.format(kind).start(path) if path else writer.format(kind).start()
