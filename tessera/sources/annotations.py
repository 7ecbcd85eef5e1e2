"""Annotation datasets: a JSON document of images and their labels, as tables and as COCO.

The document's ``contents`` hold a name and ``data``: the image's URL and
``result.objects``, each with a class and ``coordinate``, its points. Field names
are those of the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: What is read of one content; fixed names of the format.
CONTENT = "struct<name:string, data:struct<image:string, result:struct<objects:array<struct<classType:string, coordinate:array<struct<x:double, y:double>>>>>>>"


def file_name(url: Column) -> Column:
    """The last part of a URL's path, without its query."""
    return F.element_at(F.split(F.element_at(F.split(url, r"\?"), 1), "/"), -1)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, meta): the document's contents in order, each by its image's file name."""
    text = spark.read.text(path, wholetext=True)
    raw = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.contents"), "array<string>")).alias("position", "meta"))
    return raw.select("position", file_name(F.get_json_object("meta", "$.data.image")).alias("name"), "meta")


def load(spark: SparkSession, path: str, image_path: str | None = None) -> DataFrame:
    """(name, meta, data): one row a content of the document, its JSON, and the image's bytes if a file has its name."""
    rows = contents(spark, path).select("name", "meta")
    if image_path is None:
        return rows.withColumn("data", F.lit(None).cast("binary"))
    files = spark.read.format("binaryFile").load(image_path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))
    return rows.join(files, "name", "left")


def to_coco(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables ``images``, ``categories`` and ``annotations`` of (position, meta).

    An image's id is its position in the document; the classes in order are the
    categories. Annotations are numbered by image and place.
    """
    parsed = rows.select(F.col("position").cast("long").alias("image_id"), F.from_json("meta", CONTENT).alias("c"))
    images = parsed.select(F.col("image_id").alias("id"), file_name(F.col("c.data.image")).alias("file_name"), F.col("c.data.image").alias("coco_url"))
    objects = parsed.select("image_id", F.posexplode("c.data.result.objects").alias("place", "o"))
    # One row a class is left, so one task numbers them.
    categories = objects.select(F.col("o.classType").alias("name")).where("name is not null").distinct().select((F.row_number().over(W.orderBy("name")) - 1).alias("id"), "name")
    sizes = objects.groupBy("image_id").agg(F.count("*").alias("n"))
    before = sizes.select("image_id", (F.sum("n").over(W.orderBy("image_id")) - F.col("n")).alias("before"))  # one row an image of one document
    flat = F.flatten(F.transform("o.coordinate", lambda p: F.array(p["x"], p["y"])))
    annotations = objects.join(before, "image_id").join(categories.withColumnsRenamed({"id": "category_id", "name": "class"}), F.col("o.classType") == F.col("class"), "left").select(
        (F.col("before") + F.col("place")).alias("id"), "image_id", "category_id", F.array(flat).alias("segmentation"), F.lit(0.0).alias("area"), F.lit(0).alias("iscrowd"))
    return {"images": images, "categories": categories, "annotations": annotations}
