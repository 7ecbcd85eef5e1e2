"""A corpus from documents, in five stages; each is written and read again.

1. ``quality_classifier``: documents that the line field predicts bad go.
2. ``line_dedup``: lines that five documents or more hold stay in one of them.
   A document that loses lines and keeps no word goes; ``n_chars`` follows.
3. ``ngram_jaccard_join``: of each class of near copies one document stays,
   that of the smallest doc_id. Repeated rows of one document give one.
4. ``benchmark_decontamination``: documents with a benchmark window go.
5. ``source_mixing``: the words that the mix takes of each document.

Nulls: a null text counts as empty and has the quality score of one; in stage 3
a row without doc_id stands under a number made from its text, and a text
without words is no copy of another. Very long texts go through all stages
whole. Ties: of rows of one doc_id in a class, that of the smallest hash of the
text stays. Repeated rows are each scored, deduplicated and scanned; stage 3
keeps one of them. Rows of one doc_id with unlike texts are documents of their
own in every stage. Empty tables give no row in any stage. All stages but the
last return the columns they are given, with any other columns that a table
has, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, line_dedup, mixing, ngram_join, quality_crf
from tessera.llm.stash import Stash, free_name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines = free_name(docs, "lines")
    out = line_dedup.dedup_lines(docs, counts=lines)
    lost = F.col(lines)["n_dropped"] > 0
    left = out.where(~(lost & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(lost, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stash = Stash(spark, "near")
    id_, key = free_name(docs, "id"), free_name(docs, "key")
    number = F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.xxhash64("text") % (1 << 62)) - 1)
    named = docs.withColumns({id_: number, key: F.xxhash64(F.col("text").cast("string"))})
    classes = stash.keep(ngram_join.shingle_classes(named.select(id_, "text"), doc_id=id_, keyed=True), "classes")
    row = F.struct("doc_id", "key").alias("row")
    of_class = classes.where("n_shingles > 0").groupBy("root").agg(F.min(row).alias("row")).select("row.*")
    stay = of_class.unionByName(classes.where("n_shingles = 0").select("doc_id", "key").distinct())
    out = named.join(stay.select(F.col("doc_id").alias(id_), F.col("key").alias(key)), [id_, key], "left_semi")
    if classes.groupBy("doc_id", "key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_, key])
    return out.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
]

#: The first stage has no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    stash = Stash(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
    return docs
