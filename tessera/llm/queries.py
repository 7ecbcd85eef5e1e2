"""The dealt operators as queries over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, decontaminate, html_extract, line_dedup, mixing, ngram_join, quality_crf, quality_rules, secrets, toxicity
from .oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(escaped).alias("text"),
    )
    out = chat_format.format_chats(chat_format.table_events(rows.unionByName(fixed)))
    turns = chat_format.read_turns(F.col("formatted"))
    read = out.select("conv_id", turns.alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_classes(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", secrets.base_digest().alias("base_sha256"), "spans")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "__found.n_words", "__found.n_hit", F.size("__found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__found.items", ","), 256).alias("items_sha256"), (F.col("__found.n_hit") > 0).alias("contaminated"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = quality_rules.stored(table(spark, sf_dir, "documents"))
    return lines.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"),
    )


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, from the bits of the stored ledger."""
    return quality_rules.ablation(quality_rules.stored(table(spark, sf_dir, "documents")), "v1")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_chat_formatting, op3_mixing, op4_ngram_jaccard_join, op5_secret_scans, op6_html_extraction,
        op7_benchmark_decontamination, op8_quality_rules, quality_rules_ablation, op9_toxicity, op10_quality_classifier,
    )
}
