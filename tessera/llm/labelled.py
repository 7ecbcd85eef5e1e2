"""Labelled texts for fitting, and the folds that keep others out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows up to which a classifier is fitted; of more, those of the smallest hash.
MAX_ROWS = 6000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row's label may not be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def sample_frame(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int = MAX_ROWS) -> DataFrame:
    """At most ``rows`` rows (doc_id, text, label) to learn from; the rest of the work sees all rows.

    Rows without a label, a doc_id or a text are left out here alone.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .select("doc_id", F.col(label).cast("int").alias("label")).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    )
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id")
