"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document. The ledger keeps the measurements
and one bit a failed rule; policies, which are versioned sets of rules, and
ablations then need the bits alone.

Defined results: a null or empty text has no words and so fails ``few_words``.
Each row has its own ledger line, repeated or not; an empty table gives none.
A measure at a rule's bound (ties) passes. Very long texts are measured whole,
in blocks of their own. Other columns are not read, so their names can't clash.
Windows and lines are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .stash import Stash

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_letters", "n_capitals")

#: Name and failing condition of each rule; its place is its bit. Rules are only ever added at the end.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("bangs", "5 * n_bangs > n_words"),
    ("capitals", "n_letters >= 100 and 2 * n_capitals > n_letters"),
    ("dup_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars > 25 * n_words or word_chars < 2 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeats"]
#: Policies by version; a document fails one if it fails any of its rules.
POLICIES = {
    "base": BASE,
    "v1": sum(BIT.values()),
    "v1-no-format": sum(BIT.values()) & ~(BIT["symbols"] | BIT["bangs"] | BIT["capitals"]),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_LINE = np.ones(256, bool)
_LINE[10] = False
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL | np.roll(_CAPITAL, 32)


def _repeat_words(words: tv.Words) -> np.ndarray:
    """Words by row that lie in windows found twice or more in the row."""
    rows, at, h = tv.windows(words, WINDOW)
    order = np.lexsort((h, rows))
    same = np.zeros(len(h) + 1, bool)
    if len(h):
        same[1:-1] = (h[order][1:] == h[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = at[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(words.hashes) + WINDOW + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return tv.row_sums((np.cumsum(cover)[: len(words.hashes)] > 0).astype(np.int64), words.first)


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, by row: all, and those equal to an earlier one."""
    lines = tv.Words(data, offsets, kind=_LINE)
    some = np.zeros(len(data) + 1, np.int64)
    np.cumsum(tv.WORD[data], out=some[1:])
    use = some[lines.ends] > some[lines.starts]
    rows, h = lines.rows()[use], lines.hashes[use]
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    n = len(offsets) - 1
    return np.bincount(rows, minlength=n), np.bincount(rows[again], minlength=n)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of a block of texts, by row."""
    words = tv.Words(data, offsets)
    n_lines, n_dup = _dup_lines(data, offsets)
    count = lambda mask: tv.row_sums(mask.astype(np.int64), offsets)
    return {
        "n_words": words.counts, "word_chars": count(_HEAD[data] & tv.WORD[data]), "n_symbols": count(_SYMBOL[data]),
        "n_dup_lines": n_dup, "n_repeat_words": _repeat_words(words), "n_lines": n_lines, "n_bangs": count(data == 33),
        "n_letters": count(_LETTER[data]), "n_capitals": count(_CAPITAL[data]),
    }


def _measured(batches):
    for batch in batches:
        parts = [measure(data, offsets) for _, data, offsets in tv.blocks(batch.column("text"))]
        columns = [pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *MEASURES])


def ledger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, the measurements, failed): ``failed`` has the bit of every rule that fails."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    measured = plain.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"if({rule}, {1 << k}L, 0L)" for k, (_, rule) in enumerate(RULES))
    return measured.withColumn("failed", F.expr(bits))


def stored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The ledger, written: policies and ablations read it, and no text again."""
    return Stash(docs.sparkSession, "rules").keep(ledger(docs, text, doc_id), "ledger")


def passes(policy: str = "v1") -> F.Column:
    """Whether a ledger line passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(lines: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, n_failed, n_only): what each rule of a policy rejects, and what it alone rejects."""
    mask = POLICIES[policy]
    patterns = lines.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    used = [(name, bit) for name, bit in BIT.items() if bit & mask]
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in used])).alias("r")
    each = patterns.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
