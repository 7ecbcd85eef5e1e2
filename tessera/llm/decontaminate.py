"""Benchmark decontamination by a broadcast hash set of the items' n-grams.

Words are runs of a-z, 0-9 and characters beyond ASCII, with A-Z in lower case.
An item's windows are its runs of ten words; an item of fewer words, but not
none, is one window. A document word inside any occurrence of a window is hit.

How it runs
-----------
1. The items' windows become one *index* row: a bit map of their hashes (16
   bits a window), the hashes in order with the item and place of each, and the
   items' words. The row is a scalar subquery of the scan, so every task holds
   it: about 30 bytes a window besides the items' own text.
2. A document's windows are hashed in place and tested against the bit map;
   what passes is looked up among the hashes and compared with the item word by
   word before it counts. There is no shuffle and no key of a document.
3. Items of more than ``BLOCK`` windows in all are dealt to several indexes,
   each scanned in a pass of its own whose hits are written before the next.
   Method and results are the same for any number of them.

All of it is DataFrame expressions.

Defined results: a null or empty text has no words and no hits; a null or
wordless item has no window. Repeated rows each have their result; a repeated
item gives its id once, and items of equal words each give theirs (ties). Very
long texts are scanned whole. Empty tables give no row, and with no items
nothing is hit. Other columns keep their names and values: columns of this
module have names that no column of the table has, but for the result
``__found``, which a caller may name.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .chat_format import let
from .stash import Stash, free_name

#: Between words.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Windows aimed at in one index, about 30 MB of a task.
BLOCK = 1_000_000

_HITS = "array<struct<start:int,n:int,items:array<string>>>"


def words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(folded, GAP), "")


def _hashes(listed: Column) -> Column:
    return F.transform(listed, lambda w: F.xxhash64(w))


def _window_hash(hashes: Column, start: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(hashes, start + k) for k in range(size)])


def _starts(listed: Column, size: int) -> Column:
    """Places where a window of ``size`` can start, from 0."""
    n = F.size(listed)
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, place, n, h) of each window of items(item, words)."""
    sized = items.select("item", "words", F.least(F.size("words"), F.lit(size)).alias("n"), _hashes(F.col("words")).alias("hashes"))
    each = sized.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))))
    h = F.coalesce(*[F.when(F.col("n") == k, _window_hash(F.col("hashes"), F.col("place"), k)) for k in range(1, size + 1)])
    return each.select("item", "place", "n", h.alias("h"))


def _bits_for(count: int) -> tuple[int, int]:
    """Powers of two of the longs of the bit map and of the buckets for so many windows."""
    power = max(1, math.ceil(math.log2(max(count, 2))))
    return max(1, power - 2), power


def _index(items: DataFrame, windows: DataFrame, count: int) -> DataFrame:
    """One row of arrays for windows of items(item, item_id, words); see the module.

    A hash's bucket is its first bits, so that the hashes in order lie by bucket;
    ``first`` and ``many`` say where a bucket starts and how many it has.
    """
    maps, buckets = _bits_for(count)
    bit = F.col("h").bitwiseAND(63).cast("int")
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit((1 << maps) - 1))
    bucket = F.shiftrightunsigned("h", 64 - buckets)
    of = lambda frame, n, *values: frame.sparkSession.range(1 << n).join(frame, "id", "left").agg(
        F.array_sort(F.collect_list(F.struct("id", *[F.coalesce(v, F.lit(0)).alias(v) for v in values]))).alias("a"))
    marks = of(windows.groupBy(word.alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")), maps, "bits")
    # By one task, as the windows of one index are of bounded number.
    order = W.orderBy(F.shiftrightunsigned("h", 1), "h", "item", "place")
    placed = windows.withColumn("at", (F.row_number().over(order) - 1)).withColumn("id", bucket)
    heads = of(placed.groupBy("id").agg(F.min("at").alias("first"), F.count("*").cast("int").alias("many")), buckets, "first", "many")
    entries = placed.agg(F.array_sort(F.collect_list(F.struct("at", "h", "item", "place", "n"))).alias("a"))
    listed = items.agg(F.array_sort(F.collect_list(F.struct("item", "item_id", "words"))).alias("a"))
    return marks.select(F.struct(
        F.col("a.bits").alias("bits"), heads.select(F.struct(F.col("a.first").alias("first"), F.col("a.many").alias("many"))).scalar().alias("heads"),
        entries.select(F.struct(F.col("a.h").alias("h"), F.col("a.item").alias("item"), F.col("a.place").alias("place"), F.col("a.n").alias("n"))).scalar().alias("entries"),
        listed.select(F.struct(F.col("a.item_id").alias("ids"), F.col("a.words").alias("words"))).scalar().alias("items"),
    ).alias("index"))


def _hits(listed: Column, index: Column, count: int, sizes: list[int]) -> Column:
    """Hits (start, n, items) of a document's words."""
    maps, buckets = _bits_for(count)

    def marked(h: Column, bits: Column) -> Column:
        long = F.get(bits, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << maps) - 1)).cast("int"))
        return F.call_function("shiftright", long, h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    def found(i: Column, n: int, h: Column, words: Column, of: Column) -> Column:
        """Ids of the items that have the document's words from i at the place of an entry."""
        heads, entries, items = of["heads"], of["entries"], of["items"]
        bucket = F.shiftrightunsigned(h, 64 - buckets).cast("int")
        first, many = F.get(heads["first"], bucket), F.get(heads["many"], bucket)
        own = F.when(many > 0, F.sequence(first, first + many - 1)).otherwise(F.array().cast("array<int>"))
        same = lambda e: (
            (F.get(entries["h"], e) == h) & (F.get(entries["n"], e) == n)
            & (F.slice(F.get(items["words"], F.get(entries["item"], e)), F.get(entries["place"], e) + 1, n) == F.slice(words, i + 1, n))
        )
        return F.array_distinct(F.transform(F.filter(own, same), lambda e: F.get(items["ids"], F.get(entries["item"], e))))

    def of_size(words: Column, hashes: Column, of: Column, n: int) -> Column:
        every = F.transform(_starts(words, n), lambda i: _window_hash(hashes, i, n))
        near = let(of["bits"], lambda bits: F.filter(F.transform(every, lambda h, i: F.when(marked(h, bits), F.struct(i.alias("i"), h.alias("h")))), lambda c: c.isNotNull()))
        return F.transform(near, lambda c: F.struct(c["i"].alias("start"), F.lit(n).alias("n"), found(c["i"], n, c["h"], words, of).alias("items")))

    hits = let(index, lambda of: let(_hashes(listed), lambda hashes: F.concat(*[of_size(listed, hashes, of, n) for n in sizes])))
    return F.filter(hits, lambda e: F.size(e["items"]) > 0)


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", size: int = WINDOW, found: str = "__found") -> DataFrame:
    """All columns of ``docs`` and ``found``: n_words, n_hit, items (sorted as strings), spans of hit words."""
    spark = docs.sparkSession
    stash = Stash(spark, "leaks")
    known = stash.keep(
        items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(item_text)).alias("words")).where(F.size("words") > 0).distinct()
        .withColumn("n_windows", F.greatest(F.size("words") - F.lit(size - 1), F.lit(1))),
        "items",
    )
    total, sizes = known.agg(F.coalesce(F.sum("n_windows"), F.lit(0)), F.sort_array(F.collect_set(F.least(F.size("words"), F.lit(size))))).first()
    blocks = max(1, math.ceil(total / BLOCK))
    held, hits = (free_name(docs, x) for x in ("index", "hits"))
    none = F.array().cast(_HITS)
    marked = docs if sizes else docs.withColumn(hits, F.struct(F.size(words(F.col(text))).alias("n"), none.alias("hits")))
    for block in range(blocks if sizes else 0):
        order = W.orderBy("item_id", "words")  # items of one index, of bounded number
        own = known.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).withColumn("item", F.row_number().over(order) - 1)
        windows = item_windows(own, size)
        count = total if blocks == 1 else own.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0]
        if not count:
            continue
        later = hits in marked.columns
        if later:
            marked = stash.keep(marked, f"hits-{block}")
        index = stash.keep(_index(own, windows, count), f"row-{block}")
        before = F.col(hits)["hits"] if later else none
        more = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), F.concat(before, _hits(w, F.col(held), count, sizes)).alias("hits")))  # noqa: B023
        marked = marked.withColumn(held, index.scalar()).withColumn(hits, more).drop(held)
    # One mention of the hits, so that a filter on the result does not look for them again. Sorted only where there is something to sort.
    ordered = lambda e: F.when(F.size(e["hits"]) > 0, F.array_sort(e["hits"])).otherwise(none)
    folded = let(F.col(hits), lambda e: let(ordered(e), lambda sorted_hits: _folded(e["n"], sorted_hits)))
    return marked.withColumn(found, folded).drop(hits)


def _folded(n_words: Column, hits: Column) -> Column:
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def cover(seen: Column, hit: Column) -> Column:
        end = hit["start"] + hit["n"]
        return F.struct(
            F.greatest(seen["end"], end).alias("end"),
            (seen["total"] + F.greatest(F.lit(0), end - F.greatest(seen["end"], hit["start"]))).cast("long").alias("total"),
        )

    return F.struct(
        n_words.cast("long").alias("n_words"),
        F.aggregate(hits, start, cover, lambda seen: seen["total"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"])))).alias("items"),
        F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["n"]).alias("end"))).alias("spans"),
    )


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without its hit words; what stands between words stays."""
    parts = F.regexp_extract_all(text, F.lit(f"{WORD}|{GAP}"), F.lit(0))
    first = F.when(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).rlike(f"^{WORD}"), 0).otherwise(1)
    hit = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1))))
    gone = lambda p, h, f: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.transform(h, lambda k: k * 2 + f))
    kept = let(parts, lambda p: F.array_join(F.transform(gone(p, hit, first), lambda k: F.get(p, k)), ""))
    return F.when(F.size(spans) == 0, text).otherwise(kept)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", remove: str = "documents", **names: str) -> DataFrame:
    """``docs`` without contaminated rows, or (``remove="spans"``) without the hit words."""
    found = free_name(docs, "found")
    marked = scan(docs, items, text, found=found, **names)
    if remove == "documents":
        return marked.where(F.col(found)["n_hit"] == 0).drop(found)
    if remove == "spans":
        return marked.withColumn(text, remove_spans(F.col(text), F.col(found)["spans"])).drop(found)
    raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
