"""Mixing sources to target weights at exact word budgets.

Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the
words of the whole table. A target stops at ``CAP`` times its source's size; the
excess is shared again by weight until none is above. That end state has a
closed form: ``target = min(cap, level * weight)`` for one level, found by
prefix sums over the sources sorted by cap / weight.

Within a source, documents lie in the order of a hash-random key. The order is
cut into ranges of the key small enough for one task; sums of the ranges and
prefix sums over them, and over stretches of ranges, give each range its start,
so no task holds a source, nor the ranges of one.
Each document then is taken once in every full epoch and, in the last one, as
far as the budget reaches: the document at the cut gives its first words only,
so the words taken from a source are its target, rounded down.

Defined results: a null text has size 0. A source without words has target 0.
A null source is a source of its own; rows of one doc_id are documents of their
own, and follow each other by hash of their text, repeated ones (ties) in any
order, as they are alike. Very long texts are counted whole. An empty table
gives no row. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .stash import Stash

#: Between words.
GAP = "[\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: Documents aimed at in one range of a source's keys.
RANGE = 1_000
#: Ranges in one stretch.
STRETCH = 1_000
#: Sources up to which their table is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def targets(stats: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """stats(source, source_size) with ``target``; one row a source, so one task suffices."""
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    sized = stats.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    stepped = sized.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("place"))
    found = stepped.withColumn("level", F.min_by("level", fits).over(W.partitionBy()))
    return found.select("source", "source_size", "rows", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row."""
    stash = Stash(docs.sparkSession, "mix")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = stash.keep(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
            F.coalesce(F.size(F.array_remove(F.split(F.col(text).cast("string"), GAP), "")), F.lit(0)).cast("long").alias("size"), key.alias("key"), F.xxhash64(text).alias("tie"),
        ),
        "sized",
    )
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = stash.keep(targets(stats, weights, cap), "goals")
    few = goals.count() <= BROADCAST_SOURCES
    # Keys have 60 bits; a source's ranges are the values of its first `bits`.
    bits = F.greatest(F.ceil(F.log2(F.col("rows") / RANGE)), F.lit(0)).cast("int")
    own = goals.select(F.col("source").alias("__source"), "source_size", "target", F.expr("shiftleft(1L, 60)").alias("span"), bits.alias("bits"))
    rows = sized.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("range", F.floor(F.col("key") / F.expr("shiftleft(1L, 60 - bits)")))
    # Prefix sums in two levels: of the ranges within a stretch, and of the stretches within a source.
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words")).withColumn("stretch", F.floor(F.col("range") / STRETCH))
    stretches = sums.groupBy("source", "stretch").agg(F.sum("words").alias("all")).select(
        F.col("source").alias("__source"), F.col("stretch").alias("__stretch"),
        (F.sum("all").over(W.partitionBy("source").orderBy("stretch")) - F.col("all")).alias("before"),
    )
    within = sums.withColumn("within", F.sum("words").over(W.partitionBy("source", "stretch").orderBy("range")) - F.col("words"))
    starts = within.join(stretches, F.col("source").eqNullSafe(F.col("__source")) & (F.col("stretch") == F.col("__stretch"))).select(
        "__source", F.col("range").alias("__range"), (F.col("before") + F.col("within")).alias("start"))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("range") == F.col("__range")))
    budget = F.floor(F.round("target", 6)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(round(target, 6)) as bigint) div greatest(source_size, 1)")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("start") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
