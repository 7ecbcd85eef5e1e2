"""Running sums and ranks in one order over a whole table, without a task that holds it.

Rows are dealt into consecutive ranges of the order, each range is sorted by a
task of its own, and the sums of the ranges before are added. The bounds of the
ranges come from an even sample by hash; they set the size of a task and never
a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Sampled rows for each range; the bounds of all ranges are one broadcast row.
SAMPLED = 40


def _free(df: DataFrame, label: str) -> str:
    taken, name = {c.lower() for c in df.columns}, f"__{label}"
    while name.lower() in taken:
        name += "_"
    return name


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with the inclusive running sum of each column of ``sums``, in rising order of ``order``, nulls first.

    Rows that are equal in ``order`` get running sums in no stated order, so
    ``order`` should tell rows apart. ``df`` is read more than once: it should
    be small, folded by a shuffle (which is then reused), or a plain scan.
    """
    ranges = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key, part, base = _free(df, "order"), _free(df, "range"), _free(df, "base")
    values = {n: f"{base}{k}" for k, n in enumerate(sums)}
    keyed = df.withColumns({key: F.struct(*[c.alias(f"k{k}") for k, c in enumerate(order)])})
    if ranges == 1:
        dealt = keyed.withColumn(part, F.lit(0))
    else:
        sample = keyed.select(key).orderBy(F.xxhash64(key), key).limit(ranges * SAMPLED)
        listed = sample.agg(F.sort_array(F.collect_list(key)).alias("s"))
        cuts = F.filter(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda k: F.get("s", (k * F.size("s") / ranges).cast("int"))), lambda c: c.isNotNull())
        bounds = listed.select(F.array_distinct(cuts).alias(part))
        dealt = keyed.crossJoin(F.broadcast(bounds)).withColumn(part, F.size(F.filter(part, lambda c: c <= F.col(key))))
    dealt = dealt.withColumns({values[n]: c for n, c in sums.items()})
    totals = dealt.groupBy(part).agg(*[F.sum(v).alias(v) for v in values.values()])
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(part, *[F.sum(v).over(before).alias(f"{v}_") for v in values.values()])
    inside = W.partitionBy(part).orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = dealt.withColumns({v: F.sum(v).over(inside) for v in values.values()}).join(F.broadcast(starts), part)
    own = [c for c in df.columns if c not in sums]
    return out.select(*[F.col(f"`{c}`") for c in own], *[(F.coalesce(F.col(v), F.lit(0)) + F.coalesce(F.col(f"{v}_"), F.lit(0))).alias(n) for n, v in values.items()])


def pairs_above(left: DataFrame, key: str, value: str, right: DataFrame, other: str, ranges: int | None = None) -> DataFrame:
    """(``key``, n): how many pairs each ``key`` has in which ``left``'s ``value`` is greater than ``right``'s ``other``.

    This is the count by ``key`` of an inner join on ``value > other``, so keys
    without a pair have no row and a null makes none; NaN is above all numbers
    and equal to NaN. No pair is formed: both sides are folded and put in one
    order, left rows before right rows of their value, where the running count
    of right rows is the number of a left row's pairs.
    """
    lefts = left.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("at"), F.col(key).alias("key")).agg(F.count("*").alias("times"))
    rights = right.where(F.col(other).isNotNull()).groupBy(F.col(other).alias("at")).agg(F.count("*").alias("n"))
    both = lefts.select("at", F.lit(0).alias("side"), "key", "times", F.lit(0).cast("long").alias("n")).unionByName(
        rights.select("at", F.lit(1).alias("side"), F.lit(None).cast(lefts.schema["key"].dataType).alias("key"), F.lit(0).cast("long").alias("times"), "n")
    )
    counted = running_sums(both, [F.col("at"), F.col("side"), F.col("key")], {"n": F.col("n")}, ranges)
    return counted.where("side = 0 and n > 0").groupBy(F.col("key").alias(key)).agg(F.sum(F.col("times") * F.col("n")).alias("n"))
