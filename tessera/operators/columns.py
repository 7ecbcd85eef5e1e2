"""Columns, ids, types, missing values, samples and partitions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.predicates import is_numeric
from .ordered import running_sums


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def unique_identifier(df: DataFrame, source: str = "new", column: str = "Unique_ID", start: int | str = 1, order_by: Sequence[str] = ()) -> DataFrame:
    """Consecutive bigint ids from ``start``, as first column (``new``) or in place (``replace``).

    Without ``order_by`` ids follow the rows' partitions: partition sizes are
    counted first, so no task orders the table. With it they follow that order,
    range by range; rows alike in it come by the hash of their columns.
    """
    try:
        start = int(start)
    except (TypeError, ValueError):
        start = 1
    if source not in ("new", "replace"):
        raise ValueError(f"source is 'new' or 'replace', not {source!r}")
    there = column in df.columns
    if source == "new" and there:
        raise ValueError(f"column {column} exists already")
    if order_by:
        ties = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        numbered = running_sums(df, [*map(F.col, order_by), ties], {"__id": F.lit(1)}).withColumn("__id", F.col("__id") + (start - 1))
    else:
        # A row's monotonic id holds its partition and its place there; partitions, not rows, are read and numbered.
        placed = df.withColumn("__mono", F.monotonically_increasing_id())
        part = F.shiftright("__mono", 33)
        counts = dict(placed.groupBy(part.alias("p")).count().collect())
        before, first = {}, start
        for p in sorted(counts):
            before[p] = first
            first += counts[p]
        starts = F.broadcast(df.sparkSession.createDataFrame(sorted(before.items()), "__part long, __first long"))
        place = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
        numbered = placed.withColumn("__part", part).join(starts, "__part", "left").withColumn("__id", F.col("__first") + place)
    if there:
        return numbered.select(*[F.col("__id").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
    return numbered.select(F.col("__id").alias(column), *[F.col(f"`{c}`") for c in df.columns])


def identifier_schema(spark: SparkSession, input_schema: str, source: str = "new", column: str = "Unique_ID") -> DataFrame:
    """(col_name, data_type) that ``unique_identifier`` would give, from a JSON list of name and type."""
    fields = [(f.get("col_name", f.get("name")), f.get("data_type", f.get("type"))) for f in json.loads(input_schema)]
    if source == "replace" and column in dict(fields):
        out = [(n, "bigint" if n == column else t) for n, t in fields]
    else:
        out = [(column, "bigint"), *fields]
    return spark.createDataFrame(out, "col_name string, data_type string")


def convert_digital_columns(dest: DataFrame, source: DataFrame, trim: bool = True) -> DataFrame:
    """Columns of ``dest`` as the numeric type that ``source`` has for the same name; bad text becomes null."""
    kinds = {f.name.lower(): f.dataType for f in source.schema.fields if is_numeric(f.dataType)}
    out = []
    for f in dest.schema.fields:
        kind = kinds.get(f.name.lower())
        col = F.col(f"`{f.name}`")
        if kind is None or kind == f.dataType:
            out.append(col)
        else:
            text = F.trim(col.cast("string")) if trim else col.cast("string")
            out.append(text.try_cast(kind).alias(f.name))
    return dest.select(*out)


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls as the column's mean; integers become doubles. One aggregate for all columns."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})


def fill_mode(df: DataFrame, columns: Sequence[str], compat: str | None = None) -> DataFrame:
    """Nulls as the most frequent value, the smallest of equals; ``compat="max"`` takes the largest value."""
    if compat == "max":
        values = df.agg(*[F.max(c).alias(c) for c in columns]).first()
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(values[c])) for c in columns})
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "c", "v").where("v is not null")
    counts = long.groupBy("c", "v").agg(F.count("*").alias("n"))
    best = {r["c"]: r["v"] for r in counts.groupBy("c").agg(F.min(F.struct(-F.col("n"), "v")).alias("m")).select("c", "m.v").collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(best.get(c)).cast(df.schema[c].dataType)) for c in columns})


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without a null in any column."""
    return df.dropna("any")


def fill_by_forest(df: DataFrame, columns: Sequence[str], trees: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """Nulls of numeric columns predicted by a random forest over all other numeric columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    for c in columns:
        others = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != c]
        vector = VectorAssembler(inputCols=others, outputCol="__features", handleInvalid="keep").transform(df)
        vector = vector.withColumn(c, F.col(c).cast("double"))
        known, unknown = vector.where(F.col(c).isNotNull()), vector.where(F.col(c).isNull())
        model = RandomForestRegressor(featuresCol="__features", labelCol=c, numTrees=trees, maxDepth=depth, seed=seed, predictionCol="__p").fit(known)
        filled = model.transform(unknown).withColumn(c, F.col("__p")).drop("__p")
        df = known.unionByName(filled).drop("__features").select(*df.columns)
    return df


def fill_missing(df: DataFrame, method: str, columns: Sequence[str] = (), **options) -> DataFrame:
    """Missing values by ``mean``, ``mode``, ``drop`` or ``randomforest``."""
    known = {"mean": fill_mean, "mode": fill_mode, "randomforest": fill_by_forest}
    if method == "drop":
        return drop_missing(df)
    if method not in known:
        raise ValueError(f"unknown method: {method}")
    return known[method](df, columns, **options)


def sample_dataset(spark: SparkSession, columns: Sequence[str] = ("id", "features", "label"), size: int = 10_000, features_size: int = 100, label_size: int = 2, seed: int = 7) -> DataFrame:
    """Random rows with an id, an array of floats and a label."""
    bad = set(columns) - {"id", "features", "label"}
    if bad:
        raise ValueError(f"unknown columns: {', '.join(sorted(bad))}")
    made = {
        "id": F.col("id"),
        "features": F.transform(F.sequence(F.lit(1), F.lit(features_size)), lambda k: (F.pmod(F.xxhash64(F.col("id"), k, F.lit(seed)), F.lit(1_000_003)) / 1_000_003).cast("float")),
        "label": F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(label_size)).cast("int"),
    }
    return spark.range(size).select(*[made[c].alias(c) for c in columns])


def take_sample(df: DataFrame, fraction: float | None = None, size: int | None = None, seed: int = 7) -> DataFrame:
    """A random sample by share, by size, or both."""
    if fraction is None and size is None:
        return df
    if size is None:
        return df.sample(fraction, seed)
    if fraction is None:
        fraction = min(size / max(df.count(), 1) + 0.2, 1.0)
    else:
        fraction = min(fraction + 0.1, 1.0)
    return df.sample(fraction, seed).limit(size)


def repartition_table(df: DataFrame, partitions: int, kind: str = "hash", columns: Sequence[str] = ()) -> DataFrame:
    """``hash`` deals rows out evenly, by columns if given; ``range`` needs columns."""
    if kind == "range":
        if not columns:
            raise ValueError("a range partition needs columns")
        return df.repartitionByRange(partitions, *columns)
    if kind != "hash":
        raise ValueError(f"unknown kind: {kind}")
    return df.repartition(partitions, *columns)


def pivot_sum(df: DataFrame, index: Sequence[str], names: str, values: str, known: Sequence | None = None) -> DataFrame:
    """One column for each value of ``names``, summing ``values``; without ``known`` values one more job finds them."""
    return df.groupBy(*index).pivot(names, known).sum(values)


def unpivot(df: DataFrame, index: Sequence[str], columns: Sequence[str], names: str, values: str) -> DataFrame:
    return df.unpivot(list(index), list(columns), names, values)


def category_index(df: DataFrame, column: str) -> DataFrame:
    """(value, index): categories numbered by falling frequency, then value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return running_sums(counts, [-F.col("n"), F.col("value")], {"index": F.lit(1)}).select("value", (F.col("index") - 1).cast("int").alias("index"))


def onehot(df: DataFrame, columns: Sequence[str]):
    """(frame, model): ``<c>_index`` and vector ``<c>_output`` of each column; the model does the same to other tables."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index") for c in columns]
    stages.append(OneHotEncoder(inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_output" for c in columns], dropLast=False))
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df), model
