"""Quantiles, single-column statistics against a target, and model evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ordered import running_sums


def approx_quantile(df: DataFrame, column: str, q: float, error: float = 0.0) -> DataFrame:
    """(value): a quantile of a numeric column; error 0 is exact."""
    value = df.approxQuantile(column, [float(q)], float(error))
    return df.sparkSession.createDataFrame([(value[0] if value else None,)], "value double")


def build_range(spark, n: int) -> DataFrame:
    """(id) from 0 to n - 1."""
    return spark.range(int(n))


def _per_column(df: DataFrame, columns: Sequence[str], statistic) -> DataFrame:
    wide = df.agg(*[statistic(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    items = F.array(*[F.struct(F.lit(c).alias("colName"), F.col(f"c{k}").alias("statistic")) for k, c in enumerate(columns)])
    return wide.select(F.explode(items).alias("r")).select("r.*")


def miss_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of nulls."""
    return _per_column(df, columns, lambda c: F.round(F.avg(F.col(c).isNull().cast("int")), 4))


def horizontal_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values."""
    return _per_column(df, columns, lambda c: F.countDistinct(c))


def pearson(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with the target."""
    return _per_column(df, columns, lambda c: F.corr(F.col(c).cast("double"), F.col(target).cast("double")))


def ks_statistic(df: DataFrame, columns: Sequence[str], p_value: bool = False) -> DataFrame:
    """Kolmogorov-Smirnov statistic of each column against N(0, 1), or its p-value."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    rows = []
    for c in columns:
        test = KolmogorovSmirnovTest.test(df.select(F.col(c).cast("double").alias(c)).dropna(), c, "norm", 0.0, 1.0).first()
        rows.append((c, float(test.pValue if p_value else test.statistic)))
    return df.sparkSession.createDataFrame(rows, "colName string, statistic double")


def information_value(df: DataFrame, columns: Sequence[str], target: str, positive=1, buckets: int = 10) -> DataFrame:
    """Information value over equal-frequency buckets; classes that a bucket lacks count as 1.

    Bucket edges of all columns come from one pass, counts from one aggregate.
    """
    edges = df.approxQuantile(list(columns), [k / buckets for k in range(1, buckets)], 0.0)

    def bucket(column: str, cuts: list[float]):
        return sum((F.when(F.col(column).cast("double") >= x, 1).otherwise(0) for x in sorted(set(cuts))), F.lit(0))

    parts = [F.struct(F.lit(c).alias("colName"), bucket(c, cuts).alias("bucket"), F.col(c).isNull().alias("gone")) for c, cuts in zip(columns, edges)]
    stacked = df.select(F.when(F.col(target) == F.lit(positive), 1).otherwise(0).alias("good"), F.explode(F.array(*parts)).alias("b"))
    counts = stacked.where(~F.col("b.gone")).groupBy("b.colName", "b.bucket").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    totals = counts.groupBy("colName").agg(F.sum("g").alias("g_all"), F.sum("b").alias("b_all"))
    one = lambda c: F.when(F.col(c) == 0, F.lit(1)).otherwise(F.col(c))
    rated = counts.join(totals, "colName").select("colName", (one("g") / one("g_all")).alias("pg"), (one("b") / one("b_all")).alias("pb"))
    return rated.groupBy("colName").agg(F.sum((F.col("pg") - F.col("pb")) * F.log(F.col("pg") / F.col("pb"))).alias("statistic"))


def columns_analysis(df: DataFrame, action: str, columns: Sequence[str], target: str | None = None, positive=1) -> DataFrame:
    """(colName, statistic) for an action: KS, P_VALUE, IV, MISS_RATE, HORIZONTAL_SCORE, PEARSON_IV, PEARSON_DV."""
    if action in ("KS", "P_VALUE"):
        return ks_statistic(df, columns, action == "P_VALUE")
    if action == "MISS_RATE":
        return miss_rate(df, columns)
    if action == "HORIZONTAL_SCORE":
        return horizontal_score(df, columns)
    if action in ("IV", "PEARSON_IV", "PEARSON_DV"):
        if not target:
            raise ValueError(f"{action} needs a target")
        return information_value(df, columns, target, positive) if action == "IV" else pearson(df, columns, target)
    raise ValueError(f"unknown action: {action}")


def confusion(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy(F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(name, value): f1, weightedPrecision, weightedRecall and accuracy, from one aggregate over the rows."""
    cells = confusion(df, label, prediction)
    real = cells.groupBy("label").agg(F.sum("n").alias("real"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    rates = real.join(said, "label", "left").select(
        "real", "hit", F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)).alias("p"), (F.col("hit") / F.col("real")).alias("r")
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    total = F.sum("real")
    wide = rates.agg(
        (F.sum(f1 * F.col("real")) / total).alias("f1"), (F.sum(F.col("p") * F.col("real")) / total).alias("weightedPrecision"),
        (F.sum(F.col("r") * F.col("real")) / total).alias("weightedRecall"), (F.sum("hit") / total).alias("accuracy"),
    )
    return _named(wide)


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(name, value): mse, rmse, r2, mae."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction).cast("double")
    mse = F.avg(e * e)
    return _named(df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"), F.avg(F.abs(e)).alias("mae")))


def _named(wide: DataFrame) -> DataFrame:
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in wide.columns])).alias("r")).select("r.*")


def _roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Folded scores with their own and running counts, highest first, and the totals."""
    at = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    summed = running_sums(at, [F.col("threshold").isNull(), -F.col("threshold")], {"p_upto": F.col("p"), "n_upto": F.col("n")})
    return summed.crossJoin(F.broadcast(at.agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, highest first. Equal scores fold before any order is made."""
    return _roc(df, label, score).select("threshold", (F.col("p_upto") / F.col("p_all")).alias("tpr"), (F.col("n_upto") / F.col("n_all")).alias("fpr"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(auc): area under the curve by trapezoids; a point's own counts give its step."""
    area = F.col("n") / F.col("n_all") * (2 * F.col("p_upto") - F.col("p")) / F.col("p_all") / 2
    return _roc(df, label, score).agg(F.sum(area).alias("auc"))
