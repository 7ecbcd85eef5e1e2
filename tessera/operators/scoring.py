"""Risk scoring: binning with weight of evidence, score cards and population stability."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


@dataclass
class Bins:
    """Bins of one feature: inner edges of a number, or categories of a string."""

    feature: str
    edges: list[float] | None = None
    categories: list[str] | None = None

    @property
    def count(self) -> int:
        return len(self.edges) + 1 if self.edges is not None else len(self.categories or [])

    def index(self) -> Column:
        """Bin of a row as an expression; an unseen category or a null has none."""
        if self.edges is not None:
            value = F.col(self.feature).cast("double")
            if not self.edges:
                return F.when(value.isNotNull(), F.lit(0))
            inside = F.aggregate(F.array(*[F.lit(float(e)) for e in self.edges]), F.lit(0), lambda n, e: n + F.when(value >= e, 1).otherwise(0))
            return F.when(value.isNotNull(), inside)
        place = F.array_position(F.array(*[F.lit(c) for c in self.categories]), F.col(self.feature).cast("string")).cast("int")
        return F.when(place > 0, place - 1)

    def place(self, value) -> int | None:
        """Bin of one value, as ``index`` gives it."""
        if value is None:
            return None
        if self.edges is not None:
            return sum(float(value) >= e for e in self.edges)
        return self.categories.index(str(value)) if str(value) in self.categories else None

    def label(self, k: int) -> str:
        if self.edges is None:
            return f"[{self.categories[k]}]"
        low = "-Infinity" if k == 0 else str(float(self.edges[k - 1]))
        high = "Infinity" if k == len(self.edges) else str(float(self.edges[k]))
        return f"{'(' if k == 0 else '['}{low}, {high})"


def fit_bins(df: DataFrame, features: Sequence[str], method: str = "EF", buckets: int = 5, custom: dict[str, int] | None = None, error: float = 0.0) -> list[Bins]:
    """Bins of features: ``EF`` equal frequency, ``ED`` equal width, strings by category.

    All numeric features share one quantile job or one aggregate.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    custom = custom or {}
    numbers = [f for f in features if not isinstance(kinds[f], T.StringType)]
    texts = [f for f in features if isinstance(kinds[f], T.StringType)]
    wanted = {f: int(custom.get(f, buckets)) for f in numbers}
    edges: dict[str, list[float]] = {}
    if method == "EF" and numbers:
        for n in sorted(set(wanted.values())):
            own = [f for f in numbers if wanted[f] == n]
            doubles = df.select(*[F.col(f).cast("double").alias(f) for f in own])
            for f, cuts in zip(own, doubles.approxQuantile(own, [k / n for k in range(1, n)], error)):
                edges[f] = sorted(set(cuts))
    elif method == "ED" and numbers:
        row = df.agg(*[F.struct(F.min(F.col(f).cast("double")).alias("lo"), F.max(F.col(f).cast("double")).alias("hi")).alias(f) for f in numbers]).first()
        for f in numbers:
            lo, hi, n = row[f]["lo"], row[f]["hi"], wanted[f]
            edges[f] = [] if lo is None or lo == hi else [lo + k * (hi - lo) / n for k in range(1, n)]
    elif method not in ("EF", "ED"):
        raise ValueError(f"method is 'EF' or 'ED', not {method!r}")
    found: dict[str, list[str]] = {}
    for f in texts:
        counts = df.where(F.col(f).isNotNull()).groupBy(f).agg(F.count("*").alias("n")).orderBy(F.desc("n"), f)
        found[f] = [r[0] for r in counts.collect()]
    return [Bins(f, edges.get(f), found.get(f)) for f in features]


def bin_rows(df: DataFrame, bins: Sequence[Bins], suffix: str = "_output") -> DataFrame:
    """``df`` with ``<feature>_output``: the row's bin."""
    return df.withColumns({f"{b.feature}{suffix}": b.index() for b in bins})


def _long(df: DataFrame, bins: Sequence[Bins], *extra: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(b.feature).alias("feature"), b.index().alias("bin_id")) for b in bins])
    return df.select(*extra, F.explode(pairs).alias("b")).select(*[c for c in ("good",) if extra], "b.feature", "b.bin_id").where("bin_id is not null")


def _labels(spark: SparkSession, bins: Sequence[Bins]) -> DataFrame:
    return spark.createDataFrame([(b.feature, k, b.label(k)) for b in bins for k in range(b.count)], "feature string, bin_id int, value string")


def woe_table(df: DataFrame, bins: Sequence[Bins], label: str = "label", good=1, woe: str = "ratio", smoothing: float = 0.0) -> DataFrame:
    """(feature, bin_id, value, p, n, total, prate, woe, iv): one aggregate over all features and bins.

    ``woe="ratio"`` is ln(prate / (P / N)); ``"odds"`` is the
    textbook ln((p / P) / (n / N)).
    """
    same = F.col(label).try_cast("double") == float(good) if isinstance(good, (int, float)) else F.col(label).cast("string") == good
    is_good = F.when(same, 1).otherwise(0)
    counts = _long(df, bins, is_good.alias("good")).groupBy("feature", "bin_id").agg(F.sum("good").alias("p"), F.sum(1 - F.col("good")).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))
    p, n, p_all, n_all = F.col("p") + smoothing, F.col("n") + smoothing, F.col("p_all"), F.col("n_all")
    rate = p / (p + n)
    weight = F.log(rate / (p_all / n_all)) if woe == "ratio" else F.log((p / p_all) / (n / n_all))
    rated = counts.join(totals, "feature").select("feature", "bin_id", "p", "n", (F.col("p") + F.col("n")).alias("total"), rate.alias("prate"), weight.alias("woe"), ((p / p_all - n / n_all) * weight).alias("iv"))
    return rated.join(_labels(df.sparkSession, bins), ["feature", "bin_id"]).select("feature", "bin_id", "value", "p", "n", "total", "prate", "woe", "iv")


def binning_info(table: DataFrame) -> DataFrame:
    """(featureName, Binning_Info): the table as one JSON a feature."""
    row = F.struct("bin_id", "value", "p", "n", "total", "prate", "woe", "iv")
    return table.groupBy(F.col("feature").alias("featureName")).agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("bin"), F.sum("iv").alias("iv"))).alias("Binning_Info")
    )


def save_bins(spark: SparkSession, bins: Sequence[Bins], path: str) -> None:
    rows = [(b.feature, json.dumps({"edges": b.edges, "categories": b.categories})) for b in bins]
    spark.createDataFrame(rows, "feature string, bins string").coalesce(1).write.mode("overwrite").parquet(f"{path}/binning")


def load_bins(spark: SparkSession, path: str) -> list[Bins]:
    return [Bins(r["feature"], **json.loads(r["bins"])) for r in spark.read.parquet(f"{path}/binning").collect()]


def card_score(p_good: Column, scaled_value: float = 800, odds: float = 50, pdo: float = 25) -> Column:
    """scaledValue - pdo ln(odds) / ln 2 + (pdo / ln 2) ln(p_good / p_bad)."""
    factor = pdo / math.log(2)
    return F.lit(scaled_value - factor * math.log(odds)) + F.lit(factor) * F.log(p_good / (1 - p_good))


@dataclass
class ScoreCard:
    """A fitted card: bins, weights of evidence by bin, the logistic model over them, and the scale."""

    bins: list[Bins]
    weights: dict[str, list[float]]
    coefficients: dict[str, float]
    intercept: float
    scale: dict[str, float]

    def log_odds(self) -> Column:
        """ln(p_good / p_bad) of a row; a value without a bin weighs nothing."""
        total = F.lit(self.intercept)
        for b in self.bins:
            weights = F.array(*[F.lit(float(x)) for x in self.weights[b.feature]])
            total = total + F.lit(self.coefficients[b.feature]) * F.coalesce(F.get(weights, b.index()), F.lit(0.0))
        return total

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` of good, ``prediction`` and ``predictedScore``."""
        p = 1 / (1 + F.exp(-self.log_odds()))
        return df.withColumns({"probability": p, "prediction": (p >= 0.5).cast("double"), "predictedScore": card_score(p, **self.scale)})

    def save(self, spark: SparkSession, path: str) -> None:
        body = {"bins": [vars(b) for b in self.bins], "weights": self.weights, "coefficients": self.coefficients, "intercept": self.intercept, "scale": self.scale}
        spark.createDataFrame([(json.dumps(body),)], "card string").coalesce(1).write.mode("overwrite").parquet(f"{path}/scorecard")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoreCard:
        body = json.loads(spark.read.parquet(f"{path}/scorecard").first()[0])
        return cls([Bins(**b) for b in body["bins"]], body["weights"], body["coefficients"], body["intercept"], body["scale"])


def fit_score_card(df: DataFrame, bins: Sequence[Bins], table: DataFrame, label: str = "label", good=1, scaled_value: float = 800, odds: float = 50, pdo: float = 25) -> ScoreCard:
    """A logistic model over the weights of evidence of ``table``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    weights: dict[str, list[float]] = {b.feature: [0.0] * b.count for b in bins}
    for r in table.select("feature", "bin_id", "woe").collect():
        weights[r["feature"]][r["bin_id"]] = r["woe"]
    own = [F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in weights[b.feature]]), b.index()), F.lit(0.0)).alias(f"w{k}") for k, b in enumerate(bins)]
    same = F.col(label).try_cast("double") == float(good) if isinstance(good, (int, float)) else F.col(label).cast("string") == good
    rows = df.select(*own, F.coalesce(same, F.lit(False)).cast("double").alias("label"))
    vectors = VectorAssembler(inputCols=[f"w{k}" for k in range(len(bins))], outputCol="features").transform(rows)
    model = LogisticRegression(featuresCol="features", labelCol="label").fit(vectors)
    coefficients = {b.feature: float(c) for b, c in zip(bins, model.coefficients)}
    return ScoreCard(list(bins), weights, coefficients, float(model.intercept), {"scaled_value": scaled_value, "odds": odds, "pdo": pdo})


def population_stability(expected: DataFrame, actual: DataFrame, bins: Sequence[Bins], smoothing: float = 0.0) -> DataFrame:
    """(feature, bin_id, value, actual, expected, diff, ln, psi): shares of rows by bin, two aggregates in all."""
    counts = lambda df, name: _long(df, bins).groupBy("feature", "bin_id").agg(F.count("*").alias(name))
    both = _labels(expected.sparkSession, bins).join(counts(actual, "a"), ["feature", "bin_id"], "left").join(counts(expected, "e"), ["feature", "bin_id"], "left").fillna(0, ["a", "e"])
    totals = both.groupBy("feature").agg(F.sum("a").alias("a_all"), F.sum("e").alias("e_all"))
    a, e = (F.col("a") + smoothing) / F.col("a_all"), (F.col("e") + smoothing) / F.col("e_all")
    ratio = F.when((a > 0) & (e > 0), F.log(a / e))
    return both.join(totals, "feature").select("feature", "bin_id", "value", a.alias("actual"), e.alias("expected"), (a - e).alias("diff"), ratio.alias("ln"), ((a - e) * ratio).alias("psi"))
