"""Column profiles: summaries, value frequencies and value patterns."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.predicates import fixed_bytes, is_numeric, non_blank, type_name
from .ordered import running_sums

#: Metrics in the order of the output.
METRICS = (
    "%25", "median", "%75", "blankValueRatio", "dataLength", "dataType", "max", "maximumLength", "mean", "min", "minimumLength", "nonNullCount",
    "nullValueRatio", "skewness", "totalCount", "standardDeviation", "standardError", "uniqueValueRatio", "categoryCount", "primaryKeyCandidate", "mode",
)
DEFAULT_METRICS = tuple(m for m in METRICS if m not in ("%25", "%75", "skewness", "categoryCount"))
QUARTILES = (0.25, 0.5, 0.75)
_RATIOS = ("blankValueRatio", "nullValueRatio", "uniqueValueRatio")
_COUNTS = ("dataLength", "maximumLength", "minimumLength", "nonNullCount", "totalCount", "categoryCount", "primaryKeyCandidate")


def _check_names(df: DataFrame) -> None:
    bad = [c for c in df.columns if "." in c or "`" in c]
    if bad:
        raise ValueError(f"column names may not hold a dot or a backtick: {', '.join(bad)}")


def _single_pass(df: DataFrame, relative_error: float | None) -> dict:
    """All metrics that one aggregate gives, by (column, metric); estimated quartiles only with a ``relative_error``."""
    aggs: dict[tuple[str, str], Column] = {}
    total = F.count(F.lit(1))
    for field in df.schema.fields:
        name, kind = field.name, field.dataType
        col, there = F.col(f"`{name}`"), non_blank(name, kind)
        value = F.when(there, col)
        aggs[name, "totalCount"] = total
        aggs[name, "nonNullCount"] = F.count_if(there)
        missing = col.isNull() | F.isnan(col) if isinstance(kind, (T.FloatType, T.DoubleType)) else col.isNull()
        aggs[name, "nullValueRatio"] = F.avg(missing.cast("int"))
        aggs[name, "blankValueRatio"] = F.avg(F.coalesce(F.trim(col) == "", F.lit(False)).cast("int")) if isinstance(kind, T.StringType) else F.lit(0.0)
        if isinstance(kind, T.NullType):
            continue
        if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.BooleanType)) or isinstance(kind, T.BooleanType):
            aggs[name, "max"], aggs[name, "min"] = F.max(value), F.min(value)
        if isinstance(kind, T.StringType):
            aggs[name, "maximumLength"], aggs[name, "minimumLength"] = F.max(F.length(col)), F.min(F.length(col))
        if is_numeric(kind):
            number = value.cast("double")
            aggs[name, "mean"] = F.avg(number)
            aggs[name, "standardDeviation"] = F.stddev_samp(number)
            aggs[name, "standardError"] = F.stddev_samp(number) / F.sqrt(F.count(number))
            aggs[name, "skewness"] = F.skewness(number)
            if relative_error:
                aggs[name, "quartiles"] = F.percentile_approx(number, F.array(*map(F.lit, QUARTILES)), int(1 / relative_error))
    row = df.agg(*[c.alias(f"m{k}") for k, c in enumerate(aggs.values())]).first()
    return dict(zip(aggs, row))


def _frequencies(df: DataFrame, exclude_blank: bool = True) -> DataFrame:
    """(columnName, value, n) of all columns: one unpivot and one aggregate."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.NullType, T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if not fields:
        return df.sparkSession.createDataFrame([], "columnName string, value string, n long")
    text = df.select(*[(F.when(non_blank(f.name, f.dataType), F.col(f"`{f.name}`").cast("string")) if exclude_blank else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in fields])
    long = text.unpivot([], [F.col(f"`{f.name}`") for f in fields], "columnName", "value")
    if exclude_blank:
        long = long.where("value is not null")
    return long.groupBy("columnName", "value").agg(F.count("*").alias("n"))


def distinct_and_mode(df: DataFrame) -> DataFrame:
    """(columnName, categories, mode, least_mode): distinct non-blank values, the most frequent one if it is alone, and the smallest of these.

    Values with the same count fold into one row first, so no task holds a
    column's values.
    """
    by_count = _frequencies(df).groupBy("columnName", "n").agg(F.count("*").alias("k"), F.min("value").alias("value"))
    top = F.max_by(F.struct("k", "value"), "n")
    return by_count.groupBy("columnName").agg(F.sum("k").alias("categories"), top.alias("top")).select(
        "columnName", "categories", F.when(F.col("top.k") == 1, F.col("top.value")).alias("mode"), F.col("top.value").alias("least_mode")
    )


def _number(value) -> Decimal | None:
    try:
        number = Decimal(str(value).strip())
        return number if number.is_finite() else None
    except (InvalidOperation, ValueError):
        return None


def _rounded(number: Decimal, places: int) -> str:
    """Half-up rounding, printed like a double: at least one decimal, no trailing zeros."""
    out = format(number.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP).normalize(), "f")
    out = "0" if out in ("-0", "") else out
    return out if "." in out else out + ".0"


def _printed(metric: str, value, round_at: int, dtype: T.DataType) -> str:
    if value is None:
        return ""
    if metric in _COUNTS:
        return str(int(value))
    if metric in ("max", "min", "mode"):
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
            return str(value)
        number = _number(value)
        return str(value) if number is None else _rounded(number, round_at)
    number = _number(value)
    return "" if number is None else _rounded(number, round_at + 2 if metric in _RATIOS else round_at)


def data_summary(
    df: DataFrame, metrics: Sequence[str] = DEFAULT_METRICS, round_at: int = 2, relative_error: float = 0.01,
    approx_count_distinct: bool = True, approx_threshold: int = 100_000, percentile_method: str = "interpolated", mode_format: str = "empty",
) -> DataFrame:
    """One row of strings a column: columnName, ordinalPosition and the metrics.

    Up to ``approx_threshold`` rows all is exact (-1: always); beyond it
    percentiles have ``relative_error`` and distinct counts are estimated
    unless ``approx_count_distinct`` is off. ``percentile_method="nist"`` takes
    percentiles at rank p (n + 1). Of equally frequent values the mode is none
    (``mode_format="empty"``) or the smallest (``"auto"``). An empty table
    gives no row.
    """
    if percentile_method not in ("interpolated", "nist") or mode_format not in ("empty", "auto"):
        raise ValueError(f"unknown option: {percentile_method}, {mode_format}")
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
    _check_names(df)
    chosen = [m for m in METRICS if m in metrics]
    schema = "columnName string, ordinalPosition string, " + ", ".join(f"`{m}` string" for m in chosen)
    spark = df.sparkSession
    if not df.columns:
        return spark.createDataFrame([], schema)
    exact = approx_threshold < 0 or df.limit(approx_threshold + 1).count() <= approx_threshold
    ranked_wanted = bool({"%25", "median", "%75"} & set(chosen))
    estimated = ranked_wanted and not exact and relative_error > 0 and percentile_method == "interpolated"
    got = _single_pass(df, relative_error if estimated else None)
    if not got[df.columns[0], "totalCount"]:
        return spark.createDataFrame([], schema)
    need_values = {"mode"} & set(chosen) or {"uniqueValueRatio", "categoryCount", "primaryKeyCandidate"} & set(chosen)
    values = {}
    if need_values and (exact or not approx_count_distinct or "mode" in chosen):
        values = {r["columnName"]: r for r in distinct_and_mode(df).collect()}
    elif need_values:
        sketch = df.agg(*[F.approx_count_distinct(F.when(non_blank(f.name, f.dataType), F.col(f"`{f.name}`"))).alias(f"c{k}") for k, f in enumerate(df.schema.fields)]).first()
        values = {f.name: {"categories": sketch[k], "mode": None, "least_mode": None} for k, f in enumerate(df.schema.fields)}
    ranked = {}
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if ranked_wanted and not estimated and numbers:
        ranked = dict(exact_percentiles(df, numbers, QUARTILES, percentile_method).collect())
    rows = []
    for place, field in enumerate(df.schema.fields, 1):
        name, kind = field.name, field.dataType
        own = {m: got.get((name, m)) for m in METRICS}
        quartiles = ranked.get(name) or got.get((name, "quartiles")) or [None] * 3
        own["%25"], own["median"], own["%75"] = quartiles
        own["dataType"] = type_name(kind)
        own["dataLength"] = own["maximumLength"] if isinstance(kind, T.StringType) else fixed_bytes(kind)
        there, seen = own["nonNullCount"], values.get(name)
        categories = seen["categories"] if seen else 0
        own["uniqueValueRatio"] = min(1.0, categories / there) if there else 0.0
        own["categoryCount"] = 0 if is_numeric(kind) else categories
        own["primaryKeyCandidate"] = int(there > 0 and categories >= there)
        own["mode"] = (seen["mode"] if mode_format == "empty" else seen["least_mode"]) if seen else None
        rows.append((name, str(place), *(own["dataType"] if m == "dataType" else _printed(m, own[m], round_at, kind) for m in chosen)))
    return spark.createDataFrame(rows, schema)


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Typed long form of the numeric metrics: one row a column, one pass over the table."""
    return _long(df, columns, lambda c: {
        "total_count": F.count(F.lit(1)), "non_null": F.count(c), "mean": F.avg(c), "stddev": F.stddev_samp(c),
        "stderr": F.stddev_samp(c) / F.sqrt(F.count(c)), "skewness": F.skewness(c), "min": F.min(c.cast("double")), "max": F.max(c.cast("double")),
    })


def string_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _long(df, columns, lambda c: {
        "non_blank": F.count_if(c.isNotNull() & (F.trim(c) != "")), "null_ratio": F.avg(c.isNull().cast("int")), "blank_ratio": F.avg(F.coalesce(F.trim(c) == "", F.lit(False)).cast("int")),
        "max_length": F.max(F.length(c)).cast("long"), "min_length": F.min(F.length(c)).cast("long"), "min": F.min(c), "max": F.max(c),
    })


def _number_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columnName, value, n): the numbers of all columns as doubles, folded by one unpivot and one aggregate."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numbers = df.select(*[F.when(non_blank(c, kinds[c]), F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    long = numbers.unpivot([], [F.col(f"`{c}`") for c in columns], "columnName", "value").where("value is not null")
    return long.groupBy("columnName", "value").agg(F.count("*").alias("n"))


def exact_percentiles(df: DataFrame, columns: Sequence[str], points: Sequence[float] = QUARTILES, method: str = "interpolated") -> DataFrame:
    """(columnName, percentiles): exact percentiles of all columns, at rank 1 + p (n - 1) or (``method="nist"``) p (n + 1).

    Values fold by column first and get ranks by running sums over ranges, so
    no task holds the values of a column.
    """
    counts = _number_counts(df, columns)
    ranked = running_sums(counts, [F.col("columnName"), F.col("value")], {"hi": F.col("n")})
    of_column = counts.groupBy("columnName").agg(F.sum("n").alias("all"))
    before = F.coalesce(F.sum("all").over(W.orderBy("columnName").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranked.join(F.broadcast(of_column.withColumn("before", before)), "columnName")
    hi = F.col("hi") - F.col("before")
    lo = hi - F.col("n") + 1
    ends = []
    for p in points:
        rank = F.lit(p) * (F.col("all") - 1) + 1 if method == "interpolated" else F.least(F.greatest(F.lit(p) * (F.col("all") + 1), F.lit(1.0)), F.col("all").cast("double"))
        at = lambda r: F.max(F.when((lo <= r) & (hi >= r), F.col("value")))  # noqa: B023, E731
        ends.append(F.struct(at(F.floor(rank)).alias("low"), at(F.ceil(rank)).alias("high"), F.max(rank - F.floor(rank)).alias("share")))
    found = placed.groupBy("columnName").agg(F.array(*ends).alias("e"))
    return found.select("columnName", F.transform("e", lambda e: e["low"] + e["share"] * (e["high"] - e["low"])).alias("percentiles"))


def quartile_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact interpolated quartiles of all columns."""
    found = exact_percentiles(df, columns)
    return found.select(F.col("columnName").alias("column_name"), *[F.get("percentiles", F.lit(k)).alias(name) for k, name in enumerate(("q25", "q50", "q75"))])


def nist_percentiles(df: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """(p, value): percentiles at rank p (n + 1), interpolated between neighbours."""
    found = exact_percentiles(df, [column], points, "nist")
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in points]).alias("p"), F.col("percentiles").alias("value"))
    return found.select(F.explode(pairs).alias("r")).select("r.p", "r.value")


def _long(df: DataFrame, columns: Sequence[str], metrics) -> DataFrame:
    """One aggregate, then one row a column."""
    wide = df.agg(*[F.struct(F.lit(c).alias("column_name"), *[m.alias(n) for n, m in metrics(F.col(c)).items()]).alias(f"c{k}") for k, c in enumerate(columns)])
    return wide.select(F.explode(F.array(*[f"c{k}" for k in range(len(columns))])).alias("r")).select("r.*")


def descriptive_metrics(df: DataFrame, metric_size: int = 100, exclude_empty: bool = True) -> DataFrame:
    """(columnName, value, n): the most frequent values of each column, by count then value."""
    if metric_size <= 0:
        raise ValueError("metricSize must be positive")
    best = _frequencies(df, exclude_empty).withColumn("rank", F.row_number().over(W.partitionBy("columnName").orderBy(F.desc("n"), "value")))
    return best.where(F.col("rank") <= metric_size).drop("rank")


def descriptive_metrics_json(df: DataFrame, metric_size: int = 100, exclude_empty: bool = True) -> DataFrame:
    """(columnName, descriptiveMetrics): the same as a JSON list by value."""
    best = descriptive_metrics(df, metric_size, exclude_empty)
    item = F.concat(F.lit("{\""), F.regexp_replace("value", r"([\\\"])", r"\\$1"), F.lit("\" : "), F.col("n").cast("string"), F.lit("}"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", item.alias("item")))), lambda x: x["item"]), ", ")
    return best.groupBy("columnName").agg(F.concat(F.lit("["), listed, F.lit("]")).alias("descriptiveMetrics"))



def value_pattern(col: Column) -> Column:
    """Each character by its class: A, a, 9, or itself."""
    out = F.regexp_replace(col, "[a-z]", "a")
    out = F.regexp_replace(out, "[A-Z\\x{4e00}-\\x{9fbb}]", "A")
    return F.regexp_replace(out, "[0-9]", "9")


def run_pattern(col: Column, limit: int | None = None) -> Column:
    """Runs of classes with their lengths, like Aa(2)9(4), of the whole text or of its first ``limit`` characters."""
    text = col if limit is None else F.substring(col, 1, limit)
    runs = F.regexp_extract_all(value_pattern(text), F.lit("(?s)A+|a+|9+|."), F.lit(0))
    short = lambda x: F.when((F.length(x) > 1), F.concat(F.substring(x, 1, 1), F.lit("("), F.length(x).cast("string"), F.lit(")"))).otherwise(x)
    return F.array_join(F.transform(runs, short), "")


def pattern_distribution(df: DataFrame, limit: int = 100, pattern_limit: int = 1000, exclude_empty: bool = True) -> DataFrame:
    """(columnName, pattern, alternativePattern, n, ratio, totalCount) of string columns.

    ``totalCount`` is the number of distinct patterns; ``limit`` rows a column
    at most, by count then pattern.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "columnName string, pattern string, alternativePattern string, n long, ratio double, totalCount long")
    long = df.select(*names).unpivot([], names, "columnName", "value")
    if exclude_empty:
        long = long.where("value is not null and trim(value) <> ''")
    cut = F.substring("value", 1, pattern_limit)
    counted = long.groupBy("columnName", value_pattern(cut).alias("pattern")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("columnName").agg(F.sum("n").alias("rows"), F.count("*").alias("totalCount"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("columnName").orderBy(F.desc("n"), "pattern"))).where(F.col("rank") <= limit)
    return ranked.join(totals, "columnName").select(
        "columnName", "pattern", run_pattern(F.col("pattern"), pattern_limit).alias("alternativePattern"), "n", (F.col("n") / F.col("rows")).alias("ratio"), "totalCount"
    )


def pattern_distribution_json(df: DataFrame, **options) -> DataFrame:
    """(columnName, patternDistribution) as JSON; ``{}`` for a column without values."""
    long = pattern_distribution(df, **options)
    item = F.struct("pattern", "alternativePattern", F.col("n").alias("count"), F.round("ratio", 4).alias("ratio"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "pattern", item.alias("item")))), lambda x: x["item"])
    packed = long.groupBy("columnName").agg(F.to_json(F.struct(F.first("totalCount").alias("totalCount"), ordered.alias("patternDistribution"))).alias("patternDistribution"))
    names = [(f.name,) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    every = df.sparkSession.createDataFrame(names, "columnName string")
    return every.join(packed, "columnName", "left").select("columnName", F.coalesce("patternDistribution", F.lit("{}")).alias("patternDistribution"))
