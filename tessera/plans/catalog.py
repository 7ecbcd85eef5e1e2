"""All queries outside the training-data subpackage, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import prompts
from ..operators import analysis, asserts, columns, ordered, profiling, retrieval, scoring
from ..streaming import cdc, windows
from .relational import SHARED, SPELLED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(tables: str, text: str) -> Query:
    """A query from SQL text; the tables are arguments of the text, so no view is left behind."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = tables.split()
        own = {f"{n}_": table(spark, sf_dir, n) for n in names}
        views = ", ".join(f"{n} as (select * from {{{n}_}})" for n in names)
        body = text.strip()
        if body.lower().startswith("with "):
            return spark.sql(f"with {views}, {body[5:]}", **own)
        return spark.sql(f"with {views} {body}", **own)

    return run


for _name, (_tables, _body) in SHARED.items():
    QUERIES[_name], ORACLES[_name] = _text(_tables, _body), _body
for _name, (_tables, _body, _other) in SPELLED.items():
    QUERIES[_name], ORACLES[_name] = _text(_tables, _body), _other


def query(sql: str | None = None):
    """Register a function as a query, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
        select p.p_partkey, count(*) as n from part p join supplier s on p.p_retailprice > s.s_acctbal group by p.p_partkey""")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.pairs_above(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", table(spark, sf_dir, "supplier"), "s_acctbal")


def _union(columns_: list[str], select: str) -> str:
    return " union all ".join(select.format(c=c) for c in columns_)


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _shown(x: str, places: int = 2) -> str:
    """A number as profiles print it: rounded half up, with one decimal at least and no other trailing zeros."""
    return f"coalesce(cast(cast(round(cast({x} as decimal(38, 12)), {places}) as double) + 0.0 as varchar), '')"


def _summary_sql(name: str, place: int, kind: str, size: str) -> str:
    """All metrics of one column of lineitem that has no null or blank."""
    number, text = kind in ("long", "integer", "double"), kind == "string"
    shown = _shown if number else lambda x, places=2: f"cast({x} as varchar)"
    only = lambda have, x: x if have else "''"
    skew = "(avg(v^3) - 3 * avg(v) * avg(v^2) + 2 * avg(v)^3) / power(var_pop(v), 1.5)"
    metrics = {
        "%25": only(number, _shown("quantile_cont(v, 0.25)")), "median": only(number, _shown("quantile_cont(v, 0.5)")), "%75": only(number, _shown("quantile_cont(v, 0.75)")),
        "blankValueRatio": _shown("avg((trim(cast(v as varchar)) = '')::int)", 4), "dataLength": "cast(max(length(v)) as varchar)" if text else f"'{size}'", "dataType": f"'{kind}'",
        "max": shown("max(v)"), "maximumLength": only(text, "cast(max(length(v)) as varchar)"), "mean": only(number, _shown("avg(v)")), "min": shown("min(v)"),
        "minimumLength": only(text, "cast(min(length(v)) as varchar)"), "nonNullCount": "cast(count(v) as varchar)", "nullValueRatio": _shown("avg((v is null)::int)", 4),
        "skewness": only(number, _shown(skew)), "totalCount": "cast(count(*) as varchar)", "standardDeviation": only(number, _shown("stddev_samp(v)")),
        "standardError": only(number, _shown("stddev_samp(v) / sqrt(count(v))")), "uniqueValueRatio": _shown("count(distinct v) / count(v)", 4),
        "categoryCount": "'0'" if number else "cast(count(distinct v) as varchar)", "primaryKeyCandidate": "cast((count(distinct v) = count(v))::int as varchar)",
        "mode": f"(select case when count(*) = 1 then {shown('min(w)')} else '' end from (select {name} as w, count(*) as n, max(count(*)) over () as top from lineitem group by 1) where n = top)",
    }
    listed = ", ".join(f'{x} as "{m}"' for m, x in metrics.items())
    value = f"cast({name} as double)" if number else name
    return f"select '{name}' as \"columnName\", '{place}' as \"ordinalPosition\", {listed} from (select {value} as v from lineitem)"


_LINEITEM = (
    ("l_orderkey", "long", "8"), ("l_partkey", "long", "8"), ("l_suppkey", "long", "8"), ("l_linenumber", "integer", "4"), ("l_quantity", "double", "8"), ("l_extendedprice", "double", "8"),
    ("l_discount", "double", "8"), ("l_tax", "double", "8"), ("l_returnflag", "string", ""), ("l_linestatus", "string", ""), ("l_shipdate", "timestamp_ntz", "8"),
)


@query(" union all ".join(_summary_sql(name, place, kind, size) for place, (name, kind, size) in enumerate(_LINEITEM, 1)))
def summary_compat(spark, sf_dir):
    return profiling.data_summary(table(spark, sf_dir, "lineitem"), metrics=profiling.METRICS, approx_threshold=-1)


@query(_union(_NUMBERS, """select '{c}' as column_name, count(*) as total_count, count({c}) as non_null, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as stddev,
    round(stddev_samp({c}) / sqrt(count({c})), 6) as stderr, min({c})::double as min, max({c})::double as max,
    round((avg({c}^3) - 3 * avg({c}) * avg({c}^2) + 2 * avg({c})^3) / power(var_pop({c}), 1.5), 4) as skewness from lineitem"""))
def summary_numeric(spark, sf_dir):
    out = profiling.numeric_summary(table(spark, sf_dir, "lineitem"), _NUMBERS)
    return _rounded(_rounded(out, 6, "mean", "stddev", "stderr"), 4, "skewness")


@query(_union(["c_name", "c_mktsegment"], """select '{c}' as column_name, count(*) filter (trim({c}) <> '') as non_blank, avg(({c} is null)::int) as null_ratio,
    avg((trim({c}) = '')::int) as blank_ratio, max(length({c})) as max_length, min(length({c})) as min_length, min({c}) as min, max({c}) as max from customer"""))
def summary_string(spark, sf_dir):
    return profiling.string_summary(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query("""select 'd' as column_name, round(avg((nullif(l_discount, 0) is null)::int), 4) as null_ratio from lineitem
    union all select 's', round(avg((nullif(l_returnflag, 'N') is null)::int), 4) from lineitem""")
def summary_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_returnflag", F.lit("N")).alias("s"))
    return analysis.miss_rate(df, ["d", "s"]).select(F.col("colName").alias("column_name"), F.col("statistic").alias("null_ratio"))


_DISTINCT = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]


@query(_union(_DISTINCT, """select '{c}' as column_name, count(distinct {c}) as categories from lineitem"""))
def summary_distinct(spark, sf_dir):
    out = profiling.distinct_and_mode(table(spark, sf_dir, "lineitem").select(*_DISTINCT))
    return out.select(F.col("columnName").alias("column_name"), "categories")


@query(_union(_DISTINCT, """select '{c}' as column_name, case when count(*) = 1 then min(v) end as mode from (
    select cast({c} as varchar) as v, count(*) as n, max(count(*)) over () as top from lineitem where {c} is not null group by {c}) where n = top"""))
def summary_mode(spark, sf_dir):
    out = profiling.distinct_and_mode(table(spark, sf_dir, "lineitem").select(*_DISTINCT))
    return out.select(F.col("columnName").alias("column_name"), "mode")


@query(_union(_NUMBERS, """select '{c}' as column_name, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75 from lineitem"""))
def summary_quartiles(spark, sf_dir):
    return profiling.quartile_summary(table(spark, sf_dir, "lineitem"), _NUMBERS)


@query("""with o as (select o_totalprice as v, row_number() over (order by o_totalprice) as r, count(*) over () as n from orders),
    p as (select unnest([0.25, 0.5, 0.75])::double as p), t as (select p, p * (max(n) + 1) as r from o, p group by p)
    select p, round((select min(v) from o where o.r = floor(t.r)) + (t.r - floor(t.r)) * ((select min(v) from o where o.r = ceil(t.r)) - (select min(v) from o where o.r = floor(t.r))), 4) as value from t""")
def summary_nist_percentile(spark, sf_dir):
    return _rounded(profiling.nist_percentiles(table(spark, sf_dir, "orders"), "o_totalprice", [0.25, 0.5, 0.75]), 4, "value")


@query(_union(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "select '{c}' as column_name, count({c}) > 0 and count(distinct {c}) = count({c}) as candidate from customer"))
def pk_candidate(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    bad = asserts.conflicting_keys(df, df.columns).select(F.col("ConflictKey").alias("column_name"), F.lit(False).alias("ok"))
    names = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    return names.join(bad, "column_name", "left").select("column_name", F.coalesce("ok", F.lit(True)).alias("candidate"))


@query(" union all ".join(f"""select * from (select '{c}' as column_name, cast({c} as varchar) as value, count(*) as n from part group by {c} order by n desc, value limit 20)""" for c in ("p_brand", "p_size", "p_type")))
def descriptive_metrics(spark, sf_dir):
    out = profiling.descriptive_metrics(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_type"), metric_size=20)
    return out.withColumnRenamed("columnName", "column_name")


_PATTERN = "regexp_replace(regexp_replace(regexp_replace({c}, '[a-z]', 'a', 'g'), '[A-Z一-龻]', 'A', 'g'), '[0-9]', '9', 'g')"


@query(" union all ".join(f"""select * from (select '{c}' as column_name, {_PATTERN.format(c=c)} as pattern, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as ratio,
    count(*) over () as total_patterns from {t} group by 2 order by n desc, pattern limit 100)""" for t, c in (("part", "p_name"), ("part", "p_type"))))
def pattern_distribution(spark, sf_dir):
    out = profiling.pattern_distribution(table(spark, sf_dir, "part").select("p_name", "p_type"))
    return out.select(F.col("columnName").alias("column_name"), "pattern", "n", F.round("ratio", 6).alias("ratio"), F.col("totalCount").alias("total_patterns"))


@query("""select doc_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '[a-z]', 'a', 'g'), '[A-Z一-龻]', 'A', 'g'), '[0-9]', '9', 'g'),
    'A+|a+|9+|[\\s\\S]'), lambda x: case when length(x) > 1 then substr(x, 1, 1) || '(' || length(x) || ')' else x end), '') as pattern from documents""")
def alt_pattern_distribution(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", profiling.run_pattern(F.col("text")).alias("pattern"))


@query("select quantile_disc(l_extendedprice, 0.9) as value from lineitem")
def approx_quantile_exact(spark, sf_dir):
    return analysis.approx_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.9, 0.0)


@query("select count(distinct l_suppkey)::double as statistic, 'l_suppkey' as \"colName\" from lineitem union all select count(distinct l_linenumber)::double, 'l_linenumber' from lineitem")
def horizontal_score(spark, sf_dir):
    return analysis.columns_analysis(table(spark, sf_dir, "lineitem"), "HORIZONTAL_SCORE", ["l_suppkey", "l_linenumber"])


@query("""select 'd' as "colName", round(avg((nullif(l_discount, 0) is null)::int), 4) as statistic from lineitem""")
def miss_rate(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return analysis.columns_analysis(df, "MISS_RATE", ["d"])


@query(_union(["l_quantity", "l_discount", "l_tax"], "select '{c}' as \"colName\", round(corr({c}, l_extendedprice), 6) as statistic from lineitem"))
def pearson(spark, sf_dir):
    return _rounded(analysis.columns_analysis(table(spark, sf_dir, "lineitem"), "PEARSON_DV", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 6, "statistic")


@query("""with z as (select (l_extendedprice - 30000) / 20000 as z, count(*) as k from lineitem group by 1),
    r as (select z, k, sum(k) over (order by z) as upto, sum(k) over () as n, z / sqrt(2) as x from z),
    f as (select k, upto, n, 0.5 + list_sum(list_transform(range(90), lambda j: pow(-1, j) * pow(x, 2 * j + 1) / (gamma(j + 1) * (2 * j + 1)))) / sqrt(pi()) as f from r)
    select 'z' as "colName", round(max(greatest(upto / n - f, f - (upto - k) / n)), 6) as statistic from f""")
def ks_normal(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(((F.col("l_extendedprice") - 30000) / 20000).alias("z"))
    return _rounded(analysis.columns_analysis(df, "KS", ["z"]), 6, "statistic")


_IV = """with e as (select quantile_disc({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from lineitem),
  b as (select len(list_filter(list_distinct(q), lambda x: x <= {c})) as bucket, (l_returnflag = 'R')::int as good from lineitem, e),
  g as (select bucket, greatest(sum(good), 0) as g, sum(1 - good) as b from b group by bucket), t as (select sum(g) as gg, sum(b) as bb from g)
  select '{c}' as "colName", round(sum(((case when g = 0 then 1 else g end) / gg - (case when b = 0 then 1 else b end) / bb) * ln(((case when g = 0 then 1 else g end) / gg) / ((case when b = 0 then 1 else b end) / bb))), 8) as statistic from g, t"""


@query(" union all ".join(f"select * from ({_IV.format(c=c)})" for c in ("l_extendedprice", "l_quantity")))
def iv_top_features(spark, sf_dir):
    return _rounded(analysis.columns_analysis(table(spark, sf_dir, "lineitem"), "IV", ["l_extendedprice", "l_quantity"], "l_returnflag", "R"), 8, "statistic")


def _predictions(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return df.select(F.col("quality").alias("label"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("prediction"), "n_chars", F.col("toxic"))


_PRED = "(select quality as label, case when n_chars > 800 then 1 else 0 end as prediction, n_chars from labels join documents using (doc_id))"


@query(f"""with p as {_PRED}, l as (select label, count(*) as real, sum((label = prediction)::int) as hit from p group by label),
    s as (select prediction as label, count(*) as said from p group by prediction),
    r as (select real, hit, coalesce(hit / said, 0) as p, hit / real as r from l left join s using (label)),
    a as (select sum(case when p + r > 0 then 2 * p * r / (p + r) else 0 end * real) / sum(real) as f1, sum(p * real) / sum(real) as wp, sum(r * real) / sum(real) as wr, sum(hit) / sum(real) as acc from r)
    select 'f1' as name, round(f1, 8) as value from a union all select 'weightedPrecision', round(wp, 8) from a union all select 'weightedRecall', round(wr, 8) from a union all select 'accuracy', round(acc, 8) from a""")
def classification_eval(spark, sf_dir):
    return _rounded(analysis.classification_metrics(_predictions(spark, sf_dir)), 8, "value")


@query(f"select label::double as label, prediction::double as prediction, count(*) as n from {_PRED} group by 1, 2")
def confusion_matrix(spark, sf_dir):
    return analysis.confusion(_predictions(spark, sf_dir), "label")


@query(f"""with p as {_PRED}, t as (select n_chars::double as threshold, sum(label) as p, sum(1 - label) as n from p group by 1)
    select threshold, round(sum(p) over (order by threshold desc) / sum(p) over (), 8) as tpr, round(sum(n) over (order by threshold desc) / sum(n) over (), 8) as fpr from t""")
def roc_points(spark, sf_dir):
    return _rounded(analysis.roc_points(_predictions(spark, sf_dir), "label", "n_chars"), 8, "tpr", "fpr")


@query(f"""with p as {_PRED}, t as (select n_chars::double as threshold, sum(label) as p, sum(1 - label) as n from p group by 1),
    r as (select threshold, sum(p) over (order by threshold desc) / sum(p) over () as tpr, sum(n) over (order by threshold desc) / sum(n) over () as fpr from t)
    select round(sum(a), 8) as auc from (select (fpr - coalesce(lag(fpr) over (order by threshold desc), 0)) * (tpr + coalesce(lag(tpr) over (order by threshold desc), 0)) / 2 as a from r)""")
def auc(spark, sf_dir):
    return _rounded(analysis.auc(_predictions(spark, sf_dir), "label", "n_chars"), 8, "auc")


@query("""with p as (select l_extendedprice as y, l_quantity * 1500 as x from lineitem)
    select 'mse' as name, round(avg((y - x)^2), 2) as value from p union all select 'rmse', round(sqrt(avg((y - x)^2)), 2) from p
    union all select 'r2', round(1 - sum((y - x)^2) / (var_pop(y) * count(*)), 2) from p union all select 'mae', round(avg(abs(y - x)), 2) from p""")
def regression_eval(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    return _rounded(analysis.regression_metrics(df), 2, "value")


def _scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber", F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("label"))


_EDGES = {"EF": "quantile_disc({c}, [0.2, 0.4, 0.6, 0.8])", "ED": "list_transform([1, 2, 3, 4], lambda k: min({c}) + k * (max({c}) - min({c})) / 5)"}


def _binned(c: str, method: str) -> str:
    return f"""select '{c}' as feature, len(list_filter(list_distinct(q), lambda x: x <= {c})) as bin_id, (l_linestatus = 'F')::int as label
      from lineitem, (select {_EDGES[method].format(c=c)} as q from lineitem)"""


@query(f"""with b as ({_binned("l_extendedprice", "EF")} union all {_binned("l_quantity", "EF")}), g as (select feature, bin_id, sum(label) as p, sum(1 - label) as n from b group by feature, bin_id),
    t as (select feature, sum(p) as pp, sum(n) as nn from g group by feature)
    select feature, bin_id::int as bin_id, p::bigint as p, n::bigint as n, round(p / (p + n), 8) as prate, round(ln((p / (p + n)) / (pp / nn)), 8) as woe, round((p / pp - n / nn) * ln((p / (p + n)) / (pp / nn)), 8) as iv from g join t using (feature)""")
def binning_equal_frequency(spark, sf_dir):
    df = _scored(spark, sf_dir)
    bins = scoring.fit_bins(df, ["l_extendedprice", "l_quantity"], "EF", 5)
    return _rounded(scoring.woe_table(df, bins).drop("value", "total"), 8, "prate", "woe", "iv")


@query(f"""with b as ({_binned("l_extendedprice", "ED")}), g as (select feature, bin_id, sum(label) as p, sum(1 - label) as n from b group by feature, bin_id),
    t as (select feature, sum(p) as pp, sum(n) as nn from g group by feature)
    select feature, bin_id::int as bin_id, p::bigint as p, n::bigint as n, round(ln((p / pp) / (n / nn)), 8) as woe, round((p / pp - n / nn) * ln((p / pp) / (n / nn)), 8) as iv from g join t using (feature)""")
def binning_equal_width(spark, sf_dir):
    df = _scored(spark, sf_dir)
    bins = scoring.fit_bins(df, ["l_extendedprice"], "ED", 5)
    return _rounded(scoring.woe_table(df, bins, woe="odds").select("feature", "bin_id", "p", "n", "woe", "iv"), 8, "woe", "iv")


@query("""with g as (select l_returnflag as v, count(*) as c, sum((l_linestatus = 'F')::int) as p, sum((l_linestatus <> 'F')::int) as n from lineitem group by 1),
    t as (select sum(p) as pp, sum(n) as nn from g)
    select '[' || v || ']' as value, (row_number() over (order by c desc, v) - 1)::int as bin_id, p::bigint as p, n::bigint as n, round((p / pp - n / nn) * ln((p / (p + n)) / (pp / nn)), 8) as iv from g, t""")
def binning_categories(spark, sf_dir):
    df = _scored(spark, sf_dir)
    bins = scoring.fit_bins(df, ["l_returnflag"])
    return _rounded(scoring.woe_table(df, bins).select("value", "bin_id", "p", "n", "iv"), 8, "iv")


@query(f"""with b as ({_binned("l_extendedprice", "EF")}) select bin_id::int as bin_id, count(*) as n from b group by 1""")
def binning_predict(spark, sf_dir):
    df = _scored(spark, sf_dir)
    bins = scoring.fit_bins(df, ["l_extendedprice"], "EF", 5)
    return scoring.bin_rows(df, bins).groupBy(F.col("l_extendedprice_output").alias("bin_id")).agg(F.count("*").alias("n"))


@query("""with e as (select quantile_disc(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) as q from lineitem), b as (select len(list_filter(q, lambda x: x <= l_extendedprice)) as bin_id, l_returnflag from lineitem, e),
    x as (select bin_id, count(*) as e, count(*) filter (l_returnflag = 'A') as a from b group by bin_id), t as (select sum(e) as ee, sum(a) as aa from x)
    select bin_id::int as bin_id, round(a / aa, 8) as actual, round(e / ee, 8) as expected, round((a / aa - e / ee) * ln((a / aa) / (e / ee)), 8) as psi from x, t""")
def psi_by_bin(spark, sf_dir):
    df = _scored(spark, sf_dir)
    bins = scoring.fit_bins(df, ["l_extendedprice"], "EF", 5)
    out = scoring.population_stability(df, df.where("l_returnflag = 'A'"), bins)
    return _rounded(out.select("bin_id", "actual", "expected", "psi"), 8, "actual", "expected", "psi")


@query("select o_orderkey, round(800 - 25 * ln(50) / ln(2) + 25 / ln(2) * ln(p / (1 - p)), 6) as score from (select o_orderkey, 0.01 + (o_orderkey % 97) / 100.0::double as p from orders)")
def scorecard_points(spark, sf_dir):
    p = F.lit(0.01) + (F.col("o_orderkey") % 97) / F.lit(100.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scoring.card_score(p), 6).alias("score"))


@query()
def scorecard_model(spark, sf_dir):
    df = _scored(spark, sf_dir)
    bins = scoring.fit_bins(df, ["l_extendedprice", "l_quantity"], "EF", 5)
    card = scoring.fit_score_card(df, bins, scoring.woe_table(df, bins))
    return card.predict(df).select("label", F.round("predictedScore", 4).alias("score")).groupBy("label", "score").agg(F.count("*").alias("n"))


@query("""select o_custkey, sum(o_totalprice) filter (o_orderstatus = 'F') as F, sum(o_totalprice) filter (o_orderstatus = 'O') as O from (select o_custkey, o_orderstatus, round(o_totalprice) as o_totalprice from orders) group by o_custkey""")
def pivot_sum(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.round("o_totalprice"))
    return columns.pivot_sum(df, ["o_custkey"], "o_orderstatus", "o_totalprice", ["F", "O"])


@query("select l_orderkey, l_linenumber, l_partkey, m.n as measure, m.v as value from (select l_orderkey, l_linenumber, l_partkey, unnest([{'n': 'l_discount', 'v': l_discount}, {'n': 'l_tax', 'v': l_tax}]) as m from lineitem)")
def unpivot(spark, sf_dir):
    return columns.unpivot(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"], "measure", "value")


@query("select p_type as value, (row_number() over (order by count(*) desc, p_type) - 1)::int as index from part group by p_type")
def onehot_index(spark, sf_dir):
    return columns.category_index(table(spark, sf_dir, "part"), "p_type")


@query("select o_orderkey, o_custkey, o_orderdate from orders")
def drop_columns(spark, sf_dir):
    return columns.drop_columns(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderstatus", "o_orderpriority"])


@query("select row_number() over (order by c_name) + 99 as \"Unique_ID\", c_custkey from customer")
def row_ids(spark, sf_dir):
    return columns.unique_identifier(table(spark, sf_dir, "customer"), start=100, order_by=["c_name"]).select("Unique_ID", "c_custkey")


@query("select range as id from range(1000)")
def build_range(spark, sf_dir):
    return analysis.build_range(spark, 1000)


@query("select try_cast(trim(k) as bigint) as k, try_cast(trim(p) as double) as p from (select ' ' || c_custkey::varchar || ' ' as k, case when c_custkey % 3 = 0 then 'x' else (c_custkey % 100)::varchar end as p from customer)")
def digital_convert(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    dest = customer.select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("k"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise((F.col("c_custkey") % 100).cast("string")).alias("p"))
    return columns.convert_digital_columns(dest, customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("p")))


@query("select l_orderkey, l_linenumber, l_partkey, round(coalesce(nullif(l_discount, 0), (select avg(nullif(l_discount, 0)) from lineitem)), 6) as d from lineitem")
def fill_mean(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return _rounded(columns.fill_missing(df, "mean", ["d"]), 6, "d")


@query("select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), (select o_orderstatus from orders where o_orderstatus <> 'P' group by 1 order by count(*) desc, 1 limit 1)) as s from orders")
def fill_mode(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return columns.fill_missing(df, "mode", ["s"])


@query("select o_orderkey, o_orderstatus as s from orders where o_orderstatus <> 'P'")
def drop_missing(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return columns.fill_missing(df, "drop")


@query("select * from (select l_orderkey, nullif(l_discount, 0) as d, nullif(l_tax, 0) as t from lineitem) where d is null or t is null")
def assert_not_null(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"))
    return asserts.failing_not_null(df, ["d", "t"])


@query("""select k as "ConflictKey" from (select 'o_orderkey' as k, count(o_orderkey) > count(distinct o_orderkey) as bad from orders union all select 'o_custkey', count(o_custkey) > count(distinct o_custkey) from orders) where bad""")
def assert_unique_key(spark, sf_dir):
    return asserts.conflicting_keys(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])


@query("select l_orderkey, l_linenumber, l_partkey from (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) where n > 1")
def assert_unique_keys(spark, sf_dir):
    return asserts.conflicting_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey from orders where not (o_totalprice > 1000 and o_orderstatus <> 'P')")
def assert_expression(spark, sf_dir):
    return asserts.failing_condition(table(spark, sf_dir, "orders"), asserts.to_sql(":o_totalprice > 1000 && :o_orderstatus <> 'P'")).select("o_orderkey")


@query("""select event_id, '{"type":"' || event_type || '"}' as param from events""")
def llm_param(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get(prompts.llm_param(F.create_map(F.lit("type"), F.col("event_type"))), F.lit(0)).alias("param"))


@query("select conv_id, turn, 'As ' || role || ': ' || text || ' (' || role || ')' as prompt from conversations")
def llm_prompt(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", prompts.llm_prompt(F.lit("As {0}: {1} ({0})"), F.array("role", "text")).alias("prompt"))


@query("select event_id, event_type as output from events")
def llm_result(spark, sf_dir):
    answers = F.array(F.to_json(F.struct(F.col("event_type").alias("output"), F.col("value"))))
    return table(spark, sf_dir, "events").select("event_id", prompts.llm_result(answers).alias("output"))


_CUT = r"""case when length(text) - {at} > 400 then coalesce(nullif(length(regexp_extract(substr(text, {at} + 1, 400), '(?s)^.*(?:\n|\. )')), 0), 400) else length(text) - {at} end"""


@query(f"""with recursive c as (select doc_id, text, 0 as start, 0 as content_id, {_CUT.format(at="0")} as n_chars from documents where text is not null
    union all select doc_id, text, start + n_chars, content_id + 1, {_CUT.format(at="(start + n_chars)")} from c where start + n_chars < length(text))
    select doc_id, content_id::int as content_id, n_chars::int as n_chars from c""")
def llm_split(spark, sf_dir):
    prompts.register(spark)
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", r"explode(llm_split(text, array('\n', '. '), 400)) as c")
    return df.select("doc_id", "c.content_id", F.length("c.content").alias("n_chars"))


_CHANGE = "case when event_type = (select min(event_type) from events) then 'DELETE' else 'UPDATE' end"


@query(f"""select k, arg_max(v, (t, kind, event_id)) as v, max(t) as t, arg_max(kind, (t, kind, event_id)) as kind from (
    select user_id as k, event_id, printf('%012d', event_id) as v, floor(epoch(ts))::bigint as t, {_CHANGE} as kind from events) group by k""")
def cdc_latest(spark, sf_dir):
    last = cdc.latest_changes(_changes(spark, sf_dir), ["k"])
    return last.select(F.col("row")["k"].cast("long").alias("k"), F.col("row")["v"].alias("v"), F.col("ts").alias("t"), F.col("type").alias("kind"))


@query(f"""with c as (select k, arg_max(v, (t, kind, event_id)) as v, arg_max(kind, (t, kind, event_id)) as kind from (
    select user_id as k, event_id, printf('%012d', event_id) as v, floor(epoch(ts))::bigint as t, {_CHANGE} as kind from events) group by k)
    select c_custkey as k, coalesce(c.v, c_name) as v from customer left join c on c_custkey = c.k where c.kind is null or c.kind <> 'DELETE'
    union all select c.k, c.v from c where kind <> 'DELETE' and k not in (select c_custkey from customer)""")
def cdc_merge(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return cdc.merge_changes(target, _changes(spark, sf_dir), ["k"]).select("k", "v")


def _changes(spark, sf_dir) -> DataFrame:
    """Change events made of the events table: one event type deletes, the others update."""
    events = table(spark, sf_dir, "events")
    least = events.agg(F.min("event_type")).first()[0]
    row = F.create_map(F.lit("k"), F.col("user_id").cast("string"), F.lit("v"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return events.select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_type") == least, "DELETE").otherwise("UPDATE").alias("type"), F.array(row).alias("data")
    )


@query("select time_bucket(interval '1 day', ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def stream_tumbling(spark, sf_dir):
    return _rounded(windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", "value", "event_type"), 2, "total")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, sf_dir):
    return windows.deduplicated(table(spark, sf_dir, "events"), "ts", None, "user_id", "event_type").select("user_id", "event_type")


@query("select event_id from events where ts >= (select max(ts) from events) - interval '7 days'")
def late_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.join(F.broadcast(events.agg(F.max("ts").alias("top"))), F.col("ts") >= F.expr("top - interval 7 days")).select("event_id")


_DOT = "list_cosine_similarity(q.embedding::double[], e.embedding::double[])"


@query(f"""select query_id, vec_id, similarity from (select q.vec_id as query_id, e.vec_id, round({_DOT}, 4) as similarity,
    row_number() over (partition by q.vec_id order by round({_DOT}, 4) desc, e.vec_id) as r from embeddings q, embeddings e where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id) where r <= 5""")
def cosine_topk(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_topk(df.where("vec_id % 20 = 0"), df, k=5, places=4)


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder that all executors share, for queries that write and read again."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/catalog-{name}-{uuid.uuid4().hex}"


def _round_trip(fmt: str, where: str = "") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..context import ScriptContext

        path, ctx = _scratch(spark, fmt), ScriptContext(spark)
        ctx.publish(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "round_trip_in")
        ctx.run(f"save overwrite round_trip_in as {fmt}.`{path}` {where}; load {fmt}.`{path}` {where} as round_trip_out;")
        return ctx.run("select cast(n_nationkey as bigint) as k, n_name as name from round_trip_out as round_trip_out2;")

    return run


for _fmt, _where in (("csv", 'where header="true"'), ("json", ""), ("parquet", ""), ("orc", ""), ("delta", "")):
    QUERIES[f"source_{_fmt}"], ORACLES[f"source_{_fmt}"] = _round_trip(_fmt, _where), "select n_nationkey::bigint as k, n_name as name from nation"


@query("select c_custkey, c_mktsegment from customer")
def save_then_load(spark, sf_dir):
    from ..streaming.versioned import save_then_load as cut

    return cut(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), _scratch(spark, "cut"))


@query("select s_suppkey, s_acctbal from supplier where s_acctbal >= 0 union all select s_suppkey + 1000000, s_acctbal from supplier where s_acctbal >= 0")
def versioned_table(spark, sf_dir):
    from ..streaming.versioned import VersionedTable

    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    own = VersionedTable(spark, _scratch(spark, "versions"))
    own.write(rows)
    own.write(rows.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000), "append")
    own.delete("s_acctbal < 0")
    return own.read()


@query(f"""select k, arg_max(v, (t, kind, event_id)) as v from (
    select user_id as k, event_id, printf('%012d', event_id) as v, floor(epoch(ts))::bigint as t, {_CHANGE} as kind from events) group by k having arg_max(kind, (t, kind, event_id)) <> 'DELETE'""")
def cdc_stream(spark, sf_dir):
    """Change events as files, deletes included, streamed into a versioned table."""
    from ..streaming.versioned import VersionedTable

    changes = _changes(spark, sf_dir)
    event = F.to_json(F.struct(F.lit("db").alias("database"), F.lit("t").alias("table"), "type", "ts", "data"))
    path = _scratch(spark, "stream")
    changes.select(event.alias("value")).write.text(f"{path}/in")
    target = VersionedTable(spark, f"{path}/t")
    target.write(spark.createDataFrame([], "k long, v string"))
    cdc.stream_into(spark.readStream.text(f"{path}/in"), target.path, "db.t", ["k"], f"{path}/checkpoint").awaitTermination()
    return target.read().select("k", "v")


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def stream_files(spark, sf_dir):
    """The tumbling window over events that arrive as files, with a watermark, a file a batch."""
    path = _scratch(spark, "windows")
    events = table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = windows.tumbling(stream, "ts", "1 day", "value", "event_type", lateness="40 days")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    out.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _rounded(spark.read.parquet(f"{path}/out"), 2, "total").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select 'o_totalprice' as \"columnName\", round(max(o_totalprice), 2) as \"max\", count(*) as n from orders")
def script_summary(spark, sf_dir):
    """A script: load, select, run and commands."""
    from ..context import ScriptContext

    ctx = ScriptContext(spark)
    return ctx.run(f"""
        set floor="0";
        load parquet.`{sf_dir}/orders.parquet` as script_orders;
        !assertCondition script_orders 'o_totalprice > 0';
        select o_totalprice from script_orders where o_totalprice > ${{floor}} as script_prices;
        run script_prices as DataSummary.`` where metrics="max,totalCount" and approxThreshold="-1" as script_profile;
        select columnName, round(cast(max as double), 2) as max, cast(totalCount as bigint) as n from script_profile as script_out;
    """)


from . import scripted  # noqa: E402, F401  registers its queries here
