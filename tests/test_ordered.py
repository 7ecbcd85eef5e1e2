"""Running sums, ranks and percentiles over ranges of an order equal those of one sorted list."""

import math
import random
from collections import Counter

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.operators import analysis, columns, profiling
from tessera.operators.ordered import pairs_above, running_sums
from tessera.plans import catalog


def rows(n=3000, seed=3):
    own = random.Random(seed)
    # A third of all rows share one key; some have none.
    return [(k, None if own.random() < 0.02 else 7 if own.random() < 1 / 3 else own.randrange(500), own.randrange(10)) for k in range(n)]


@pytest.mark.parametrize("ranges", [1, 2, 13, 200])
def test_running_sums(spark, ranges):
    data = rows()
    df = spark.createDataFrame(data, "id int, k int, v int").repartition(5)
    out = running_sums(df, [F.col("k"), F.col("id")], {"s": F.col("v"), "n": F.lit(1)}, ranges).collect()
    s, want = 0, {}
    for n, (id_, k, v) in enumerate(sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1):
        s += v
        want[id_] = (s, n)
    assert {r["id"]: (r["s"], r["n"]) for r in out} == want


def test_running_sums_of_nothing(spark):
    df = spark.createDataFrame([], "k int, v int")
    assert running_sums(df, [F.col("k")], {"s": F.col("v")}, 4).collect() == []


def test_running_sums_beside_columns_of_its_names(spark):
    df = spark.createDataFrame([(2, 1, "a"), (1, 1, "b")], "__order int, __range int, __base string")
    out = running_sums(df, [F.col("__order")], {"s": F.lit(1)}, 3).orderBy("s").collect()
    assert [tuple(r) for r in out] == [(1, 1, "b", 1), (2, 1, "a", 2)]


def test_no_task_orders_a_whole_table(spark):
    df = spark.range(1000)
    numbered = columns.unique_identifier(df, order_by=["id"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    # Only the few totals of the ranges are in one partition, never the rows.
    windows = [x for x in plan.splitlines() if "Window [" in x and "row_number" in x]
    assert not windows and "__range" in plan
    assert [r["Unique_ID"] for r in numbered.orderBy("id").collect()] == list(range(1, 1001))


def test_ids_of_equal_rows_and_starts(spark):
    df = spark.createDataFrame([("x",)] * 500 + [("a",)], "v string")
    got = sorted((r["Unique_ID"], r["v"]) for r in columns.unique_identifier(df, order_by=["v"], start=10).collect())
    assert [k for k, _ in got] == list(range(10, 511)) and got[0][1] == "a"


def percentile(values, p, method):
    n = len(values)
    rank = 1 + p * (n - 1) if method == "interpolated" else min(max(p * (n + 1), 1), n)
    low, high = values[math.floor(rank) - 1], values[math.ceil(rank) - 1]
    return low + (rank - math.floor(rank)) * (high - low)


@pytest.mark.parametrize("method", ["interpolated", "nist"])
def test_exact_percentiles(spark, method):
    data = [(float(v) if v is not None else None, k * 3, None) for k, v, _ in rows(700)]
    df = spark.createDataFrame([*data, (float("nan"), 5, None)], "a double, b long, c double")
    points = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = dict(profiling.exact_percentiles(df, ["a", "b", "c"], points, method).collect())
    for k, c in enumerate("ab"):
        values = sorted([r[k] for r in data if r[k] is not None] + ([5] if c == "b" else []))
        assert got[c] == pytest.approx([percentile(values, p, method) for p in points])
    assert "c" not in got


def test_roc_with_ties_and_missing_scores(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, None)]
    df = spark.createDataFrame(data, "label int, score double")
    got = [(r["threshold"], round(r["tpr"], 6), r["fpr"]) for r in sorted(analysis.roc_points(df, "label", "score").collect(), key=lambda r: (r["tpr"], r["fpr"]))]
    assert got == [(0.9, 0.333333, 0.5), (0.5, 0.666667, 0.5), (0.1, 0.666667, 1.0), (None, 1.0, 1.0)]
    # Trapezoids between (0, 0) and these points.
    assert analysis.auc(df, "label", "score").first()["auc"] == pytest.approx(0.5 * (1 / 3) / 2 + 0.5 * 2 / 3)


def tables(folder, part, supplier):
    con = duckdb.connect()
    for name, columns_, data in (("part", "p_partkey bigint, p_retailprice double", part), ("supplier", "s_suppkey bigint, s_acctbal double", supplier)):
        con.execute(f"create table {name} ({columns_})")
        if data:
            con.executemany(f"insert into {name} values (?, ?)", data)
        con.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    return con


def odd_values(n, own):
    return [own.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5.0, own.randrange(-40, 40) / 4, own.uniform(-9, 9)]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_theta_join_of_odd_values(spark, tmp_path, seed):
    own = random.Random(seed)
    # Keys are repeated or missing, and one key has many rows of one price.
    part = [(own.choice([None, *range(150)]), v) for v in odd_values(400, own)] + [(7, 5.0)] * 300
    con = tables(tmp_path, part, list(enumerate(odd_values(200, own))))
    want = con.execute(catalog.ORACLES["theta_join"]).fetchall()
    got = catalog.QUERIES["theta_join"](spark, str(tmp_path))
    assert got.dtypes == [("p_partkey", "bigint"), ("n", "bigint")]
    assert Counter(map(tuple, got.collect())) == Counter(want) and len(want) > 100


@pytest.mark.parametrize(("part", "supplier"), [([], [(1, 2.0)]), ([(1, 2.0)], []), ([(1, 2.0)], [(1, 2.0), (2, None), (3, 3.0)])])
def test_theta_join_without_pairs(spark, tmp_path, part, supplier):
    tables(tmp_path, part, supplier)
    assert catalog.QUERIES["theta_join"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("ranges", [1, 2, 50])
def test_pairs_above_over_ranges(spark, ranges):
    own = random.Random(ranges)
    left, right = [(k, own.randrange(300)) for k in range(800)], [(own.randrange(300),) for _ in range(500)]
    out = pairs_above(spark.createDataFrame(left, "at int, side int"), "at", "side", spark.createDataFrame(right, "n int"), "n", ranges)
    assert {r["at"]: r["n"] for r in out.collect()} == {k: n for k, v in left if (n := sum(x < v for (x,) in right))}


def test_theta_join_forms_no_pairs(spark):
    # All pairs of 60 times sf0.1 are 72 billion: no join may compare values of the two tables.
    plan = catalog.QUERIES["theta_join"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x or "CartesianProduct" in x]
    assert joins and not [x for x in joins if "p_retailprice" in x or "s_acctbal" in x]
