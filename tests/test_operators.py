import pytest
from pyspark.sql import functions as F

from tessera.operators import asserts, columns, scoring


@pytest.fixture(scope="module")
def scores(spark):
    rows = [("elena", 57, 110, 433000, 0), ("abe", 50, 120, 433000, 1), ("AA", 10, 130, 432000, 0), ("cc", 40, 100, 434000, 1), ("", 30, 150, 434000, 0), ("bb", 21, 160, 533000, 1)] * 4
    return spark.createDataFrame(rows, "name string, age long, phone long, income long, label long")


def test_bins_count_every_row(scores):
    bins = scoring.fit_bins(scores, ["age", "income", "name"], "EF", 3)
    table = scoring.woe_table(scores, bins, smoothing=0.5).groupBy("feature").agg(F.sum("total").alias("n"), F.sum("iv").alias("iv")).collect()
    assert {r["feature"]: r["n"] for r in table} == {"age": 24, "income": 24, "name": 24}
    odds = scoring.woe_table(scores, bins, woe="odds", smoothing=0.5).groupBy("feature").agg(F.sum("iv").alias("iv")).collect()
    assert all(r["iv"] >= -1e-9 for r in odds)


def test_equal_width_edges_and_labels(scores):
    (bins,) = scoring.fit_bins(scores, ["age"], "ED", 4)
    assert bins.edges == [21.75, 33.5, 45.25]
    assert [bins.label(k) for k in range(4)] == ["(-Infinity, 21.75)", "[21.75, 33.5)", "[33.5, 45.25)", "[45.25, Infinity)"]


def test_bins_are_kept(spark, scores, tmp_path):
    bins = scoring.fit_bins(scores, ["age", "name"])
    scoring.save_bins(spark, bins, str(tmp_path))
    assert scoring.load_bins(spark, str(tmp_path)) == bins


def test_stability_of_a_table_with_itself(scores):
    bins = scoring.fit_bins(scores, ["age"], "EF", 3)
    assert {r["psi"] for r in scoring.population_stability(scores, scores, bins).collect()} == {0.0}


def test_score_card_scores(spark, scores, tmp_path):
    bins = scoring.fit_bins(scores, ["age", "income"], "EF", 2)
    card = scoring.fit_score_card(scores, bins, scoring.woe_table(scores, bins, smoothing=0.5), pdo=20)
    out = card.predict(scores)
    assert out.where("predictedScore is null or probability not between 0 and 1").count() == 0
    card.save(spark, str(tmp_path))
    assert scoring.ScoreCard.load(spark, str(tmp_path)).predict(scores).collect() == out.collect()


def test_identifiers(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "v string").repartition(3)
    assert sorted(r["id"] for r in columns.unique_identifier(df, column="id", start="x").collect()) == [1, 2, 3]
    replaced = columns.unique_identifier(df, "replace", "v", 100)
    assert sorted(r["v"] for r in replaced.collect()) == [100, 101, 102]
    with pytest.raises(ValueError):
        columns.unique_identifier(df, "other")
    with pytest.raises(ValueError):
        columns.unique_identifier(df, "new", "v")


def test_missing_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, None)], "x int, s string")
    assert columns.fill_missing(df, "mean", ["x"]).where("x = 2.0").count() == 2
    assert columns.fill_missing(df, "mode", ["s"]).where("s = 'a'").count() == 3
    assert columns.fill_missing(df, "mode", ["s"], compat="max").where("s = 'b'").count() == 2
    assert columns.fill_missing(df, "drop").count() == 3
    grid = spark.createDataFrame([(float(k), 2.0 * k if k % 5 else None) for k in range(30)], "a double, b double")
    filled = columns.fill_missing(grid, "randomforest", ["b"])
    assert filled.count() == 30 and filled.where("b is null").count() == 0


def test_pivot_and_back(spark):
    df = spark.createDataFrame([("x", "m", 1), ("x", "n", 2), ("y", "m", 3), ("y", "n", 4)], "k string, c string, v long")
    wide = columns.pivot_sum(df, ["k"], "c", "v")
    back = columns.unpivot(wide, ["k"], ["m", "n"], "c", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_samples_and_partitions(spark):
    df = spark.range(1000)
    assert columns.take_sample(df).count() == 1000
    assert columns.take_sample(df, size=50).count() == 50
    assert columns.repartition_table(df, 3, "range", ["id"]).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        columns.repartition_table(df, 3, "range")
    made = columns.sample_dataset(spark, size=10, features_size=4)
    assert made.collect() == columns.sample_dataset(spark, size=10, features_size=4).collect()
    with pytest.raises(ValueError):
        columns.sample_dataset(spark, ["other"])


def test_onehot(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    out, _ = columns.onehot(df, ["c"])
    assert [(r["c_index"], r["c_output"].size) for r in out.collect()] == [(0.0, 2), (1.0, 2), (0.0, 2)]


def test_asserts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    assert asserts.failing_condition(df, "v = 'a'").count() == 2
    assert asserts.failing_not_null(df, ["k", "v"]).count() == 1
    assert [r[0] for r in asserts.conflicting_keys(df, ["k", "v"]).collect()] == ["k"]
    assert asserts.conflicting_rows(df, ["k"]).count() == 2
    nulls = spark.createDataFrame([(None, 1), (None, 1), (1, None), (1, None), (1, 2)], "a int, b int")
    assert asserts.conflicting_rows(nulls, ["a", "b"]).count() == 4
    asserts.require(df, ":k >= 1 && :k < 3", "no")
    for check in (
        lambda: asserts.require(df, ":k == 1", "not one"), lambda: asserts.require(df, ":z == 1", "x"), lambda: asserts.require_condition(df, "v is not null"),
        lambda: asserts.require_not_null(df, ["v"]), lambda: asserts.require_unique_key(df, ["k"]), lambda: asserts.require_unique_keys(df, ["k"]), lambda: asserts.throw("stop"),
    ):
        with pytest.raises(asserts.AssertionFailed):
            check()
