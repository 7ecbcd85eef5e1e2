import datetime as dt

import pytest

from tessera.operators import analysis, profiling

WHEN = dt.datetime(2021, 3, 8, 18)
PEOPLE = [("elena", 57, "433000"), ("abe", 50, "433000"), ("AA", 10, "432000"), ("cc", 40, "433000"), ("", 30, "434000"), ("bb", 21, "533000")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(*p, WHEN) for p in PEOPLE], "name string, age int, income string, date timestamp")


def test_summary_of_people(people):
    rows = [",".join(r) for r in profiling.data_summary(people, profiling.METRICS).collect()]
    assert rows == [
        "name,1,,,,0.1667,5,string,elena,5,,AA,0,5,0.0,,6,,,1.0,5,1,",
        "age,2,23.25,35.0,47.5,0.0,4,integer,57.0,,34.67,10.0,,6,0.0,-0.11,6,17.77,7.26,1.0,0,1,",
        "income,3,,,,0.0,6,string,533000.0,6,,432000.0,6,6,0.0,,6,,,0.6667,4,0,433000.0",
        "date,4,,,,0.0,8,timestamp,2021-03-08 18:00:00,,,2021-03-08 18:00:00,,6,0.0,,6,,,0.1667,1,0,2021-03-08 18:00:00",
    ]


def test_summary_of_nan_and_void(spark):
    nan = float("nan")
    df = spark.createDataFrame([(110.0, None, True), (120.0, None, True), (nan, None, False)], "f float, extra void, b boolean")
    rows = {r["columnName"]: r for r in profiling.data_summary(df, profiling.METRICS).collect()}
    assert (rows["f"]["nonNullCount"], rows["f"]["nullValueRatio"]) == ("2", "0.3333")
    assert (rows["extra"]["dataType"], rows["extra"]["nonNullCount"], rows["extra"]["nullValueRatio"], rows["extra"]["uniqueValueRatio"]) == ("void", "0", "1.0", "0.0")
    assert (rows["b"]["max"], rows["b"]["min"], rows["b"]["mode"], rows["b"]["categoryCount"]) == ("true", "false", "true", "2")


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert profiling.data_summary(df).count() == 0
    with pytest.raises(ValueError):
        profiling.data_summary(spark.createDataFrame([(1,)], "`a.b` int"))
    with pytest.raises(ValueError):
        profiling.data_summary(df, ["nonsense"])


def test_other_percentiles_and_modes(spark, people):
    favourite = spark.createDataFrame([(57,), (57,), (57,), (0,), (-1,), (57,)], "n int")
    # Ranks 1.75, 3.5 and 5.25 of -1, 0, 57, 57, 57, 57.
    assert tuple(profiling.data_summary(favourite, ["%25", "median", "%75"], percentile_method="nist").first())[2:] == ("-0.25", "57.0", "57.0")
    assert [r["mode"] for r in profiling.data_summary(people.select("name"), ["mode"], mode_format="auto").collect()] == ["AA"]
    with pytest.raises(ValueError):
        profiling.data_summary(people, percentile_method="other")


def test_estimates_beyond_the_threshold(people):
    exact = profiling.data_summary(people, ["mean", "uniqueValueRatio"]).collect()
    near = profiling.data_summary(people, ["mean", "uniqueValueRatio"], approx_threshold=2).collect()
    assert [r["mean"] for r in exact] == [r["mean"] for r in near]


def test_descriptive_metrics(people):
    rows = dict(profiling.descriptive_metrics_json(people.select("name", "income")).collect())
    assert rows["income"] == '[{"432000" : 1}, {"433000" : 3}, {"434000" : 1}, {"533000" : 1}]'
    assert rows["name"] == '[{"AA" : 1}, {"abe" : 1}, {"bb" : 1}, {"cc" : 1}, {"elena" : 1}]'
    with pytest.raises(ValueError):
        profiling.descriptive_metrics(people, 0)


@pytest.mark.parametrize(
    ("value", "pattern", "runs"),
    [
        ("AA", "AA", "A(2)"), ("elenA我的", "aaaaAAA", "a(4)A(3)"), ("我哎abe", "AAaaa", "A(2)a(3)"), ("cc", "aa", "a(2)"),
        ("AAAAAA,A,AA", "AAAAAA,A,AA", "A(6),A,A(2)"), ("Abc.中文字符#123.01/abc中文", "Aaa.AAAA#999.99/aaaAA", "Aa(2).A(4)#9(3).9(2)/a(3)A(2)"),
    ],
)
def test_patterns(spark, value, pattern, runs):
    df = spark.createDataFrame([(value,), (None,), (" ",)], "s string")
    row = profiling.pattern_distribution(df).first()
    assert (row["pattern"], row["alternativePattern"], row["n"], row["ratio"], row["totalCount"]) == (pattern, runs, 1, 1.0, 1)


def test_pattern_of_empty_column(spark):
    df = spark.createDataFrame([(None,), ("",)], "s string")
    assert profiling.pattern_distribution_json(df).first()["patternDistribution"] == "{}"


def test_columns_analysis_refuses(people):
    with pytest.raises(ValueError):
        analysis.columns_analysis(people, "iv", ["age"])
    with pytest.raises(ValueError):
        analysis.columns_analysis(people, "IV", ["age"])
