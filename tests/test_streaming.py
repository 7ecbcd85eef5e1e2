import json

import pytest

from tessera.streaming import cdc, jobs, windows
from tessera.streaming.versioned import VersionedTable, save_then_load


def event(kind, ts, *rows, sql=None):
    return (json.dumps({"database": "db", "table": "t", "type": kind, "ts": ts, "sql": sql, "pkNames": ["id"], "data": list(rows)}),)


def events(spark, *items):
    return cdc.parse_events(spark.createDataFrame(list(items), "value string"), "db.t")


@pytest.fixture
def table(spark, tmp_path):
    out = VersionedTable(spark, str(tmp_path / "t"))
    out.write(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string"))
    return out


def rows(df):
    return sorted((r["id"], r["v"]) for r in df.collect())


def test_merge(spark, table):
    batch = events(spark, event("UPDATE", 5, {"id": "1", "v": "x"}), event("DELETE", 6, {"id": "2"}), event("INSERT", 7, {"id": "9", "v": "n"}), event("INSERT", 5, {"id": "1", "v": "old"}))
    once = cdc.merge_changes(table.read(), batch, ["id"])
    assert rows(once) == [(1, "x"), (3, "c"), (9, "n")]
    stale = events(spark, event("UPDATE", 1, {"id": "1", "v": "stale"}))
    assert rows(cdc.merge_changes(once, stale, ["id"])) == rows(once)
    assert (1, "stale") in rows(cdc.merge_changes(once, stale, ["id"], only_newer=False))


def test_schema_changes_split_a_batch(spark, table):
    batch = events(
        spark, event("INSERT", 1, {"id": "4", "v": "d"}), event("ALTER", 2, sql="ALTER TABLE `db`.`t` ADD COLUMN n decimal(10,2) DEFAULT '1.5', CHANGE v w varchar(10)"), event("UPDATE", 3, {"id": "4", "w": "e", "n": "7"}),
    )
    out = cdc.apply_batch(table, batch, ["id"])
    assert sorted((r["id"], r["w"], float(r["n"])) for r in out.collect()) == [(1, "a", 1.5), (2, "b", 1.5), (3, "c", 1.5), (4, "e", 7.0)]
    assert cdc.apply_batch(table, events(spark, event("TRUNCATE", 9, sql="truncate table t")), ["id"]).count() == 0


def test_schema_statements(spark):
    df = spark.createDataFrame([("5",)], "a string")
    assert cdc.apply_ddl(df, "alter table t modify a int unsigned").schema["a"].dataType.simpleString() == "bigint"
    assert cdc.apply_ddl(cdc.apply_ddl(df, "alter table t add b int"), "alter table t drop column b").columns == ["a"]
    with pytest.raises(ValueError):
        cdc.apply_ddl(df, "select 1")
    kind = lambda text: cdc.apply_ddl(df, f"alter table t modify a {text}").schema["a"].dataType.simpleString()
    assert kind("int(10)  unsigned") == "bigint" and kind("bigint unsigned default 0") == "decimal(20,0)" and kind("decimal (12, 3) not null") == "decimal(12,3)"
    wide = cdc.apply_ddl(df, "alter table `t` add column b int default 3 first, add c varchar(3) comment 'x after a' after b, add index k (a), rename column a to z")
    assert wide.columns == ["b", "c", "z"] and [tuple(r) for r in wide.collect()] == [(3, None, "5")]
    assert cdc.apply_ddl(df, "alter table t drop primary key, engine=InnoDB, rename to u").columns == ["a"]


@pytest.mark.parametrize(("mysql", "spark_type"), [("tinyint(1)", "boolean"), ("int unsigned", "bigint"), ("decimal(12,3)", "decimal(12,3)"), ("varchar(20)", "string"), ("bigint(20) unsigned", "decimal(20,0)"), ("datetime", "timestamp")])
def test_mysql_types(mysql, spark_type):
    assert cdc.spark_type(mysql) == spark_type


def test_versions(spark, table):
    table.write(spark.createDataFrame([(4, "d")], "id long, v string"), "append")
    assert rows(table.read()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert rows(table.read(0)) == [(1, "a"), (2, "b"), (3, "c")]
    table.delete("id > 2")
    assert rows(table.read()) == [(1, "a"), (2, "b")]
    assert [r["name"] for r in table.desc().collect()] == ["id", "v"]
    assert table.vacuum(0) and rows(table.read()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        table.read(0)
    table.truncate()
    assert table.read().count() == 0
    table.remove()
    assert not table.exists()


def test_lineage_cut(spark, tmp_path):
    assert rows(save_then_load(spark.createDataFrame([(1, "a")], "id long, v string"), str(tmp_path / "s"))) == [(1, "a")]


def test_stream_merges_like_a_batch(spark, table, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(e[0] for e in (event("UPDATE", 5, {"id": "1", "v": "x"}), event("INSERT", 7, {"id": "9", "v": "n"}))))
    stream = spark.readStream.text(str(folder))
    cdc.stream_into(stream, table.path, "db.t", ["id"], str(tmp_path / "cp")).awaitTermination(60)
    assert rows(table.read()) == [(1, "x"), (2, "b"), (3, "c"), (9, "n")]


def test_stream_windows_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 {h:02d}:10:00", "u", float(h)) for h in range(6)], "t string, u string, v double").selectExpr("cast(t as timestamp) as ts", "u", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "2 hours", "v", "u", lateness="1 hour")
    query = stream.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("wins").collect())) == sorted(map(tuple, windows.tumbling(df, "ts", "2 hours", "v", "u").collect()))


def test_jobs(spark, tmp_path):
    ran = []
    own = jobs.StreamJobs(jobs.Registry(spark, str(tmp_path / "jobs")), lambda s: ran.append(s) if s != "bad" else 1 / 0)
    own.persist("a/b", "x")
    own.persist("c", "bad")
    assert own.start_all() == {"a/b": "started", "c": "failed: division by zero"} and ran == ["x"]
    own.remove("c")
    assert [r["name"] for r in own.list().collect()] == ["a/b"]
