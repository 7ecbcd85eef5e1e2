"""Queries do their whole job: whole texts and all rows, held against brute force or SQL without a cut."""

import re

import duckdb
import pyarrow.parquet as pq
from conftest import DATA
from pyspark.sql import functions as F

from tessera.context import ScriptContext
from tessera.functions import prompts
from tessera.ml import serving
from tessera.operators import profiling
from tessera.plans import catalog


def rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def runs(text):
    classes = "".join("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" or "\u4e00" <= c <= "\u9fbb" else "9" if "0" <= c <= "9" else c for c in text)
    return re.sub(r"A{2,}|a{2,}|9{2,}", lambda m: f"{m[0][0]}({len(m[0])})", classes)


def test_run_pattern_reads_whole_texts(spark):
    df = spark.createDataFrame([("Ab 1" * 1000 + "Z" * 5000,)], "v string")
    assert df.select(profiling.run_pattern(df["v"])).first()[0] == "Aa 9" * 1000 + "A(5000)"
    assert df.select(profiling.run_pattern(df["v"], 6)).first()[0] == "Aa 9Aa"


def test_alt_pattern_of_whole_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in rows("documents")}
    assert max(map(len, texts.values())) > 1000
    got = {r["doc_id"]: r["pattern"] for r in catalog.QUERIES["alt_pattern_distribution"](spark, DATA).collect()}
    assert got == {k: runs(v) for k, v in texts.items()}


def test_alternative_patterns_of_the_distribution(spark):
    df = catalog.table(spark, DATA, "part").select("p_name", "p_type")
    got = profiling.pattern_distribution(df).collect()
    assert got and all(r["alternativePattern"] == runs(r["pattern"]) for r in got)


def test_llm_prompt_fills_in_whole_texts(spark):
    turns = rows("conversations")
    assert max(len(r["text"]) for r in turns) > 40
    want = sorted((r["conv_id"], r["turn"], f"As {r['role']}: {r['text']} ({r['role']})") for r in turns)
    assert sorted(map(tuple, catalog.QUERIES["llm_prompt"](spark, DATA).collect())) == want


def test_llm_prompt_keeps_placeholders_of_long_texts(spark):
    text = "x" * 60 + " {0} {1}"
    df = spark.createDataFrame([("user", text)], "role string, text string")
    got = df.select(prompts.llm_prompt(F.lit("As {0}: {1} ({0})"), F.array("role", "text"))).first()[0]
    assert got == f"As user: {text} (user)"


def duck(sql):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part", "supplier", "events"):
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con.execute(sql).fetchall()


def test_asof_join_of_all_lines(spark):
    want = duck("""select l_orderkey, l_linenumber, l_partkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) from lineitem
        join orders on l_suppkey = o_custkey and o_orderdate <= l_shipdate group by l_orderkey, l_linenumber, l_partkey""")
    assert len(want) > 1000
    assert sorted(map(tuple, catalog.QUERIES["asof_join"](spark, DATA).collect())) == sorted(want)


def test_theta_join_of_all_parts(spark):
    want = duck("select p_partkey, count(*) from part join supplier on p_retailprice > s_acctbal group by p_partkey")
    assert len(want) == len(rows("part"))
    assert sorted(map(tuple, catalog.QUERIES["theta_join"](spark, DATA).collect())) == sorted(want)


def test_cdc_stream_merges_deletes(spark):
    last = """select user_id as k, arg_max((event_type = (select min(event_type) from events), printf('%012d', event_id)), (floor(epoch(ts))::bigint,
        (event_type <> (select min(event_type) from events))::int, event_id)) as last from events group by user_id"""
    want = dict(duck(last))
    gone = {k for k, (deleted, _) in want.items() if deleted}
    assert gone and len(gone) < len(want)
    got = {r["k"]: r["v"] for r in catalog.QUERIES["cdc_stream"](spark, DATA).collect()}
    assert got == {k: v for k, (_, v) in want.items() if k not in gone}


def test_summary_is_exact_beyond_the_threshold(spark):
    big = "/root/testdata/sf0.1"
    got = {r["columnName"]: r for r in catalog.QUERIES["summary_compat"](spark, big).collect()}
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        want = duckdb.connect().execute(f"""select count(*), avg({c}), min({c}), max({c}), quantile_cont({c}, 0.25), quantile_cont({c}, 0.5), quantile_cont({c}, 0.75)
            from read_parquet('{big}/lineitem.parquet')""").fetchone()
        own = [float(got[c][m]) for m in ("totalCount", "mean", "min", "max", "%25", "median", "%75")]
        # The summary's numbers are texts of two places.
        assert all(abs(a - float(b)) < 0.0051 for a, b in zip(own, want)), (c, own, want)


def test_llm_actions_go_to_a_backend_that_has_them(spark, monkeypatch):
    class Tuner(serving.EchoBackend):
        def finetune(self, rows, path, options):
            return f"{path}: {rows.count()} rows"

    monkeypatch.setitem(serving.BACKENDS, "tuner", lambda options: Tuner())
    ctx = ScriptContext(spark)
    ctx.publish(spark.range(3), "tuning_rows")
    out = ctx.run("run tuning_rows as LLM.`/models/own` where action='finetune' and pretrainedModelType='sft/llama' and backend='tuner' as tuned;")
    assert out.collect()[0][:] == ("finetune", "sft/llama", "/models/own: 3 rows")
