import json

import pytest

from tessera.admin.auth import AccessDenied, Policy, PolicyStore, Use
from tessera.admin.errors import Renderer
from tessera.admin.suggest import suggest
from tessera.context import ScriptContext, expand_include
from tessera.ml import vector_store
from tessera.operators.asserts import AssertionFailed
from tessera.registry import COMMANDS, OPERATORS
from tessera.script import hints
from tessera.script.parser import ScriptError, expand_command, parse, split_statements


@pytest.fixture
def ctx(spark, tmp_path):
    out = ScriptContext(spark)
    out.variables["metaPath"] = str(tmp_path)
    return out


PEOPLE = """
set rows='''
{"name":"elena","age":57,"label":1}
{"name":"abe","age":50,"label":0}
{"name":"cc","age":10,"label":1}
''';
load jsonStr.`rows` as people; -- three of them
"""


def test_statements_keep_strings_whole():
    assert split_statements("select ';' as a as t; -- c;d\n!sh 'a;b';") == ["select ';' as a as t", "!sh 'a;b'"]
    s = parse("load csv.`/a b/c` where header=\"true\" and `x.y`='1' as t")
    assert (s.format, s.path, s.options, s.output) == ("csv", "/a b/c", {"header": "true", "x.y": "1"}, "t")
    s = parse("save overwrite t as parquet.`/p` where a=\"b\" partitionBy c,d")
    assert (s.mode, s.table, s.path, s.options, s.args) == ("overwrite", "t", "/p", {"a": "b"}, ["c", "d"])
    s = parse("run t as X.`` where fitParam.0.maxDepth=\"3\" as o")
    assert s.options == {"fitParam.0.maxDepth": "3"} and s.output == "o"
    for bad in ("select 1", "load csv.`x`", "jump high"):
        with pytest.raises(ScriptError):
            parse(bad)


def test_command_places():
    assert expand_command("run {3} as X.`` where a='{0}' and b='{9:none}' and p='''{:all}'''", ["drop", "a,b", "from", "t"]) == "run t as X.`` where a='drop' and b='none' and p='''[\"drop\", \"a,b\", \"from\", \"t\"]'''"


def test_summary_script(ctx):
    out = ctx.run(PEOPLE + "set n=\"2\"; select name, age, age*${n} as twice from people as p2; run p2 as DataSummary.`` where metrics=\"max,mean\" and roundAt=\"1\" as s;")
    assert [tuple(r) for r in out.collect()][1] == ("age", "2", "57.0", "39.0")


def test_defaults_do_not_override(ctx):
    ctx.run("set a=\"1\"; set a=\"2\" where type=\"defaultParam\"; set b=\"3\" where type=\"defaultParam\";")
    assert (ctx.variables["a"], ctx.variables["b"]) == ("1", "3")


def test_commands(ctx, spark):
    ctx.run(PEOPLE)
    assert ctx.run("!assertCondition people 'age > 20';").count() == 1
    assert ctx.run("!assertNotNull people 'name,age';").count() == 0
    for bad in ("!assert people ''':age > 20''' 'too young';", "!throw stop;", "!assertConditionThrow people 'age > 20';", "!assertUniqueKeyThrow people 'label';"):
        with pytest.raises(AssertionFailed):
            ctx.run(bad)
    ctx.run("!columns drop age,label from people;")
    assert spark.table("people").columns == ["name"]
    ctx.run("!dataframe build range 7 named seven; !last named again;")
    assert spark.table("again").count() == 7
    ctx.run("!approxQuantile seven id 0.5 valued q;")
    assert ctx.variables["q"] == "3.0"
    ctx.run("set inner='''select 1 as one as t1;'''; !eval inner;")
    assert spark.table("t1").first()[0] == 1
    with pytest.raises(ScriptError):
        ctx.run("!nothing;")
    with pytest.raises(PermissionError):
        ctx.run("!sh ls;")


def test_shell_when_allowed(spark):
    assert [r[0] for r in ScriptContext(spark, allow_shell=True).run("!sh echo hello;").collect()] == ["hello"]


def test_files_and_tables(ctx, tmp_path):
    ctx.run(PEOPLE)
    for fmt in ("csv", "json", "parquet"):
        where = 'where header="true"' if fmt == "csv" else ""
        ctx.run(f"save overwrite people as {fmt}.`{tmp_path}/{fmt}` {where}; load {fmt}.`{tmp_path}/{fmt}` {where} as back;")
        assert ctx.table("back").count() == 3
    ctx.run(f"save overwrite people as delta.`{tmp_path}/d`; save append people as delta.`{tmp_path}/d`; load delta.`{tmp_path}/d` as d;")
    assert ctx.table("d").count() == 6
    assert ctx.run(f"!deltaTable desc {tmp_path}/d;").count() == 3
    ctx.run(f"!deltaTable delete {tmp_path}/d 'age > 20';")
    assert ctx.run(f"load delta.`{tmp_path}/d` as d;").count() == 2
    assert {r["name"] for r in ctx.run(f"!ls {tmp_path};").collect()} >= {"csv", "json", "parquet", "d"}
    assert ctx.run(f"!exists {tmp_path}/none;").first()[0] == "false"
    assert ctx.run(f"!fileStatus {tmp_path}/d;").first()["isDir"]
    (tmp_path / "up.txt").write_text("x")
    ctx.run(f"!copyFromLocal {tmp_path}/up.txt {tmp_path}/up2.txt;")
    assert (tmp_path / "up2.txt").read_text() == "x"
    ctx.run(f"set tempPath=\"{tmp_path}\"; !saveThenLoad people;")
    assert ctx.table("people").count() == 3


def test_connections(ctx, tmp_path):
    ctx.run(PEOPLE + f"save overwrite people as parquet.`{tmp_path}/x`; connect parquet where mergeSchema=\"true\" as store;")
    ctx.run("!connectPersist;")
    ctx.connections.clear()
    ctx.run("!connectPersist restore;")
    assert ctx.connections["store"] == ("parquet", {"mergeSchema": "true"})
    ctx.run("set job='''select 1 as a as t;'''; !streamPersist persist job;")
    assert ctx.run("!streamPersist list;").first()["name"] == "job"


def test_binning_and_models(ctx, tmp_path):
    ctx.run(PEOPLE)
    ctx.run("select name, age, label from people union all select name, age + 1, 1 - label from people as more;")
    out = ctx.run(f"run more as Binning.`{tmp_path}/b` where selectedFeatures=\"age\" and numBucket=\"2\" as bins;")
    assert '"bin_id":0' in out.first()["Binning_Info"]
    assert "age_output" in ctx.run(f"predict more as Binning.`{tmp_path}/b` as placed;").columns
    ctx.run(f"register Binning.`{tmp_path}/b` as place;")
    assert ctx.run("select place(array('57')) as p as t;").first()[0] == [1.0]
    ctx.run(f"run more as ScoreCard.`{tmp_path}/c` where binningPath=\"{tmp_path}/b\" as scored; register ScoreCard.`{tmp_path}/c` as grade;")
    assert ctx.table("scored").where("predictedScore is null").count() == 0
    assert ctx.run(f"predict more as ScoreCard.`{tmp_path}/c` as again;").collect() == ctx.table("scored").collect()
    assert ctx.run("select grade(array('57')) as g as t;").first()[0] in (0.0, 1.0)
    ctx.run("select array(cast(age as double)) as features, label from more as vectors;")
    report = ctx.run(f"train vectors as XGBoostClassifier.`{tmp_path}/m` where fitParam.0.maxDepth=\"2\" and fitParam.1.maxDepth=\"99\" and evaluateTable=\"vectors\" as report;")
    assert [r["status"] for r in report.orderBy("algIndex").collect()] == ["success", "fail"]
    told = dict(ctx.run(f"load modelExplain.`{tmp_path}/m` where alg=\"XGBoostClassifier\" and algIndex=\"0\" as told;").collect())
    assert told["maxDepth"] == "2" and int(told["totalNumNodes"]) >= 10
    idle = ctx.run(f"train vectors as XGBoostClassifier.`{tmp_path}/i` where fitParam.0.maxDepth=\"2\" and fitParam.0.objective=\"x\" as report2;").first()
    assert (idle["status"], idle["message"]) == ("success", "without effect: objective")
    assert "prediction" in ctx.run(f"predict vectors as XGBoostClassifier.`{tmp_path}/m` as p;").columns


def test_language_model_functions(ctx):
    ctx.run("run command as LLM.`` where action=\"infer\" and pretrainedModelType=\"llama\" and udfName=\"ask\";")
    ctx.run("select llm_result(ask(get(llm_param(map('instruction', 'hi')), 0))) as a, llm_prompt('{0}-{1}', array('x', 'y')) as p, size(llm_split('hello,\\nnihao\\nnihao', array('\\n'), 5)) as n as t;")
    assert tuple(ctx.table("t").first()) == ("echo: hi", "x-y", 5)
    with pytest.raises(ValueError):
        ctx.run("run command as LLM.`` where action=\"merge\" and pretrainedModelType=\"llama\" and udfName=\"x\";")


def test_retrieval(ctx, spark):
    ctx.run("select 1 as doc_id, 'red apples grow' as text union all select 2, 'blue fish swim' as texts; run texts as LLMQABuilder.`` where table=\"qa\" as chunks;")
    ctx.run("select 0 as id, array(0D,0D,0D,0D,0D,0D,0D,1D) as vector as q; run q as Retrieval.`` where action=\"search\" and table=\"qa\" and k=\"1\" as found;")
    assert ctx.table("found").count() <= 1


def test_question_answering(ctx, spark):
    texts = [(1, "red apples grow"), (2, "blue fish swim"), (3, "")]
    ctx.publish(spark.createDataFrame(texts, "doc_id long, text string"), "texts")
    ctx.run("run texts as LLMQABuilder.`` where table=\"deployed\" as chunks;")
    ctx.publish(spark.createDataFrame([(7, "blue fish"), (8, None), (9, "red apples"), (-1, "blue fish")], "id long, question string"), "questions")
    got = {r["id"]: json.loads(r["answer"]) for r in ctx.run("run questions as LLMQADeploy.`` where table=\"deployed\" and k=\"1\" as said;").collect()}
    assert got[7] == got[-1] and got[7]["output"] == "echo: blue fish swim\n\nblue fish" and got[9]["output"] == "echo: red apples grow\n\nred apples"
    assert got[8] == {"output": "echo: \n\n", "sources": []}
    ctx.run("register LLMQADeploy.`` as ask_corpus where table=\"deployed\" and k=\"1\";")
    assert {r["id"]: json.loads(r["a"]) for r in ctx.run("select id, ask_corpus(question) as a from questions as said2;").collect()} == got
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vector_store, "DEPLOYED_BYTES", 10)
        with pytest.raises(ValueError):
            ctx.run("register LLMQADeploy.`` as ask_much where table=\"deployed\";")


def test_every_operator_tells_its_parameters(ctx):
    for name in OPERATORS:
        assert ctx.run(f"load modelParams.`{name}` as p;").count() == len(OPERATORS[name].params)
    assert "DataSummary" in ctx.run("load modelExample.`DataSummary` as e;").first()["value"]
    assert len(COMMANDS) >= 27


RULES = """
resourceView:
  - metadata: {resources: [{name: system, path: __auth_admin__}]}
    rules: [{rule: {verbs: ["*"], users: {allows: [{name: admin}]}}}]
  - metadata: {resources: [{name: file, path: "s3a://lake/orchard"}]}
    rules: [{rule: {verbs: [load], users: {allows: [{name: mara}], denies: [{name: mara}]}}}]
userView:
  - metadata: {users: [{name: otto}]}
    rules: [{rule: {resources: {denies: [{name: file, path: "s3a://pond"}]}, verbs: [load]}}]
"""


def test_rights(tmp_path, spark):
    store = PolicyStore(str(tmp_path))
    name = store.add(RULES)
    p = store.policy
    assert p.allowed("admin", Use("system", "__auth_admin__", "run")) and not p.allowed("mara", Use("system", "__auth_admin__", "run"))
    assert p.allowed("mara", Use("file", "S3A://lake/orchard/x", "load")) and not p.allowed("otto", Use("file", "s3a://lake/orchard/x", "load"))
    assert p.allowed("otto", Use("file", "s3a://lake/orchard/x", "save")) and not p.allowed("otto", Use("file", "s3a://pond/y", "load"))
    assert p.allowed("otto", Use("file", "s3a://other", "load"))
    ctx = ScriptContext(spark, "otto", p)
    with pytest.raises(AccessDenied):
        ctx.run("load parquet.`s3a://pond/y` as t;")
    assert store.delete(name) and Policy([]).allowed("otto", Use("file", "s3a://pond/y", "load"))


def test_includes():
    find = lambda kind, path: {"a": "include lib.`b`; select 1 as x as t;", "b": "set y=\"2\";"}[path]
    out = expand_include("include lib.`a`;", find)
    assert out["success"] and "include" not in out["sql"] and "set y" in out["sql"]
    assert not expand_include("include lib.`a`;", lambda k, p: "include lib.`a`;")["success"]


def test_python_cells(spark, ctx):
    cell = "#%input=ten\n#%output=twice\n#%schema=id long\ndef run(batches):\n    for b in batches:\n        yield b * 2\n"
    assert hints.read_hints(cell)[0] == {"input": "ten", "output": "twice", "schema": "id long"}
    open_ctx = ScriptContext(spark, allow_shell=True)
    spark.range(10).createOrReplaceTempView("ten")
    assert sorted(r[0] for r in hints.run_python_cell(open_ctx, cell).collect()) == list(range(0, 20, 2))
    with pytest.raises(PermissionError):
        hints.run_python_cell(ctx, cell)


def test_error_texts():
    r = Renderer([(r"parser error in .*?", "parser error")])
    assert r.format(ValueError("a parser error in line 3")) == "parser error" and r.format(ValueError("x")) == "x" and r.matches(ValueError("parser error in 3"))


def test_suggestions(ctx):
    ctx.run(PEOPLE)
    assert "select" in suggest(ctx, "sel", 0, 3)
    assert suggest(ctx, "run people as DataSum", 0, 21) == ["DataSummary"]
    assert "!assert" in suggest(ctx, "!asse", 0, 5)
    assert "people.age" in suggest(ctx, "select people.a", 0, 15)
