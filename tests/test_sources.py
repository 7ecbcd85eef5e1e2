import datetime as dt
import json
import os

import pytest
from pyspark.sql import types as T

from tessera.functions.prompts import split_text, stack_calls
from tessera.ml import training
from tessera.sources import annotations, blocks, excel, hbase, http, jdbc
from tessera.viz import charts
from tessera.viz.pycode import Raw, Script


@pytest.fixture
def workbook(tmp_path):
    path = str(tmp_path / "w.xlsx")
    rows = [["elena", 57.0, True, dt.datetime(2021, 3, 8, 18), None], ["abe", 50.5, False, dt.datetime(2021, 3, 9), "x & <y>"], [None, None, None, None, None], ["AA", 10, None, None, ""]]
    excel.write_workbook(path, {"One": (["name", "age", "", "when", "name"], rows), "Two": (["k"], [[1], [2]])})
    return path


def test_excel_read(spark, workbook):
    excel.register(spark)
    df = spark.read.format("excel").option("header", "true").option("inferSchema", "true").load(workbook)
    assert df.columns == ["name0", "age", "_c2", "when", "name4"]
    assert [f.dataType for f in df.schema.fields] == [T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType(), T.StringType()]
    rows = df.collect()
    assert [r["age"] for r in rows] == [57.0, 50.5, 10.0] and rows[0]["when"] == dt.datetime(2021, 3, 8, 18) and rows[1]["name4"] == "x & <y>"
    texts = spark.read.format("excel").option("header", "false").option("dataAddress", "'One'!A2:B3").load(workbook)
    assert [tuple(r) for r in texts.collect()] == [("elena", "57"), ("abe", "50.5")]
    assert spark.read.format("excel").option("header", "true").option("sheetName", "Two").load(workbook).count() == 2
    with pytest.raises(Exception, match="header"):
        spark.read.format("excel").load(workbook).count()


def test_excel_round_trip(spark, tmp_path):
    excel.register(spark)
    df = spark.createDataFrame([(1, "a", True), (2, None, False)], "n long, s string, b boolean")
    path = str(tmp_path / "o.xlsx")
    df.coalesce(1).write.format("excel").mode("overwrite").option("header", "true").save(path)
    back = spark.read.schema(df.schema).format("excel").option("header", "true").load(path)
    assert sorted(map(tuple, back.collect())) == [(1, "a", True), (2, None, False)]
    df.coalesce(1).write.format("excel").mode("append").option("header", "true").option("sheetName", "More").save(path)
    assert [n for n, _ in excel.Workbook(excel._bytes(path)).sheets] == ["Sheet1", "More"]


def test_excel_addresses():
    assert excel.parse_address("A1:C8") == (None, 1, 1, 8, 3) and excel.parse_address("'My Sheet'!$B$2")[:3] == ("My Sheet", 2, 2)
    assert [excel.column_letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and excel.column_number("AAA") == 703
    with pytest.raises(ValueError):
        excel.parse_address("nowhere")


def test_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<r><b><t>one</t></b><b><t>two</t></b></r>")
    assert sorted(r["t"] for r in spark.read.format("xml").option("rowTag", "b").load(str(tmp_path / "x.xml")).collect()) == ["one", "two"]


def test_folder_blocks(spark, tmp_path):
    source = tmp_path / "m"
    (source / ".git").mkdir(parents=True)
    (source / ".git" / "x").write_text("no")
    (source / "a.bin").write_bytes(bytes(range(256)) * 1000)
    df = blocks.load_folder(spark, str(source))
    assert df.count() > 3
    blocks.save_folder(df.repartition(3), str(tmp_path / "out"))
    assert (tmp_path / "out/m/a.bin").read_bytes() == bytes(range(256)) * 1000 and not (tmp_path / "out/m/.git").exists()


@pytest.mark.parametrize(("kind", "value"), [("int", -5), ("long", 1 << 40), ("double", 1.5), ("boolean", True), ("string", "é"), ("short", 7), ("float", 0.5)])
def test_hbase_codec(kind, value):
    assert hbase.decode(hbase.encode(value, kind), kind) == value


def test_hbase_shapes(spark):
    assert hbase.parse_address("c:ns:t") == ("c", "ns", "t") and hbase.parse_address("t") == (None, "default", "t")
    assert hbase.split_keys(3) == [] and hbase.split_keys(5)[0] == b"aaaaaaa" and hbase.split_keys(5)[-1] == b"zzzzzzz"
    key, cells = hbase.cells_of({"rowkey": "r", "v": 3, "v_ts": 9, "n": None}, "f", ts_suffix="_ts", types={"v": "int"})
    assert (key, cells) == (b"r", {("f", "v"): (hbase.encode(3, "int"), 9)})

    class Client:
        def scan(self, table, family):
            return [(b"r", cells), (b"empty", {})]

    made = []

    class Maker:
        def create(self, table, family, splits):
            made.append((table, family, splits))

        def put(self, table, rows):
            pass

    hbase.write(spark.createDataFrame([("a", 1)], "rowkey string, v int").limit(0), Maker, "ns:t", {"numReg": "5"})
    assert made == [("ns:t", "f", hbase.split_keys(5))]

    row = hbase.read(spark, Client(), "ns:t", {"field.type.v": "int"}).collect()
    assert [r["rowkey"] for r in row] == ["r"] and json.loads(row[0]["content"]) == {"f:v": 3, "f:v_ts": 9}


def test_hbase_regions_are_tasks(spark):
    class Regions:
        """A table of two regions that executors scan."""

        def regions(self, table):
            return [(b"", b"m"), (b"m", b"")]

        def scan_range(self, table, family, start, stop):
            rows = [(f"{c}{k}".encode(), {("f", "v"): (str(k).encode(), 1)}) for c in "az" for k in range(1500)]
            return (r for r in rows if r[0] >= start and (not stop or r[0] < stop))

    df = hbase.read(spark, Regions(), "t", {})
    assert df.rdd.getNumPartitions() == 2
    assert sorted(r["rowkey"] for r in df.collect()) == sorted(f"{c}{k}" for c in "az" for k in range(1500))


def test_old_cache_entries_go(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "part").write_text("x")
    (tmp_path / "new").mkdir()
    os.utime(tmp_path / "old", (1, 1))
    assert jdbc.cleanup(spark, str(tmp_path)) == ["old"] and [p.name for p in tmp_path.iterdir()] == ["new"]
    assert jdbc.cleanup(spark, str(tmp_path / "none")) == []


def test_images_are_files(spark, tmp_path):
    from tessera.context import ScriptContext

    ctx = ScriptContext(spark)
    ctx.publish(spark.createDataFrame([("a.png", b"one"), ("b.png", b"two")], "name string, content binary"), "pictures")
    for path in (f"{tmp_path}/i", f"file://{tmp_path}/j"):
        ctx.run(f"save overwrite pictures as image.`{path}`;")
    assert (tmp_path / "i/a.png").read_bytes() == (tmp_path / "j/a.png").read_bytes() == b"one"


def test_jdbc(spark, tmp_path):
    own = jdbc.Connections(spark)
    own.add("d", {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert own.is_valid("d")
    own.execute("d", "create table t (k int, v varchar(10))")
    assert own.execute("d", "insert into t values (1, 'a'), (2, 'b')") == 2
    assert sorted(map(tuple, own.query("d", "select * from t", str(tmp_path / "cache")).collect())) == [(1, "a"), (2, "b")]
    own.execute("d", "insert into t values (null, 'n')")
    shared = own.query("d", "select * from t where v <> 'b';", split=("k", 3))
    assert sorted(map(tuple, shared.collect()), key=repr) == [(1, "a"), (None, "n")]
    own.execute("d", "delete from t where k is null")
    own.execute("d", "create table w (k int)")
    own.execute("d", "insert into w values (1), (40), (90), (null)")
    wide = own.query("d", "select k from w", split=("k", 3))
    assert wide.rdd.getNumPartitions() == 3 and sorted((r[0] for r in wide.collect()), key=repr) == sorted([1, 40, 90, None], key=repr)
    assert own.query("d", "select k from w where k > 1000", split=("k", 3)).count() == 0
    assert own.run_ordered("d", {"sql-1": "insert into t values (3, 'c')", "sql-2": "select count(*) as n from t"}).first()[0] == 3
    assert own.remove("d") and not own.remove("d")


def test_annotations(spark, tmp_path):
    shot = lambda url, *objects: {"name": "n", "data": {"image": url, "result": {"objects": [{"objType": "POLYGON", "classType": c, "coordinate": [{"x": x, "y": 2.0} for x in xs]} for c, xs in objects]}}}
    document = {"version": "1", "datasetName": "d", "exportTime": "t", "contents": [
        shot("https://store/pets/b.png?sig=1/2", ("dog", [1.0, 3.0]), ("cat", [5.0])), shot("https://store/pets/a.png", ("cat", [4.0])), shot("https://store/none.png")]}
    (tmp_path / "d.json").write_text(json.dumps(document))
    (tmp_path / "a.png").write_bytes(b"png")
    rows = annotations.load(spark, str(tmp_path / "d.json"), str(tmp_path / "*.png"))
    assert rows.columns == ["name", "meta", "data"] and {r["name"]: r["data"] and bytes(r["data"]) for r in rows.collect()} == {"a.png": b"png", "b.png": None, "none.png": None}
    coco = annotations.to_coco(annotations.contents(spark, str(tmp_path / "d.json")))
    assert sorted((r["id"], r["file_name"]) for r in coco["images"].collect()) == [(0, "b.png"), (1, "a.png"), (2, "none.png")]
    assert sorted(map(tuple, coco["categories"].collect())) == [(0, "cat"), (1, "dog")]
    assert sorted((r["id"], r["image_id"], r["category_id"], r["segmentation"]) for r in coco["annotations"].collect()) == [(0, 0, 1, [[1.0, 2.0, 3.0, 2.0]]), (1, 0, 0, [[5.0, 2.0]]), (2, 1, 0, [[4.0, 2.0]])]


def test_http_service(spark):
    calls = []
    service = http.OlapService(spark, "http://h/", "u", "p", lambda *a: calls.append(a) or (200, '{"code":"000","data":[1],"msg":"ok"}'))
    assert tuple(service.suggest_model("prj", ["select 1"]).first()) == ("000", "[1]", "ok")
    assert calls[0][0] == "POST" and calls[0][2]["Authorization"].startswith("Basic ")
    with pytest.raises(ValueError):
        service.call("DELETE", "x")


def test_source_tables(spark):
    assert http.source_tables(spark, "with c as (select * from db.a) select * from c join b on c.x = b.x where b.y in (select y from d)") == ["b", "d", "db.a"]


@pytest.mark.parametrize(("text", "seps", "limit", "n"), [("hello,\nnihao", ["\n"], 500, 1), ("hello,\nnihao\nnihao", ["\n"], 5, 5), ("hello,\nnihao.nihao", ["\n", "."], 6, 4), ("", ["\n"], 5, 1)])
def test_split_text(text, seps, limit, n):
    out = split_text(text, seps, limit)
    assert "".join(out) == text and len(out) == n and all(len(c) <= limit for c in out)


def test_stack_calls():
    assert json.loads(stack_calls(['{"history":[1]}'], ['{"instruction":"x"}'])[0]) == {"instruction": "x", "history": "[1]"}


CHART = """
control: {ignoreSort: false, format: %s}
fig: {%s: {title: T, x: day, y: [pv, uv], size_max: {vv_type: number, vv_value: "60"}, f: {vv_type: code, vv_value: "a.b"}}}
"""


def test_charts(spark):
    df = spark.createDataFrame([("b", 2, 1), ("a", 1, 3)], "day string, pv int, uv int")
    page = charts.visualize(df, CHART % ("html", "line")).first()
    assert page["mime"] == "html" and page["content"].count("<polyline") == 2
    assert charts.visualize(df, CHART % ("image", "bar")).first()["content"].startswith("<svg")
    code = charts.python_code(CHART % ("html", "line"))
    assert "sort_values('day')" in code and "size_max=60" in code and "f=a.b" in code
    compile(code, "chart", "exec")
    pred = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.6), (0, 0, 0.1)], "label int, prediction int, probability double")
    assert charts.visualize(pred, "fig: {auc: {x: label, y: probability}}").first()["mime"] == "html"
    assert charts.visualize(pred, "fig: {matrix: {x: label, y: prediction}}").first()["mime"] == "html"


def test_code_builder():
    text = Script().imports("os", "a.b.c", "x as y").let("v", {"k": [1, Raw("z")]}).call("f", 1, to="r", n="s").raw("pass").text()
    assert text == "import os\nfrom a.b import c\nimport x as y\nv = {'k': [1, z]}\nr = f(1, n='s')\npass\n"


def test_training_groups():
    assert training.parameter_groups({"fitParam.1.a": "2", "fitParam.0.a": "1", "x": "y"}) == [{"a": "1"}, {"a": "2"}] and training.parameter_groups({}) == [{}]


def test_automl(spark):
    df = spark.createDataFrame([([float(k % 7), float(k % 3)], int(k % 7 > 3)) for k in range(200)], "features array<double>, label int")
    report, models = training.automl(df, algorithms=("LogisticRegression", "RandomForest"))
    assert set(models) == {"LogisticRegression", "RandomForest"} and report.where("name = 'f1'").count() == 2
    assert training.explain(models["RandomForest"])
