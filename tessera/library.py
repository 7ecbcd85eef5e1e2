"""The operators and commands of scripts, over the functions of this package."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from .functions import prompts
from .ml import serving, training, vector_store
from .operators import analysis, asserts, columns, profiling, scoring
from .registry import OPERATORS, Param, command, operator
from .sources import fs, http, jdbc
from .streaming import cdc, jobs
from .streaming.versioned import VersionedTable, save_then_load
from .viz import charts


def _args(options: dict[str, str]) -> list[str]:
    return json.loads(options.get("parameters", "[]"))


def _list(text: str | None) -> list[str]:
    return [c.strip() for c in (text or "").split(",") if c.strip()]


def _flag(options: dict[str, str], name: str, default: bool) -> bool:
    return options.get(name, str(default)).lower() == "true"


@operator("DataSummary", Param("metrics", ",".join(profiling.DEFAULT_METRICS)), Param("roundAt", "2"), Param("relativeError", "0.01"), Param("approxCountDistinct", "true"), Param("approxThreshold", "100000"))
def _summary(ctx, df, path, o):
    """Profile of every column."""
    return profiling.data_summary(df, _list(o.get("metrics")) or profiling.DEFAULT_METRICS, int(o.get("roundAt", 2)), float(o.get("relativeError", 0.01)), _flag(o, "approxCountDistinct", True), int(o.get("approxThreshold", 100_000)))


@operator("DescriptiveMetrics", Param("metricSize", "100"), Param("excludeEmptyVal", "true"))
def _descriptive(ctx, df, path, o):
    """Most frequent values of every column."""
    return profiling.descriptive_metrics_json(df, int(o.get("metricSize", 100)), _flag(o, "excludeEmptyVal", True))


@operator("PatternDistribution", Param("limit", "100"), Param("patternLimit", "1000"), Param("excludeEmptyVal", "true"))
def _patterns(ctx, df, path, o):
    """Value patterns of string columns."""
    return profiling.pattern_distribution_json(df, limit=int(o.get("limit", 100)), pattern_limit=int(o.get("patternLimit", 1000)), exclude_empty=_flag(o, "excludeEmptyVal", True))


@operator("ColumnsAnalysis", Param("action", "KS", "", ("KS", "P_VALUE", "IV", "MISS_RATE", "HORIZONTAL_SCORE", "PEARSON_IV", "PEARSON_DV")), Param("field"), Param("target"), Param("positive", "1"))
def _columns_analysis(ctx, df, path, o):
    """One statistic for each column."""
    positive = o.get("positive", "1")
    return analysis.columns_analysis(df, o["action"], _list(o.get("field") or o.get("fields")), o.get("target"), int(positive) if positive.isdigit() else positive)


@operator("ApproxQuantile")
def _quantile(ctx, df, path, o):
    """``table column quantile [error] [valued name | named table]``."""
    args = _args(o)
    error, at = (float(args[3]), 4) if len(args) > 3 and args[3] not in ("valued", "named") else (0.0, 3)
    out = analysis.approx_quantile(ctx.table(args[0]), args[1], float(args[2]), error)
    if args[at : at + 1] == ["valued"]:
        ctx.variables[args[at + 1]] = str(out.first()[0])
    elif args[at : at + 1] == ["named"]:
        ctx.publish(out, args[at + 1])
    return out


@operator("DFTool")
def _df_tool(ctx, df, path, o):
    """``build range N named table``."""
    args = _args(o)
    if args[:2] != ["build", "range"] or len(args) != 5:
        raise ValueError("usage: !dataframe build range N named table")
    return ctx.publish(analysis.build_range(ctx.spark, int(args[2])), args[4])


@operator("ClassificationEvaluator", Param("labelCol", "label"))
def _classification(ctx, df, path, o):
    """Metrics of predicted classes."""
    return analysis.classification_metrics(df, o.get("labelCol", "label"))


@operator("RegressionEvaluator", Param("labelCol", "label"))
def _regression(ctx, df, path, o):
    """Metrics of predicted numbers."""
    return analysis.regression_metrics(df, o.get("labelCol", "label"))


@operator("ColumnsExt", Param("action", "drop", "", ("drop", "remove")), Param("fields"))
def _columns_ext(ctx, df, path, o):
    """Drops columns of a table in place."""
    if o.get("action") not in ("drop", "remove"):
        raise ValueError(f"unknown action: {o.get('action')}")
    return ctx.publish(columns.drop_columns(df, _list(o.get("fields"))), o.get("__dfname__"))


@operator("UniqueIdentifier", Param("source", "new", "", ("new", "replace")), Param("columnName", "Unique_ID"), Param("startIndex", "1"), Param("mode"), Param("inputSchema"))
def _identifier(ctx, df, path, o):
    """Consecutive ids."""
    source, name = o.get("source", "new"), o.get("columnName", "Unique_ID")
    if o.get("mode") == "inferSchema":
        return columns.identifier_schema(ctx.spark, o["inputSchema"], source, name)
    if source == "replace" and name not in df.columns:
        source = "new"
    return columns.unique_identifier(df, source, name, o.get("startIndex", "1"))


@operator("DigitalColumnConvert", Param("sourceTable"), Param("destTable"), Param("trim", "true"))
def _convert(ctx, df, path, o):
    """Numeric types from another table."""
    if not o.get("sourceTable") or not o.get("destTable"):
        raise ValueError("sourceTable and destTable are needed")
    dest, source = ctx.table(o["destTable"]), ctx.table(o["sourceTable"])
    return dest if o["sourceTable"] == o["destTable"] else columns.convert_digital_columns(dest, source, _flag(o, "trim", True))


@operator("DataMissingValueProcess", Param("method", "mean", "", ("mean", "mode", "drop", "randomforest")), Param("processColumns"))
def _missing(ctx, df, path, o):
    """Missing values filled or dropped."""
    return columns.fill_missing(df, o.get("method", "mean"), _list(o.get("processColumns")))


@operator("SampleDatasetExt", Param("columns", "id,features,label"), Param("size", "10000"), Param("featuresSize", "100"), Param("labelSize", "2"), Param("seed", "7"))
def _sample_dataset(ctx, df, path, o):
    """A random table."""
    return columns.sample_dataset(ctx.spark, _list(o.get("columns")) or ("id", "features", "label"), int(o.get("size", 10_000)), int(o.get("featuresSize", 100)), int(o.get("labelSize", 2)), int(o.get("seed", 7)))


@operator("TakeRandomSampleExt", Param("fraction"), Param("size"), Param("seed", "7"))
def _take_sample(ctx, df, path, o):
    """A random sample."""
    number = lambda name, kind: kind(o[name]) if o.get(name) and float(o[name]) >= 0 else None
    return columns.take_sample(df, number("fraction", float), number("size", int), int(o.get("seed", 7)))


@operator("TableRepartition", Param("partitionNum"), Param("partitionType", "hash", "", ("hash", "range")), Param("partitionCols"))
def _repartition(ctx, df, path, o):
    """Rows dealt anew."""
    return columns.repartition_table(df, int(o["partitionNum"]), o.get("partitionType", "hash"), _list(o.get("partitionCols")))


@operator("DataTranspose", Param("mode", "pivot"), Param("indexCols"), Param("inputCol"), Param("aggCol"), Param("mergedCol"), Param("inputCols"))
def _transpose(ctx, df, path, o):
    """Pivot or unpivot."""
    index = _list(o.get("indexCols"))
    if o.get("mode", o.get("method", "pivot")) == "unpivot":
        return columns.unpivot(df, index, _list(o.get("inputCols") or o.get("inputCol")), o["mergedCol"], o["aggCol"])
    return columns.pivot_sum(df, index, o["inputCol"], o["aggCol"])


def _predict_onehot(ctx, df, path, o):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/onehot").transform(df)


@operator("Onehot", Param("selectedFeatures"), predict=_predict_onehot)
def _onehot(ctx, df, path, o):
    """Category vectors."""
    out, model = columns.onehot(df, _list(o.get("selectedFeatures") or o.get("selectedFeature")))
    if path:
        model.write().overwrite().save(f"{path}/onehot")
    return out


def _predict_bins(ctx, df, path, o):
    return scoring.bin_rows(df, scoring.load_bins(ctx.spark, path))


def _bins_function(ctx, path, name, o):
    """SQL function from an array of texts to an array of bins."""
    bins = scoring.load_bins(ctx.spark, path)

    @F.pandas_udf("array<double>")
    def find(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [b.place(v) for b, v in zip(bins, r)] for r in rows])

    ctx.spark.udf.register(name, find)


@operator("Binning", Param("selectedFeatures"), Param("label", "label"), Param("method", "EF", "", ("EF", "ED")), Param("numBucket", "5"), Param("customizedBucketsConfig"), Param("goodValue", "1"), predict=_predict_bins, function=_bins_function)
def _binning(ctx, df, path, o):
    """Bins with weight of evidence."""
    custom = dict(p.split(":") for p in _list(o.get("customizedBucketsConfig")))
    good = o.get("goodValue", "1")
    bins = scoring.fit_bins(df, _list(o.get("selectedFeatures")), o.get("method", "EF"), int(o.get("numBucket", 5)), {k: int(v) for k, v in custom.items()})
    if path:
        scoring.save_bins(ctx.spark, bins, path)
    return scoring.binning_info(scoring.woe_table(df, bins, o.get("label", "label"), int(good) if good.isdigit() else good, o.get("woeMethod", "ratio")))


def _predict_card(ctx, df, path, o):
    return scoring.ScoreCard.load(ctx.spark, path).predict(df)


def _card_function(ctx, path, name, o):
    """SQL function from an array of texts, by feature, to a class."""
    card = scoring.ScoreCard.load(ctx.spark, path)

    @F.pandas_udf("double")
    def classify(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            total = card.intercept
            for b, v in zip(card.bins, r if r is not None else []):
                k = b.place(v)
                total += card.coefficients[b.feature] * (card.weights[b.feature][k] if k is not None else 0.0)
            out.append(float(total >= 0))
        return pd.Series(out)

    ctx.spark.udf.register(name, classify)


@operator("ScoreCard", Param("binningPath"), Param("scaledValue", "800"), Param("odds", "50"), Param("pdo", "25"), Param("goodValue", "1"), Param("label", "label"), predict=_predict_card, function=_card_function)
def _score_card(ctx, df, path, o):
    """Scores from bins."""
    bins = scoring.load_bins(ctx.spark, o["binningPath"])
    good, label = o.get("goodValue", "1"), o.get("label", "label")
    good = int(good) if good.isdigit() else good
    card = scoring.fit_score_card(df, bins, scoring.woe_table(df, bins, label, good), label, good, float(o.get("scaledValue", 800)), float(o.get("odds", 50)), float(o.get("pdo", 25)))
    if path:
        card.save(ctx.spark, path)
    return card.predict(df)


@operator("PSI", Param("expectedTable"), Param("actualTable"), Param("binningPath"))
def _psi(ctx, df, path, o):
    """Population stability by bin."""
    expected = ctx.table(o["expectedTable"]) if o.get("expectedTable") else df
    return scoring.population_stability(expected, ctx.table(o["actualTable"]), scoring.load_bins(ctx.spark, o["binningPath"]))


def _assertion(name, find, require):
    @operator(name)
    def show(ctx, df, path, o):
        args = _args(o)
        return find(ctx.table(args[0]), args[1])

    @operator(f"{name}Throw")
    def check(ctx, df, path, o):
        args = _args(o)
        require(ctx.table(args[0]), args[1])
        return df.limit(0)


_assertion("AssertCondition", asserts.failing_condition, asserts.require_condition)
_assertion("AssertNotNull", lambda d, c: asserts.failing_not_null(d, _list(c)), lambda d, c: asserts.require_not_null(d, _list(c)))
_assertion("AssertUniqueKey", lambda d, c: asserts.conflicting_keys(d, _list(c)), lambda d, c: asserts.require_unique_key(d, _list(c)))
_assertion("AssertUniqueKeys", lambda d, c: asserts.conflicting_rows(d, _list(c)), lambda d, c: asserts.require_unique_keys(d, _list(c)))


@operator("Assert")
def _assert(ctx, df, path, o):
    """``table expression message``; ``name in __set__ message`` asks for a variable."""
    args = _args(o)
    if args[1:2] == ["in"] and args[2] in ("__set__", "__session__"):
        if args[0] not in ctx.variables:
            raise asserts.AssertionFailed(args[3])
    elif args[0] in ("__set__", "__session__"):
        names = [(k, v) for k, v in ctx.variables.items()]
        row = ctx.spark.createDataFrame([tuple(v for _, v in names)] or [("",)], [k for k, _ in names] or ["_"])
        asserts.require(row, args[1], args[2])
    else:
        asserts.require(ctx.table(args[0]), args[1], args[2])
    return df.limit(0)


@operator("Throw", Param("msg"))
def _throw(ctx, df, path, o):
    """An error with a message."""
    asserts.throw(o.get("msg", ""))


@operator("LastCommand")
def _last(ctx, df, path, o):
    """``named table``: the last result under another name."""
    if ctx.last_table is None:
        raise ValueError("there is no last table")
    return ctx.publish(ctx.table(ctx.last_table), _args(o)[-1])


@operator("SaveThenLoad")
def _save_then_load(ctx, df, path, o):
    """A written copy of a table under the same name."""
    name = _args(o)[0] if o.get("parameters") else o["__dfname__"]
    root = path or o.get("root") or f"{ctx.variables.get('tempPath', ctx.spark.conf.get('spark.sql.warehouse.dir'))}/__tmp__"
    return ctx.publish(save_then_load(ctx.table(name), f"{root}/{name}"), name)


@operator("DeltaTable")
def _versioned(ctx, df, path, o):
    """``desc|truncate|delete|vacuum|remove|history path [argument]``."""
    action, where, *rest = _args(o)
    table = VersionedTable(ctx.spark, where)
    if action == "desc":
        return table.desc()
    if action == "history":
        return ctx.spark.createDataFrame([(v, table._manifest(v)["operation"]) for v in table.versions()], "version int, operation string")
    done = {"truncate": table.truncate, "remove": table.remove, "delete": lambda: table.delete(rest[0]), "vacuum": lambda: table.vacuum(float(rest[0]) if rest else 168.0)}
    if action not in done:
        raise ValueError(f"unknown action: {action}")
    return ctx.spark.createDataFrame([(action, str(done[action]()))], "action string, result string")


@operator("BinlogToDelta", Param("dbTable"), Param("maxTs", "0"), Param("idCols"))
def _binlog(ctx, df, path, o):
    """Merges JSON change events into a versioned table."""
    return cdc.apply_batch(VersionedTable(ctx.spark, path), cdc.parse_events(df, o["dbTable"], int(o.get("maxTs", 0))), _list(o.get("idCols")))


def _jdbc(ctx) -> jdbc.Connections:
    return ctx.functions.setdefault("jdbc", jdbc.Connections(ctx.spark))


@operator("JDBCConn")
def _conn(ctx, df, path, o):
    """``name "url=..." "driver=..."``, or ``remove name``."""
    args = _args(o)
    if args[0] == "remove":
        _jdbc(ctx).remove(args[1])
    else:
        _jdbc(ctx).add(args[0], dict(a.split("=", 1) for a in args[1:]))
    return df.limit(0)


@operator("JDBCExec")
def _exec(ctx, df, path, o):
    """``sql by name``, or ``table from sql by name``."""
    ctx.allow("jdbc", _args(o)[-1], "exec")
    args = _args(o)
    if len(args) == 3 and args[1] == "by":
        return ctx.spark.createDataFrame([(_jdbc(ctx).execute(args[2], args[0]),)], "changed int")
    if len(args) == 5 and args[1] == "from" and args[3] == "by":
        return ctx.publish(_jdbc(ctx).query(args[4], args[2], ctx.variables.get("jdbcCache")), args[0])
    raise ValueError("usage: !exec_sql [table from] 'sql' by name")


@operator("FeatureStoreExt", Param("db"), Param("action", "ddl"))
def _feature_store(ctx, df, path, o):
    """``sql-1``, ``sql-2``, ... in order; the last result."""
    out = _jdbc(ctx).run_ordered(o["db"], o)
    return df.limit(0) if out is None else out


def _external_sql(ctx, df, path, o):
    """A query on an external engine's named connection."""
    split = (o["partitionColumn"], int(o.get("numPartitions", 8))) if o.get("partitionColumn") else None
    return _jdbc(ctx).query(o["connection"], o.get("sql") or f"select * from {path}", split=split)


operator("AthenaExt", Param("connection"), Param("sql"), Param("partitionColumn"), Param("numPartitions", "8"))(_external_sql)
operator("AthenaSchemaExt", Param("connection"), Param("sql"))(lambda ctx, df, path, o: ctx.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in _external_sql(ctx, df, path, o).schema.fields], "col_name string, data_type string"))


def _olap(ctx, o) -> http.OlapService:
    transport = ctx.functions.get("http", http.urllib_transport)
    return http.OlapService(ctx.spark, o["host"], o.get("user", ""), o.get("password", ""), transport)


@operator("KeApi", Param("host"), Param("method", "GET"), Param("url"), Param("body"))
def _api(ctx, df, path, o):
    """One REST call."""
    return _olap(ctx, o).call(o.get("method", "GET"), o.get("url", path), json.loads(o["body"]) if o.get("body") else None)


@operator("KeAutoModel", Param("host"), Param("project"), Param("sqls"))
def _auto_model(ctx, df, path, o):
    """A model suggested from queries."""
    return _olap(ctx, o).suggest_model(o["project"], json.loads(o["sqls"]) if o.get("sqls") else [r[0] for r in df.select("sql").collect()])


@operator("KeBuildSegment", Param("host"), Param("project"), Param("model"), Param("start"), Param("end"))
def _segment(ctx, df, path, o):
    """A segment of a model."""
    return _olap(ctx, o).build_segment(o["project"], o["model"], int(o["start"]), int(o["end"]))


@operator("LSCommand", Param("enableCount", "false"), Param("enableMaximumExceedException", "false"), Param("maximum", "1000"))
def _ls(ctx, df, path, o):
    """Entries of a folder."""
    where = _args(o)[0] if o.get("parameters") else path
    ctx.allow("file", where, "load")
    return fs.listing(ctx.spark, where, _flag(o, "enableCount", False), int(o.get("maximum", 1000)) if _flag(o, "enableMaximumExceedException", False) else None)


@operator("ExistsCommand")
def _exists(ctx, df, path, o):
    """Whether a path is there."""
    where = _args(o)[0] if o.get("parameters") else path
    ctx.allow("file", where, "load")
    return fs.exists(ctx.spark, where)


@operator("FileStatusCommand")
def _status(ctx, df, path, o):
    """Status of a path."""
    where = _args(o)[0] if o.get("parameters") else path
    ctx.allow("file", where, "load")
    return fs.status(ctx.spark, where)


@operator("CopyFromLocal")
def _copy(ctx, df, path, o):
    """``source target``."""
    source, target = _args(o)
    ctx.allow("file", target, "save")
    return fs.copy_from_local(ctx.spark, source, target)


@operator("ShellExecute")
def _shell(ctx, df, path, o):
    """Output lines of a process; only where the context allows it."""
    import shlex
    import subprocess

    if not ctx.allow_shell:
        raise PermissionError("this context does not allow shell commands")
    args = _args(o)
    command_line = args[1] if args[:1] == ["script"] else shlex.split(" ".join(args)) if len(args) == 1 else args
    done = subprocess.run(command_line, shell=args[:1] == ["script"], capture_output=True, text=True, timeout=3600)
    lines = [done.stderr + done.stdout] if args[:1] == ["script"] else (done.stderr + done.stdout).splitlines()
    return ctx.spark.createDataFrame([(x,) for x in lines], "content string")


@operator("StreamPersistCommand")
def _stream_persist(ctx, df, path, o):
    """``persist name [script variable]``, ``remove name`` or ``list``."""
    args = _args(o)
    own = jobs.StreamJobs(jobs.Registry(ctx.spark, f"{ctx.variables['metaPath']}/streams"), ctx.run)
    if args[0] == "persist":
        own.persist(args[1], ctx.variables[args[2] if len(args) > 2 else args[1]])
    elif args[0] == "remove":
        own.remove(args[1])
    elif args[0] != "list":
        raise ValueError(f"unknown action: {args[0]}")
    return own.list()


@operator("ConnectPersistCommand")
def _connect_persist(ctx, df, path, o):
    """Keeps all named connections; with ``restore`` brings them back."""
    registry = jobs.Registry(ctx.spark, f"{ctx.variables['metaPath']}/connections")
    if _args(o)[:1] == ["restore"]:
        ctx.connections.update({k: (v[0], v[1]) for k, v in registry.items().items()})
    else:
        for name, value in ctx.connections.items():
            registry.put(name, value)
    rows = [(k, v[0]) for k, v in registry.items().items()]
    return ctx.spark.createDataFrame(rows, "name string, format string")


@operator("ScriptEval")
def _eval(ctx, df, path, o):
    """Runs a variable's text as a script here."""
    name = _args(o)[0]
    out = ctx.run(ctx.variables.get(name, name))
    return df.limit(0) if out is None else out


@operator("VisualizationExt")
def _visualize(ctx, df, path, o):
    """``table description``."""
    table, text = _args(o)
    return charts.visualize(ctx.table(table), text)


@operator("AuthAdmin")
def _auth_admin(ctx, df, path, o):
    """``admin reload``, ``resource add text``, ``resource delete name``, ``resource query``."""
    ctx.allow("system", "__auth_admin__", "*")
    args, store = _args(o), ctx.functions["auth.store"]
    if args[:2] == ["admin", "reload"]:
        ctx.policy = store.reload()
    elif args[:2] == ["resource", "add"]:
        store.add(args[2])
        ctx.policy = store.policy
    elif args[:2] == ["resource", "delete"]:
        store.delete(args[2])
        ctx.policy = store.policy
    elif args[:2] != ["resource", "query"]:
        raise ValueError(f"unknown action: {' '.join(args[:2])}")
    return ctx.spark.createDataFrame(store.query(), "name string, content string")


def _boosted(name, numeric):
    def predict(ctx, df, path, o):
        from pyspark.ml.util import DefaultParamsReader

        row = training.best_model(ctx.spark, path, int(o["algIndex"]) if "algIndex" in o else None, "rmse" if numeric else "f1")
        return DefaultParamsReader.loadParamsInstance(row["modelPath"], ctx.spark).transform(training.as_vectors(df))

    @operator(name, Param("keepVersion", "false"), Param("evaluateTable"), Param("fitParam.N.*"), Param("cvEnabled", "false"), Param("cv_numFolds", "3"), Param("cv_parallelism", "1"), predict=predict)
    def fit(ctx, df, path, o):
        """Boosted trees, one model for each group of parameters."""
        evaluate = ctx.table(o["evaluateTable"]) if o.get("evaluateTable") else None
        if numeric:
            return training.train(df, path, training.regressor, o, name, evaluate, True)
        classes = df.agg(F.countDistinct(o.get("labelCol", "label"))).first()[0]
        return training.train(df, path, lambda: training.classifier(classes), o, name, evaluate)


_boosted("XGBoostClassifier", False)
_boosted("XGBoostRegressor", True)


@operator("AutoML", Param("algos", "GBTClassifier,LogisticRegression,NaiveBayes,RandomForest"), Param("sortedBy", "f1"), Param("labelCol", "label"))
def _automl(ctx, df, path, o):
    """Algorithms compared on held-out rows."""
    names = tuple(_list(o.get("algos"))) or ("GBTClassifier", "LogisticRegression", "NaiveBayes", "RandomForest")
    report, models = training.automl(df, o.get("labelCol", "label"), names, o.get("sortedBy", "f1"))
    if path:
        for name, model in models.items():
            model.write().overwrite().save(f"{path}/{name}")
    return report


@operator("LLM", Param("action", "infer", "", tuple(serving.ACTIONS)), Param("pretrainedModelType", "custom"), Param("udfName"), Param("backend", "mock"))
def _llm_model(ctx, df, path, o):
    """A model as a SQL function; other actions need a backend that has them."""
    action, kind = o.get("action", "infer"), o.get("pretrainedModelType", "custom")
    serving.check_action(action, kind)
    if action != "infer":
        name = o.get("backend", "mock")
        do = getattr(serving.BACKENDS[name](o), action, None) if name in serving.BACKENDS else None
        if do is None:
            raise RuntimeError(f"the backend {name} does not {action}")
        return ctx.spark.createDataFrame([(action, kind, do(df, path, o))], "action string, pretrainedModelType string, model string")
    serving.register_function(ctx.spark, o["udfName"], kind, o)
    prompts.register(ctx.spark)
    return ctx.spark.createDataFrame([(o["udfName"],)], "udfName string")


@operator("Retrieval", Param("action"), Param("clusterName", "default"), Param("database"), Param("table"))
def _retrieval(ctx, df, path, o):
    """cluster/create, table/create, table/data, table/commit, table/truncate, table/closeAndDeleteFile, search."""
    store = vector_store.VectorStore(ctx.spark, f"{ctx.variables['metaPath']}/vectors/{o.get('clusterName', 'default')}")
    action, database, table = o["action"], o.get("database", "default"), o.get("table", "")
    if action == "table/create":
        store.create(database, table)
    elif action == "table/data":
        store.add(database, table, df)
    elif action == "table/truncate":
        store.truncate(database, table)
    elif action == "table/closeAndDeleteFile":
        store.drop(database, table)
    elif action == "search":
        return store.search(database, table, df, int(o.get("k", 10)))
    elif action not in ("cluster/create", "table/commit"):
        raise ValueError(f"unknown action: {action}")
    return ctx.spark.createDataFrame([(action, "done")], "action string, status string")


@operator("LLMQABuilder", Param("database", "default"), Param("table", "qa"), Param("chunkSize", "800"))
def _qa_builder(ctx, df, path, o):
    """Chunks, embeds and stores texts for question answering."""
    store = vector_store.VectorStore(ctx.spark, f"{ctx.variables['metaPath']}/vectors/{o.get('clusterName', 'default')}")
    backend = serving.BACKENDS[o.get("backend", "mock")](o)
    vector_store.build_qa(ctx.spark, df, store, o.get("database", "default"), o.get("table", "qa"), backend, int(o.get("chunkSize", 800)))
    return store.read(o.get("database", "default"), o.get("table", "qa")).select("id", "content")


def _qa_store(ctx, o):
    return vector_store.VectorStore(ctx.spark, f"{ctx.variables['metaPath']}/vectors/{o.get('clusterName', 'default')}")


def _qa_function(ctx, path, name, o):
    """SQL function from a question to a JSON answer."""
    make = serving.BACKENDS[o.get("backend", "mock")]
    vector_store.deploy(ctx.spark, _qa_store(ctx, o), o.get("database", "default"), o.get("table", path or "qa"), make, o, name, int(o.get("k", 4)))


@operator("LLMQADeploy", Param("database", "default"), Param("table", "qa"), Param("k", "4"), Param("clusterName", "default"), Param("backend", "mock"), function=_qa_function)
def _qa_deploy(ctx, df, path, o):
    """Answers to a table of questions (id, question); ``register`` makes a function of it."""
    backend = serving.BACKENDS[o.get("backend", "mock")](o)
    return vector_store.answers(_qa_store(ctx, o), o.get("database", "default"), o.get("table", path or "qa"), backend, df, int(o.get("k", 4)))


#: Session settings by profile; fixed names.
PROFILES = {"single": {"maxConcurrency": "1", "num_gpus": "1"}, "sft": {"maxConcurrency": "1", "num_gpus": "1", "dataMode": "model"}, "sfft": {"maxConcurrency": "1", "num_gpus": "8"}, "data": {"dataMode": "data"}, "retrieval": {"num_gpus": "0"}}


@operator("ModelAdmin")
def _model_admin(ctx, df, path, o):
    """``setup profile``, ``model exists path`` or ``model remove path``."""
    args = _args(o)
    if args[:1] == ["setup"]:
        ctx.variables.update(PROFILES[args[1]])
        return ctx.spark.createDataFrame(list(PROFILES[args[1]].items()), "name string, value string")
    if args[:2] == ["model", "exists"]:
        return fs.exists(ctx.spark, args[2])
    if args[:2] == ["model", "remove"]:
        VersionedTable(ctx.spark, args[2]).remove()
        return fs.exists(ctx.spark, args[2])
    raise ValueError(f"unknown action: {' '.join(args)}")


# Commands: script text, or the name of the operator that takes all arguments.
for _name, _op in {
    "eval": "ScriptEval", "conn": "JDBCConn", "exec_sql": "JDBCExec", "llmAdmin": "ModelAdmin", "simpleAuth": "AuthAdmin", "visualize": "VisualizationExt",
    "connectPersist": "ConnectPersistCommand", "deltaTable": "DeltaTable", "approxQuantile": "ApproxQuantile", "dataframe": "DFTool",
    "assertNotNull": "AssertNotNull", "assertNotNullThrow": "AssertNotNullThrow", "assertUniqueKey": "AssertUniqueKey", "assertUniqueKeyThrow": "AssertUniqueKeyThrow",
    "assertUniqueKeys": "AssertUniqueKeys", "assertUniqueKeysThrow": "AssertUniqueKeysThrow", "assertCondition": "AssertCondition", "assertConditionThrow": "AssertConditionThrow",
    "assert": "Assert", "ls": "LSCommand", "exists": "ExistsCommand", "fileStatus": "FileStatusCommand", "sh": "ShellExecute", "copyFromLocal": "CopyFromLocal",
    "streamPersist": "StreamPersistCommand", "last": "LastCommand", "saveThenLoad": "SaveThenLoad",
}.items():
    assert _op in OPERATORS
    command(_name, _op)
command("throw", "run command as Throw.`` where msg='''{0}''';")
command("columns", "run {3} as ColumnsExt.`` where action=\"{0}\" and fields=\"{1}\";")
