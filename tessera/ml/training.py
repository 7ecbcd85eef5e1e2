"""Training runs over groups of parameters, with versions, cross validation and a table of results."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

RESULT = """modelPath string, algIndex int, alg string, metrics array<struct<name:string,value:double>>, status string, message string,
  startTime long, endTime long, trainParams map<string,string>"""


def parameter_groups(options: dict[str, str]) -> list[dict[str, str]]:
    """``fitParam.N.name`` options as one group a number; none gives one empty group."""
    groups: dict[int, dict[str, str]] = {}
    for key, value in options.items():
        m = re.fullmatch(r"fitParam\.(\d+)\.(.+)", key)
        if m:
            groups.setdefault(int(m[1]), {})[m[2]] = value
    return [groups[k] for k in sorted(groups)] or [{}]


#: Names of boosting libraries' parameters and of Spark's; fixed values.
ALIASES = {"numRound": "maxIter", "num_round": "maxIter", "eta": "stepSize", "learningRate": "stepSize", "max_depth": "maxDepth", "subsample": "subsamplingRate", "labelCol": "labelCol", "featuresCol": "featuresCol"}


def configure(estimator, params: dict[str, str]):
    """An estimator with parameters from texts; those it does not know are ignored, and ``unused`` names them."""
    for key, text in params.items():
        name = ALIASES.get(key, key)
        if not estimator.hasParam(name):
            continue
        param = estimator.getParam(name)
        try:
            value = json.loads(text) if isinstance(text, str) else text
        except ValueError:
            value = text
        estimator._set(**{param.name: param.typeConverter(value)})
    return estimator


def unused(estimator, params: dict[str, str]) -> list[str]:
    """Parameters that an estimator does not know."""
    return sorted(k for k in params if not estimator.hasParam(ALIASES.get(k, k)))


def classifier(classes: int):
    """Boosted trees; more than two classes by one against the rest."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    tree = GBTClassifier(maxIter=10, seed=7)
    return tree if classes <= 2 else OneVsRest(classifier=tree)


def regressor():
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(maxIter=10, seed=7)


def as_vectors(df: DataFrame, column: str = "features") -> DataFrame:
    """An array column as the vector that estimators take."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(column, array_to_vector(F.col(column))) if df.schema[column].dataType.typeName() == "array" else df


def _metrics(model, df: DataFrame, label: str, numeric: bool) -> list[tuple[str, float]]:
    from ..operators.analysis import classification_metrics, regression_metrics

    out = model.transform(df)
    table = regression_metrics(out, label) if numeric else classification_metrics(out, label)
    return [(r["name"], float(r["value"])) for r in table.collect()]


def _grid(estimator, options: dict[str, str]):
    from pyspark.ml.tuning import ParamGridBuilder

    grid = ParamGridBuilder()
    for key, text in options.items():
        if key.startswith("cv_grid_"):
            name = ALIASES.get(key.removeprefix("cv_grid_"), key.removeprefix("cv_grid_"))
            param = estimator.getParam(name)
            grid = grid.addGrid(param, [param.typeConverter(json.loads(v)) for v in text.split(",")])
    return grid.build()


def train(df: DataFrame, path: str, make: Callable, options: dict[str, str], alg: str, evaluate: DataFrame | None = None, numeric: bool = False) -> DataFrame:
    """Fit one model for each group; a failure is a row with status ``fail`` and stops no other group."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    spark = df.sparkSession
    df = as_vectors(df, options.get("featuresCol", "features"))
    label = options.get("labelCol", "label")
    keep = options.get("keepVersion", "false") == "true"
    base = f"{path.rstrip('/')}/{f'_model_{int(time.time() * 1000)}_{uuid.uuid4().hex[:6]}' if keep else '_model_0'}"
    rows = []
    for k, group in enumerate(parameter_groups(options)):
        began, model_path = int(time.time() * 1000), f"{base}/model/{k}"
        try:
            estimator = configure(make(), {"labelCol": label, **{n: v for n, v in options.items() if n == "featuresCol"}, **group})
            if options.get("cvEnabled") == "true":
                judge = (RegressionEvaluator if numeric else MulticlassClassificationEvaluator)(labelCol=label)
                if options.get("cv_evaluator"):
                    judge.setMetricName(options["cv_evaluator"])
                model = CrossValidator(estimator=estimator, estimatorParamMaps=_grid(estimator, options), evaluator=judge, numFolds=int(options.get("cv_numFolds", 3)), parallelism=int(options.get("cv_parallelism", 1)), seed=7).fit(df).bestModel
            else:
                model = estimator.fit(df)
            model.write().overwrite().save(model_path)
            metrics = _metrics(model, as_vectors(evaluate), label, numeric) if evaluate is not None else []
            idle = unused(estimator, group)
            rows.append((model_path, k, alg, metrics, "success", f"without effect: {', '.join(idle)}" if idle else "", began, int(time.time() * 1000), group))
        except Exception as error:
            rows.append((model_path, k, alg, [], "fail", str(error)[:2000], began, int(time.time() * 1000), group))
    result = spark.createDataFrame(rows, RESULT)
    result.coalesce(1).write.mode("overwrite").parquet(f"{base}/meta")
    return spark.read.parquet(f"{base}/meta")


def best_model(spark, path: str, index: int | None = None, metric: str = "f1"):
    """(model path, row) of the newest version: the model of an index, or the best by a metric."""
    from ..sources.fs import listing

    versions = [r["name"] for r in listing(spark, path).collect() if r["name"].startswith("_model_")]
    rows = [r for r in spark.read.parquet(f"{path.rstrip('/')}/{max(versions)}/meta").collect() if r["status"] == "success" and (index is None or r["algIndex"] == index)]
    if not rows:
        raise ValueError(f"no trained model at {path}")
    low = metric in ("mse", "rmse", "mae")
    score = lambda r: next((m["value"] for m in r["metrics"] if m["name"] == metric), float("inf") if low else float("-inf"))
    return (min if low else max)(rows, key=lambda r: (score(r), -r["algIndex"] if not low else r["algIndex"]))


def explain(model) -> list[tuple[str, str]]:
    """(name, value) of a model's parameters, and what its trees say of their features."""
    rows = sorted((p.name, str(v)) for p, v in model.extractParamMap().items())
    if hasattr(model, "featureImportances"):
        rows += [(f"featureImportances.{k}", str(v)) for k, v in enumerate(model.featureImportances.toArray().tolist()) if v]
        rows += [("numFeatures", str(model.numFeatures)), ("totalNumNodes", str(model.totalNumNodes))]
    return rows


def automl(df: DataFrame, label: str = "label", algorithms: tuple[str, ...] = ("GBTClassifier", "LogisticRegression", "NaiveBayes", "RandomForest"), sorted_by: str = "f1", seed: int = 7):
    """(table of (alg, name, value) best first, models by name): each algorithm fitted and measured on held-out rows."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier

    makes = {
        "GBTClassifier": lambda: GBTClassifier(labelCol=label, maxIter=10, seed=seed), "LogisticRegression": lambda: LogisticRegression(labelCol=label),
        "NaiveBayes": lambda: NaiveBayes(labelCol=label, modelType="gaussian"), "RandomForest": lambda: RandomForestClassifier(labelCol=label, seed=seed),
    }
    train_rows, test_rows = as_vectors(df).randomSplit([0.8, 0.2], seed)
    models, rows = {}, []
    for name in algorithms:
        models[name] = makes[name]().fit(train_rows)
        found = dict(_metrics(models[name], test_rows, label, False))
        rows += [(name, found[sorted_by], m, v) for m, v in found.items()]
    rows.sort(key=lambda r: (-r[1], r[0], r[2]))
    return df.sparkSession.createDataFrame([(a, m, v) for a, _, m, v in rows], "alg string, name string, value double"), models
