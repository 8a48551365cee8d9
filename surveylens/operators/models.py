"""Built-in classifiers, cross-validated comparison and grid tuning.

MLlib provides logistic regression, decision trees, random forests and gradient
boosted trees (which stand in for the study's XGBoost / LightGBM / CatBoost
variants).  AdaBoost is our own booster.  Folds are hash buckets of the key; each
fold's fit is an MLlib job, and folds are fitted concurrently from a small thread
pool so that Spark schedules their tasks side by side.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.operators import boost as B
from surveylens.operators import metrics as M

# --------------------------------------------------------------------------
# The model line-up of the comparison and the stand-in settings
# for the gradient-boosting libraries (their library defaults, where MLlib has them).
# --------------------------------------------------------------------------
MODEL_NAMES = ["LR", "CART", "RF", "Adaboost", "gbt", "gbt_xgboost", "gbt_catboost", "gbt_lightgbm"]
TRAINING_JOB_MODELS = ["Adaboost", "gbt_lightgbm"]
FEW_ROWS = 1 << 17     # rows that are read as they come

# estimator class and default settings of each model
_ESTIMATORS = {
    "LR": (LogisticRegression, {"maxIter": 100}),
    "CART": (DecisionTreeClassifier, {"maxDepth": 10, "minInstancesPerNode": 1}),
    "RF": (RandomForestClassifier, {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "sqrt",
                                    "minInstancesPerNode": 1}),
    "gbt": (GBTClassifier, {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3}),
    "gbt_xgboost": (GBTClassifier, {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6}),
    "gbt_catboost": (GBTClassifier, {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6}),
    "gbt_lightgbm": (GBTClassifier, {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5}),
}


def make_estimator(name: str, label: str = S.TARGET, seed: int = S.MODEL_SEED, **params):
    """An MLlib estimator reading the assembled ``features`` vector.  ``params`` are settings
    of its class; an unknown one is an error."""
    if name not in _ESTIMATORS:
        raise ValueError(f"unknown model {name}")
    kind, defaults = _ESTIMATORS[name]
    unknown = [p for p in params if not kind().hasParam(p)]
    if unknown:
        raise ValueError(f"{name} has no setting {', '.join(unknown)}")
    seeded = {} if name == "LR" else {"seed": seed}
    return kind(featuresCol="features", labelCol=label, **(seeded | defaults | params))


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a table of more than ``FEW_ROWS`` evenly over all cores: small files make few
    tasks, and MLlib keeps its input's.  Each task's rows are sorted, as forests draw their
    samples by task and row.  A small table stays as it comes."""
    if df.count() <= FEW_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *df.columns) \
        .sortWithinPartitions(*df.columns)


def _score_frame(pred: DataFrame, label: str) -> DataFrame:
    return pred.select(F.col(label).cast("int").alias("label"),
                       F.col("prediction").cast("int").alias("prediction"),
                       vector_to_array("probability")[1].alias("score"))


def cross_val_scores(df: DataFrame, features: list[str], label: str, names: list[str],
                     folds: int = S.COMPARISON_FOLDS, fold_col: str = "fold",
                     params: dict[str, dict] | None = None, parallelism: int = 8,
                     adaboost_rounds: int = 50) -> DataFrame:
    """(model, metric, score): mean over ``folds`` of roc_auc, f1, precision, recall, accuracy.

    Fits run concurrently (MLlib jobs from a thread pool; all AdaBoost folds boosted
    side by side).  Every (model, fold) prediction table is then unioned and all
    metrics of all models and folds come from one grouped plan.
    """
    params = params or {}
    data = assemble(df, features).select("features", *features, label, fold_col).persist()

    def fit(name: str, k: int):
        train = data.filter(F.col(fold_col) != k)
        return name, k, make_estimator(name, label, **params.get(name, {})).fit(train)

    jobs = [(n, k) for n in names if n != "Adaboost" for k in range(folds)]
    boosted = {}

    def boost():
        specs = [B.BoostSpec(str(k), F.col(fold_col) != k, 1.0, adaboost_rounds) for k in range(folds)]
        boosted.update(B.fit_boosted_stumps(data, features, label, specs))

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            # the booster's rounds run alongside the MLlib fits; Spark shares the executors
            boost_future = pool.submit(boost) if "Adaboost" in names else None
            fitted = list(pool.map(lambda a: fit(*a), jobs))
            if boost_future is not None:
                boost_future.result()
    except BaseException:
        data.unpersist()
        raise
    try:
        preds = []
        for name, k, model in fitted:
            valid = data.filter(F.col(fold_col) == k)
            preds.append(_score_frame(model.transform(valid), label)
                         .withColumn("model", F.lit(name)).withColumn("fold", F.lit(k)))
        for k in range(folds) if boosted else []:
            valid = data.filter(F.col(fold_col) == k)
            preds.append(boosted[str(k)].transform(valid).select(
                F.col(label).cast("int").alias("label"), "prediction", F.col("decision").alias("score"),
                F.lit("Adaboost").alias("model"), F.lit(k).alias("fold")))
        allp = preds[0]
        for p in preds[1:]:
            allp = allp.unionByName(p)
        per_fold = M.grouped_binary_metrics(allp, ["model", "fold"])
        stack = ", ".join(f"'{m}', {m}" for m in S.COMPARISON_METRICS)
        long = per_fold.selectExpr("model", "fold", f"stack({len(S.COMPARISON_METRICS)}, {stack}) AS (metric, score)")
        out = long.groupBy("model", "metric").agg(F.avg("score").alias("score")).collect()
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(out, "model string, metric string, score double")


def tune(df: DataFrame, features: list[str], label: str, name: str, grid: dict[str, list],
         folds: int = S.COMPARISON_FOLDS, fold_col: str = "fold", parallelism: int = 8,
         base_params: dict | None = None):
    """Grid search by cross-validated ROC AUC (MLlib ``CrossValidator`` on hash folds).

    Returns (fitted best model, rows of (model, params, mean_auc)).
    """
    est = make_estimator(name, label, **(base_params or {}))
    builder = ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(est.getParam(p), values)
    maps = builder.build()
    cv = CrossValidator(numFolds=folds, estimator=Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features",
                                                                    handleInvalid="keep"), est]),
                        estimatorParamMaps=[{**m} for m in maps],
                        # a tree's raw prediction is a leaf's counts, which do not rank rows; its probability does
                        evaluator=BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability",
                                                                metricName="areaUnderROC"),
                        foldCol=fold_col, parallelism=parallelism, seed=S.MODEL_SEED)
    model = cv.fit(df.select(*features, label, fold_col))
    out = []
    for m, auc in zip(maps, model.avgMetrics):
        out.append((name, ", ".join(f"{k.name}={v}" for k, v in sorted(m.items(), key=lambda kv: kv[0].name)),
                    float(auc)))
    return model.bestModel, out


def tune_scores(df: DataFrame, features: list[str], label: str, name: str, grid: dict[str, list],
                folds: int = S.COMPARISON_FOLDS, fold_col: str = "fold", parallelism: int = 8) -> DataFrame:
    """(model, stage, metric, score): cross-validated roc_auc and f1 of a model's default
    settings (before) and of the grid's best ones (after)."""
    best, _ = tune(df, features, label, name, grid, folds, fold_col, parallelism)
    chosen = {p: best.stages[-1].getOrDefault(p) for p in grid}
    out = None
    for stage, params in (("before", {}), ("after", chosen)):
        part = cross_val_scores(df, features, label, [name], folds, fold_col, {name: params}, parallelism) \
            .filter(F.col("metric").isin("roc_auc", "f1")).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return out


def tree_importances(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted MLlib tree model, largest first, ties by name."""
    return sorted(((f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)),
                  key=lambda fv: (-fv[1], fv[0]))


def fitted_facts(model, features: list[str]) -> list[tuple[str, str]]:
    """(fact, value) rows of what a fit has learnt: coefficients, or depth and nodes of trees."""
    if hasattr(model, "coefficients"):
        return [("intercept", f"{model.intercept:.4f}")] + [
            (f"coefficient {f}", f"{v:.4f}") for f, v in zip(features, model.coefficients.toArray(), strict=True)]
    if hasattr(model, "trees"):
        return [("trees", str(len(model.trees))), ("nodes", str(model.totalNumNodes))]
    return [("depth", str(model.depth)), ("nodes", str(model.numNodes))]


def model_params(model) -> list[tuple[str, str]]:
    """(param, value) rows of a fitted MLlib model or estimator."""
    return [(p.name, str(v)) for p, v in sorted(model.extractParamMap().items(), key=lambda kv: kv[0].name)]
