"""Cross-validation and tuning agree with MLlib's evaluators fold by fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from surveylens.operators import metrics as M
from surveylens.operators import models as ML

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.integers(0, 4, 400).astype(float)
    y = ((a + 0.4 * b + rng.normal(size=400)) > 0.6).astype(int)
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y, "fold": np.arange(400) % 3})) \
        .withColumn("fold", F.col("fold").cast("int"))


def by_hand(folded, name, **params):
    auc, f1 = [], []
    for k in range(3):
        data = ML.assemble(folded, FEATURES)
        model = ML.make_estimator(name, "y", **params).fit(data.filter(F.col("fold") != k))
        pred = model.transform(data.filter(F.col("fold") == k)).withColumn("y", F.col("y").cast("double"))
        auc.append(BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="probability").evaluate(pred))
        f1.append(MulticlassClassificationEvaluator(labelCol="y", metricName="fMeasureByLabel",
                                                    metricLabel=1.0).evaluate(pred))
    return sum(auc) / 3, sum(f1) / 3


@pytest.mark.parametrize("name", ["LR", "CART"])
def test_cross_val_scores(folded, name):
    got = {r.metric: r.score for r in ML.cross_val_scores(folded, FEATURES, "y", [name], folds=3).collect()}
    auc, f1 = by_hand(folded, name)
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-6) and got["f1"] == pytest.approx(f1, abs=1e-6)


def test_tune_and_its_scores(folded):
    _, rows = ML.tune(folded, FEATURES, "y", "CART", {"maxDepth": [1, 4]}, folds=3)
    for depth, row in zip((1, 4), rows):
        assert row[2] == pytest.approx(by_hand(folded, "CART", maxDepth=depth)[0], abs=1e-6)
    got = {(r.stage, r.metric): r.score for r in
           ML.tune_scores(folded, FEATURES, "y", "CART", {"maxDepth": [1, 4]}, folds=3).collect()}
    best = max((1, 4), key=lambda d: by_hand(folded, "CART", maxDepth=d)[0])
    assert got["before", "roc_auc"] == pytest.approx(by_hand(folded, "CART")[0], abs=1e-6)
    assert (got["after", "roc_auc"], got["after", "f1"]) == pytest.approx(by_hand(folded, "CART", maxDepth=best), abs=1e-6)


def test_grouped_metrics_equal_single_ones(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("g"), (F.col("id") % 5 < 2).cast("int").alias("label"),
                                 (F.col("id") * 37 % 101 / 101.0).alias("score")) \
        .withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    for r in M.grouped_binary_metrics(df, ["g"], buckets=4).collect():
        own = df.filter(F.col("g") == r.g)
        assert r.roc_auc == pytest.approx(M.roc_auc(own).first().roc_auc, abs=1e-12)
        single = M.binary_metrics(own).first()
        assert (r.accuracy, r.f1, r.r2) == pytest.approx((single.accuracy, single.f1, single.r2))


def test_saved_pipeline_scores_alike(spark, folded):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from surveylens.session import scratch_path
    from surveylens.sources.model_store import load_mllib, save_mllib
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"),
                             ML.make_estimator("CART", "y")]).fit(folded)
    path = scratch_path(spark, "mllib")
    save_mllib(model, path)
    cols = ["a", "b", "prediction"]
    assert load_mllib(path).transform(folded).select(cols).exceptAll(model.transform(folded).select(cols)).count() == 0


def test_fitted_facts_and_importances(folded):
    data = ML.assemble(folded, FEATURES)
    tree = ML.make_estimator("CART", "y", maxDepth=2).fit(data)
    assert dict(ML.fitted_facts(tree, FEATURES))["depth"] in ("1", "2")
    assert sum(v for _, v in ML.tree_importances(tree, FEATURES)) == pytest.approx(1.0)
    assert {k for k, _ in ML.fitted_facts(ML.make_estimator("LR", "y").fit(data), FEATURES)} == {
        "intercept", "coefficient a", "coefficient b"}


@pytest.mark.parametrize("name,points", [("tune_cart", 532), ("tune_knn", 48), ("tune_lr", 3)])
def test_queries_run_the_published_grids(spark, name, points):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    rows = E.queries()[name](spark, SF_SMALL).collect()
    assert len({r.params for r in rows}) == points == len(rows)
    assert all(0.5 < r.mean_accuracy <= 1 for r in rows)


def test_large_tables_are_dealt_over_all_cores(spark, monkeypatch):
    df = spark.range(0, 4000, 1, 1).selectExpr("id", "id % 7 AS a", "CASE WHEN id % 5 > 0 THEN id % 3 END AS b")
    assert ML.dealt(df).rdd.getNumPartitions() == 1  # few rows stay as they come
    monkeypatch.setattr(ML, "FEW_ROWS", 100)
    parts = ML.dealt(df).rdd.glom().collect()
    assert len(parts) == spark.sparkContext.defaultParallelism and min(map(len, parts)) > 500
    assert sorted(r.id for p in parts for r in p) == list(range(4000))
    assert ML.dealt(df.repartition(3)).rdd.glom().collect() == parts  # whatever files and tasks they came from
