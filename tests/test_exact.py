"""Exact splits, stratified folds, p-values and the real boosting variant against plain ones."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveylens.operators import boost as B
from surveylens.operators import profile as P
from surveylens.operators import split as SP


def digest(seed, key):
    return 0 if key is None else int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16)


def test_stratified_folds_differ_by_one_row(spark):
    rows = [(i, None if i % 11 == 0 else "ab"[i % 5 < 2]) for i in range(303)]
    df = spark.createDataFrame(rows, "ID long, y string").repartition(7)
    got = {r.ID: r.fold for r in SP.with_stratified_folds(df, 5, "y").collect()}
    assert len(got) == 303
    for c in (None, "a", "b"):
        own = sorted((digest(17, i), i) for i, y in rows if y == c)
        assert [got[i] for _, i in own] == [k % 5 for k in range(len(own))]


@pytest.mark.parametrize("n", [0, 1, 5, 10, 303])
def test_exact_split_sizes(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "ID long")
    got = [r.ID for r in SP.exact_train(df, "t").filter("t").collect()]
    assert len(got) == n - math.ceil(0.4 * n - 1e-9) == math.floor(0.6 * n + 1e-9)
    assert sorted(got) == sorted(sorted(range(n), key=lambda i: (digest(46, i), i))[:len(got)])


def test_ranks_with_null_and_repeated_keys(spark):
    keys = [None, None, "a", "a", "b", "c"]
    df = spark.createDataFrame([(k,) for k in keys], "ID string")
    rows = SP.with_rank(df, "place", []).collect()
    assert sorted(r.place for r in rows) == list(range(6))
    order = sorted(keys, key=lambda k: (digest(46, k), k is not None, k or ""))
    assert [r.ID for r in sorted(rows, key=lambda r: r.place)] == order


def test_p_values_equal_erfc(spark):
    z = [0.0, 1e-9, -0.5, 1.0, 1.96, -2.5, 2.828, 2.829, 3.5, 5.0, -8.0, 20.0, 37.0, 60.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    for r in df.select("z", P.normal_two_sided_p(F.col("z")).alias("p")).collect():
        if r.z is None:
            assert r.p is None
        elif r.z != r.z:
            assert r.p != r.p
        else:
            assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-11, abs=1e-300)


def plain_real(x, y, rounds, rate):
    w, out = np.full(len(y), 1.0 / len(y)), []
    for _ in range(rounds):
        best = None
        for fi in range(x.shape[1]):
            values = np.unique(x[:, fi])
            for a, b in zip(values[:-1], values[1:]):
                left = x[:, fi] <= (a + b) / 2
                sums = [w[s & (y == c)].sum() for s in (left, ~left) for c in (1, 0)]
                l1, l0, r1, r0 = sums
                score = round(((l1**2 + l0**2) / (l1 + l0) + (r1**2 + r0**2) / (r1 + r0)) / w.sum(), 12)
                if best is None or (score, -fi, -a) > best[0]:
                    best = ((score, -fi, -a), fi, (a + b) / 2, sums)
        _, fi, t, (l1, l0, r1, r0) = best
        odds = []
        for a, b in ((l1, l0), (r1, r0)):
            share = min(max(a / (a + b), 2.0 ** -52), 1 - 2.0 ** -52)
            odds.append(0.5 * (math.log(share) - math.log(1 - share)))
        out.append((fi, t, *odds))
        own = np.where(x[:, fi] <= t, odds[0], odds[1])
        w = w * np.exp(-rate * own * (2 * y - 1))
        w /= w.sum()
        if min(l1, l0) + min(r1, r0) <= 0:
            break
    return out


@pytest.mark.parametrize("rate", [1.0, 0.3])
def test_real_stumps_equal_plain_ones(spark, rate):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 5, 300), rng.integers(0, 9, 300), rng.normal(size=300).round(1)]).astype(float)
    y = ((x[:, 0] + x[:, 1] * 0.5 + x[:, 2] + rng.normal(size=300)) > 4).astype(int)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    df = spark.createDataFrame(pdf)
    model = B.fit_real_stumps(df, ["a", "b", "c"], "y", [B.BoostSpec("m", F.lit(True), rate, 6)])["m"]
    want = plain_real(x, y, 6, rate)
    assert [(s.feature, pytest.approx(s.threshold), pytest.approx(s.left_odds, abs=1e-6),
             pytest.approx(s.right_odds, abs=1e-6)) for s in model.stumps] == [("abc"[f], *r) for f, *r in want]
    total = sum(np.where(x[:, f] <= t, lo, ro) for f, t, lo, ro in want)
    got = model.transform(df).select("a", "b", "c", "decision").toPandas()
    assert got.decision.to_numpy() == pytest.approx(total, abs=1e-6)


def test_real_stumps_of_a_perfect_and_a_constant_feature(spark):
    df = spark.createDataFrame([(float(i), 1.0, int(i > 4)) for i in range(10)], "a double, b double, y int")
    perfect = B.fit_real_stumps(df, ["a", "b"], "y", [B.BoostSpec("m", F.lit(True), 1.0, 5)])["m"]
    assert len(perfect.stumps) == 1 and perfect.transform(df).filter("prediction <> y").count() == 0
    constant = B.fit_real_stumps(df, ["b"], "y", [B.BoostSpec("m", F.lit(True), 1.0, 3)])["m"]
    assert constant.stumps[0].feature is None and constant.transform(df).count() == 10


def test_many_models_in_groups_equal_one_group(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.integers(0, 9, 200).astype(float), "fold": np.arange(200) % 4,
                                             "b": rng.normal(size=200).round(1), "y": rng.integers(0, 2, 200)}))
    specs = [B.BoostSpec(str(k), F.col("fold") != k, 1.0, 3) for k in range(4)]
    whole = B.fit_boosted_stumps(df, ["a", "b"], "y", specs)
    monkeypatch.setattr(B, "MOST_CELLS", 1)
    assert B.fit_boosted_stumps(df, ["a", "b"], "y", specs) == whole


def test_nan_is_no_value_of_a_quantile(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert P.quantiles(df, ["x"], [0.5]).first().value == 2.0


def test_a_saved_pipeline_scores_alike(spark):
    from pyspark.ml import Pipeline, PipelineModel

    from conftest import SF_SMALL
    from surveylens.plans.pipeline import StumpBooster, SurveyPrep
    from surveylens.session import scratch_path
    from surveylens.sources.tables import survey_view
    raw = survey_view(spark, SF_SMALL)
    plan, fitted = scratch_path(spark, "pipeline"), scratch_path(spark, "pipeline-model")
    Pipeline(stages=[SurveyPrep(), StumpBooster(nEstimators=2, learningRate=0.5)]).write().save(plan)
    again = Pipeline.load(plan)
    assert again.getStages()[1].getOrDefault("nEstimators") == 2
    model = again.fit(raw)
    model.write().save(fitted)
    loaded = PipelineModel.load(fitted)
    assert [s.fitted for s in loaded.stages] == [s.fitted for s in model.stages]
    assert len(loaded.stages[1].fitted.stumps) == 2
    unlabelled = raw.drop("satisfaction")
    assert loaded.transform(unlabelled).select("ID", "decision").exceptAll(
        model.transform(raw).select("ID", "decision")).count() == 0
    assert loaded.transform(raw.limit(0)).collect() == []
