"""Boosted stumps: Spark fit equals a brute-force SAMME on a small fixture."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveylens.operators import boost as B


def brute_force_samme(X: pd.DataFrame, y: np.ndarray, rounds: int, lr: float):
    """Reference implementation: exhaustive stump search with the same tie-breaking."""
    n = len(y)
    w = np.full(n, 1.0 / n)
    out = []
    feats = list(X.columns)
    for r in range(rounds):
        best = None
        for fi, f in enumerate(feats):
            vals = np.sort(np.unique(X[f].to_numpy()))
            for a, b in zip(vals[:-1], vals[1:]):
                t = (a + b) / 2
                left = X[f].to_numpy() <= t
                l1, l0 = w[left & (y == 1)].sum(), w[left & (y == 0)].sum()
                r1, r0 = w[~left & (y == 1)].sum(), w[~left & (y == 0)].sum()
                score = round(((l1 ** 2 + l0 ** 2) / (l1 + l0) + (r1 ** 2 + r0 ** 2) / (r1 + r0)) / w.sum(), 12)
                key = (score, -fi, -t)
                if best is None or key > best[0]:
                    best = (key, f, t, 1 if l1 > l0 else 0, 1 if r1 > r0 else 0)
        _, f, t, lc, rc = best
        pred = np.where(X[f].to_numpy() <= t, lc, rc)
        miss = pred != y
        err = w[miss].sum() / w.sum()
        if err <= 0:
            out.append((f, t, lc, rc, 1.0))
            break
        if err >= 0.5:
            break
        alpha = lr * math.log((1 - err) / err)
        out.append((f, t, lc, rc, alpha))
        w = w * np.exp(alpha * miss)
        w = w / w.sum()
    return out


@pytest.fixture(autouse=True, params=[50_000, 0], ids=["task", "scans"])
def both_ways(request, monkeypatch):
    """Every test boosts in a task and by scans."""
    monkeypatch.setattr(B, "TASK_ROWS", request.param)


@pytest.fixture(scope="module")
def fixture(spark):
    rng = np.random.default_rng(7)
    n = 300
    X = pd.DataFrame({"a": rng.integers(0, 6, n).astype(float), "b": rng.integers(0, 3, n).astype(float),
                      "c": np.round(rng.normal(size=n), 2)})
    y = ((X.a >= 3).astype(int) ^ (rng.random(n) < 0.15).astype(int)) | ((X.b == 2) & (X.c > 0.5)).astype(int)
    pdf = X.assign(y=y.astype(int), ID=np.arange(n))
    return X, y.to_numpy(), spark.createDataFrame(pdf)


def test_matches_brute_force(spark, fixture):
    X, y, df = fixture
    want = brute_force_samme(X, y, rounds=6, lr=0.5)
    got = B.fit_boosted_stumps(df, ["a", "b", "c"], "y", [B.BoostSpec("m", F.lit(True), 0.5, 6)])["m"]
    assert len(got.stumps) == len(want)
    for s, (f, t, lc, rc, alpha) in zip(got.stumps, want):
        assert (s.feature, s.left, s.right) == (f, lc, rc)
        assert s.threshold == pytest.approx(t) and s.alpha == pytest.approx(alpha, rel=1e-9)


def test_side_by_side_equals_separate(spark, fixture):
    _, _, df = fixture
    df = df.withColumn("fold", (F.col("ID") % 3).cast("int"))
    specs = [B.BoostSpec(f"{k}", F.col("fold") != k, 1.0, 4) for k in range(3)]
    together = B.fit_boosted_stumps(df, ["a", "b", "c"], "y", specs)
    for k in range(3):
        alone = B.fit_boosted_stumps(df.filter(F.col("fold") != k), ["a", "b", "c"], "y",
                                     [B.BoostSpec("x", F.lit(True), 1.0, 4)])["x"]
        assert [(s.feature, s.threshold, s.left, s.right) for s in together[str(k)].stumps] == \
               [(s.feature, s.threshold, s.left, s.right) for s in alone.stumps]


def test_decision_expression_equals_naive_sum(spark, fixture):
    _, _, df = fixture
    model = B.fit_boosted_stumps(df, ["a", "b", "c"], "y", [B.BoostSpec("m", F.lit(True), 1.0, 8)])["m"]
    naive = sum(F.lit(s.alpha) * F.when(B.stump_class(s) == 1, 1.0).otherwise(-1.0) for s in model.stumps)
    rows = model.transform(df).withColumn("naive", naive).collect()
    assert all(abs(r.decision - r.naive) < 1e-9 for r in rows)
    # prefix scoring uses the first n stumps only
    assert model.transform(df, n=1).select("prediction").distinct().count() <= 2


def test_json_roundtrip(spark, fixture):
    _, _, df = fixture
    model = B.fit_boosted_stumps(df, ["a", "b", "c"], "y", [B.BoostSpec("m", F.lit(True), 1.0, 3)])["m"]
    again = B.BoostedStumps.from_json(model.to_json())
    assert again == model
    imp = model.feature_importances()
    assert sum(imp.values()) == pytest.approx(1.0)


def test_grid_search_rows(spark, fixture):
    _, _, df = fixture
    df = df.withColumn("fold", (F.col("ID") % 2).cast("int"))
    scores, fitted = B.grid_search(df, ["a", "b", "c"], "y", [2, 4], [0.1, 1.0], folds=2)
    rows = scores.collect()
    assert len(rows) == 4 and all(0 <= r.mean_accuracy <= 1 for r in rows)
    assert len(fitted) == 4


@pytest.mark.parametrize("max_bins", [4, 16, 8192])
def test_reported_error_is_the_raw_error(spark, max_bins):
    """A one-round model's weighted error equals the error of its predictions on raw rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    y = (x > 0.37).astype(int) ^ (rng.random(2000) < 0.02)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": rng.integers(0, 3, 2000).astype(float), "y": y}))
    model = B.fit_boosted_stumps(df, ["x", "z"], "y", [B.BoostSpec("m", F.lit(True), 1.0, 1)],
                                 max_bins=max_bins)["m"]
    raw = df.select(F.avg((model.prediction() != F.col("y")).cast("double"))).first()[0]
    assert raw == pytest.approx(model.stumps[0].error, abs=1e-9)


def test_grid_scores_equal_predictions_on_raw_rows(spark, fixture):
    _, _, df = fixture
    df = df.withColumn("fold", (F.col("ID") % 2).cast("int"))
    scores, fitted = B.grid_search(df, ["a", "b", "c"], "y", [2, 5], [0.5], folds=2, max_bins=8)
    for r in scores.collect():
        want = [df.filter(F.col("fold") == k).select(F.avg(
            (fitted[f"{k}|0.5"].prediction(r.n_estimators) == F.col("y")).cast("double"))).first()[0]
            for k in range(2)]
        assert r.mean_accuracy == pytest.approx(sum(want) / 2)


def test_nulls_go_right_in_training_and_scoring(spark):
    df = spark.createDataFrame([(1.0, 0)] * 5 + [(2.0, 1)] * 5 + [(None, 1)] * 3, "x double, y int")
    model = B.fit_boosted_stumps(df, ["x"], "y", [B.BoostSpec("m", F.lit(True), 1.0, 2)])["m"]
    assert model.stopped == "perfect" and model.stumps[0].threshold == 1.5
    assert df.filter(model.prediction() != F.col("y")).count() == 0


def test_constant_features_give_a_leaf(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 1), (None, 0)], "x double, y int")
    stump = B.fit_boosted_stumps(df, ["x"], "y", [B.BoostSpec("m", F.lit(True), 1.0, 1)])["m"].stumps[0]
    assert stump.feature is None and stump.left == 1


def test_rounds_read_blocks_of_cells_only(spark):
    """A round's sums per slot, of features put together and alone, with nulls and parts of the rows."""
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"a": rng.integers(0, 6, n).astype(float), "b": rng.integers(0, 3, n).astype(float),
                        "c": np.round(rng.normal(size=n), 2), "y": rng.integers(0, 2, n), "part": rng.integers(0, 3, n)})
    pdf.loc[::17, "a"] = np.nan
    specs = [B.BoostSpec("all", F.lit(True)), B.BoostSpec("some", F.col("part") > 0), B.BoostSpec("none", F.col("part") > 9)]
    coded = B.CodedTable(spark.createDataFrame(pdf).repartition(3), ["a", "b", "c"], "y", specs, 8192)
    coded.cells()
    coded.rows = None  # what the rounds do not read
    tables = {m: rng.normal(size=(2, coded.bins.offsets[-1])) for m in range(3)}
    shift = {0: 0.5, 1: -0.25, 2: 0.0}
    got = {(r.m, r.fi, r.bin): (r.w1, r.w0) for r in coded.sums(tables, shift).collect()}
    want: dict = {}
    for _, r in pdf.iterrows():
        bins = [None if np.isnan(r[f]) else int(np.searchsorted(coded.bins.edges[k], r[f])) for k, f in enumerate("abc")]
        slots = [coded.bins.offsets[k] + (len(coded.bins.edges[k]) if b is None else b) for k, b in enumerate(bins)]
        for m in ([0, 1] if r.part > 0 else [0]):
            w = math.exp(sum(tables[m][int(r.y), s] for s in slots) - shift[m])
            for k, b in enumerate(bins):
                want.setdefault((m, k, b), [0.0, 0.0])[int(r.y == 0)] += w
    coded.drop()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(tuple(want[k])) for k in want)


def test_a_task_sends_no_more_values_than_tell_that_they_are_too_many(spark, monkeypatch):
    rows = [((float(i % 5) if i % 11 else float("nan")) if i % 7 else None, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3).persist()
    sent = []
    distinct = type(df).distinct

    def counted(self):
        sent.append(self.count())
        return distinct(self)

    monkeypatch.setattr(type(df), "distinct", counted)
    bins = B.find_bins(df, ["a", "b"], 16)
    df.unpersist()
    assert bins.exact == [True, False] and list(bins.edges[0]) == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert len(bins.edges[1]) <= 16 and bins.edges[1][-1] == 2999.0
    assert sent[0] <= 3 * (5 + 17)
