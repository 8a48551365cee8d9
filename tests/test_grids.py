"""Trees, forests, boosting, logistic regression and neighbours at every grid point against
plain implementations; the distributed levels against the growth in one task; the store."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.operators import boost as B
from surveylens.operators import gradient as G
from surveylens.operators import grids as GR
from surveylens.operators import logistic as L
from surveylens.operators import neighbours as K
from surveylens.operators import trees as T
from surveylens.operators.packed import Groups

FEATURES = ["a", "b", "c", "d"]
ROWS = 240


def sample():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 9, ROWS).astype(float), rng.integers(0, 4, ROWS).astype(float)
    c, d = rng.normal(size=ROWS).round(2), rng.integers(0, 2, ROWS).astype(float)
    y = ((a + 2 * b + 2 * c + rng.normal(size=ROWS) * 3) > 7).astype(int)
    a[rng.random(ROWS) < 0.05] = np.nan
    return pd.DataFrame({"ID": np.arange(ROWS), "a": a, "b": b, "c": c, "d": d, "y": y, "fold": np.arange(ROWS) % 3})


@pytest.fixture(scope="module")
def data():
    return sample()


@pytest.fixture(scope="module")
def frame(spark, data):
    df = spark.createDataFrame(data).withColumn("a", F.when(F.isnan("a"), None).otherwise(F.col("a")))
    return df.repartition(3)


@pytest.fixture(scope="module")
def tables(frame):
    return GR.Tables(frame, FEATURES, "y")


@pytest.fixture(scope="module")
def coded(tables):
    return tables.coded()


def rows_of(coded):
    """rid, y, fold, codes and row number of all rows, by row number."""
    t = coded.rows.orderBy("row").toArrow()
    return (*T.decoded(t, len(coded.features)), t.column("row").to_numpy())


def plain_tree(codes, y, w, key, per_node, max_depth, min_split, depth=0):
    """One recursive tree: (share,) or (share, feature, cut, left, right)."""
    own = w > 0
    codes, y, w = codes[own], y[own], w[own]
    ones, total = int((w * y).sum()), int(w.sum())
    share = ones / total if total else 0.0
    if len(y) < min_split or depth >= max_depth or ones in (0, total):
        return (share,)
    order = T.feature_order(key, codes.shape[1])[0].tolist() if per_node < codes.shape[1] else list(range(codes.shape[1]))

    def best(feats):
        found = None
        for f in feats:
            for cut in np.unique(codes[:, f])[:-1]:
                left = codes[:, f] <= cut
                l1, l0 = float((w * y)[left].sum()), float((w * (1 - y))[left].sum())
                r1, r0 = ones - l1, total - ones - l0
                s = (l1 * l1 + l0 * l0) / (l1 + l0) + (r1 * r1 + r0 * r0) / (r1 + r0)
                if found is None or s > found[0]:
                    found = (s, f, cut)
        return found

    found = best(sorted(order[:per_node])) or next((x for x in (best([f]) for f in order[per_node:]) if x), None)
    if found is None:
        return (share,)
    _, f, cut = found
    left = codes[:, f] <= cut
    keys = T.child_keys(key)
    return (share, f, cut, *(plain_tree(codes[s], y[s], w[s], keys[k:k + 1], per_node, max_depth, min_split, depth + 1)
                             for k, s in enumerate((left, ~left))))


def plain_share(tree, row):
    while len(tree) > 1:
        tree = tree[3] if row[tree[1]] <= tree[2] else tree[4]
    return tree[0]


@pytest.mark.parametrize("subtree_rows", [10_000, 25])
def test_tree_grid_equals_separate_trees(coded, subtree_rows):
    _, y, fold, codes, _ = rows_of(coded)
    depths, splits = [1, 2, 3, 6, T.UNLIMITED], [2, 7, 40]
    got = {(r.max_depth, r.min_samples_split): (r.hits, r.n)
           for r in T.tree_grid_hits(coded, 1, depths, splits, subtree_rows).collect()}
    held, one = fold == 1, np.ones(ROWS, int)
    assert len(got) == 15
    for d in depths:
        for s in splits:
            tree = plain_tree(codes[~held], y[~held], one[~held], T.tree_key(17, 0), 4, d, s)
            hits = sum((plain_share(tree, r) > 0.5) == c for r, c in zip(codes[held], y[held], strict=True))
            assert got[d, s] == (hits, held.sum()), (d, s)


@pytest.mark.parametrize("subtree_rows", [10_000, 25])
def test_forest_grid_equals_separate_forests(coded, subtree_rows):
    rid, y, fold, codes, row = rows_of(coded)
    depths, splits, counts = [2, T.UNLIMITED], [2, 15], [3, 5]
    spec = T.ForestSpec(2, features_per_node=2, bootstrap=True, seed=9, max_depth=T.UNLIMITED, min_split=2)
    got = {(r.row, r.point, r.n_estimators): r.share
           for r in T.forest_shares(coded, spec, counts, depths, splits, subtree_rows).collect()}
    held = fold == 2
    assert len(got) == held.sum() * 4 * 2
    for p, (d, s) in enumerate((d, s) for d in depths for s in splits):
        shares = []
        for t in range(5):
            key = T.tree_key(9, t)
            w = T.bootstrap_weights(key, rid)
            tree = plain_tree(codes[~held], y[~held], w[~held], key, 2, d, s)
            shares.append([plain_share(tree, r) for r in codes[held]])
        for n in counts:
            for i, x in zip(row[held], np.mean(shares[:n], axis=0), strict=True):
                assert got[i, p, n] == pytest.approx(x, abs=1e-9)


def test_bootstrap_weights_are_poisson():
    w = T.bootstrap_weights(T.tree_key(3, 1), np.arange(50_000))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04


def plain_boosting(codes, y, held, spec, rounds):
    """Margins of the held-out rows after each round; recursive trees."""
    train = ~held
    ones, n = y[train].sum(), train.sum()
    margin = np.full(len(y), np.log(ones / (n - ones)) if spec.prior else 0.0)
    out = []

    def tree(rows, g, h, depth):
        gt, ht = g[rows & train].sum(), h[rows & train].sum()
        best = None
        if depth < spec.depth:
            for f in range(codes.shape[1]):
                for cut in np.unique(codes[rows & train, f])[:-1]:
                    left = rows & (codes[:, f] <= cut)
                    right = rows & ~left
                    gl, hl, nl = g[left & train].sum(), h[left & train].sum(), (left & train).sum()
                    gr, hr, nr = gt - gl, ht - hl, (right & train).sum()
                    if min(nl, nr) < spec.least_rows or min(hl, hr) < spec.least_hessian:
                        continue
                    s = G.gain(gl, hl, gr, hr, spec.l2)
                    if s > 0 and (best is None or s > best[0]):
                        best = (s, left, right)
        if best is None:
            margin[rows] += -gt / (ht + spec.l2) * spec.rate
        else:
            tree(best[1], g, h, depth + 1)
            tree(best[2], g, h, depth + 1)

    for _ in range(rounds):
        g, h = G.gradients(margin, y)
        tree(np.ones(len(y), bool), g, h, 0)
        out.append(margin[held].copy())
    return out


SPECS = [G.GradientSpec(0, 0.3, 3), G.GradientSpec(0, 0.1, 2, 1.0, 1.0, 1, False),
         G.GradientSpec(1, 0.2, 4, 0.0, 1e-3, 8), G.GradientSpec(2, 1.0, 1, 3.0, prior=False)]


@pytest.mark.parametrize("task_rows", [10_000, 0])
def test_boosting_stages_equal_plain_boosting(tables, task_rows, monkeypatch):
    monkeypatch.setattr(G, "MARGIN_EVERY", 2)
    coded = tables.binned()
    _, y, fold, codes, row = rows_of(coded)
    got = {(r.model, r.n_estimators, r.row): r.score
           for r in G.boosted(coded, SPECS, [1, 4, 5], False, task_rows).collect()}
    assert len(got) == 3 * sum((fold == s.fold).sum() for s in SPECS)
    for m, spec in enumerate(SPECS):
        margins = plain_boosting(codes, y, fold == spec.fold, spec, 5)
        for n in (1, 4, 5):
            for i, x in zip(row[fold == spec.fold], margins[n - 1], strict=True):
                assert got[m, n, i] == pytest.approx(x, abs=1e-9), (m, n)


def test_boosting_hits(tables):
    coded = tables.binned()
    rows = G.boosted(coded, SPECS, [2, 3], False).collect()
    want = {}
    for r in rows:
        hit, n = want.get((r.model, r.n_estimators), (0, 0))
        want[r.model, r.n_estimators] = (hit + int((r.score > 0) == (r.y == 1)), n + 1)
    for task_rows in (10_000, 0):
        assert {(r.model, r.n_estimators): (r.hits, r.n)
                for r in G.boosted(coded, SPECS, [2, 3], True, task_rows).collect()} == want


def test_logistic_folds_equal_separate_fits(spark, tables, frame):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    data = tables.numeric()
    together = L.fit(data, [0, 1, 2], 60)
    for k in (0, 1, 2):
        alone = L.fit(data, [k], 60)[k]
        assert together[k].iterations == alone.iterations
        assert together[k].w == pytest.approx(alone.w, abs=1e-9)
        n = frame.filter(F.col("fold") != k).count()
        vec = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(frame.fillna(0.0).filter(F.col("fold") != k))
        other = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / n, standardization=False,
                                   maxIter=200, tol=1e-10).fit(vec)
        assert together[k].w[:-1] == pytest.approx(other.coefficients.toArray(), abs=5e-3)
        # a shorter run is a prefix of the longer one
        assert together[k].after(3) == pytest.approx(L.fit(data, [k], 3)[k].w, abs=1e-9)


@pytest.mark.parametrize("most", [1000, 50])
def test_neighbours_equal_brute_force(tables, most):
    data = tables.numeric()
    rows = sorted((r.rid, r.row, r.y, r.fold, np.frombuffer(r.x)) for r in data.rows.collect())
    known = rows[:most]
    got = {(r.row, r.n_neighbors): r.score
           for r in K.held_out_votes(data, [0, 1, 2], [1, 2, 7, 45], False, most).collect()}
    assert len(got) == 4 * ROWS
    for _, row, _, fold, x in rows:
        near = sorted((sum((p - q) ** 2 for p, q in zip(x, z, strict=True)), i, c)
                      for i, (_, _, c, f, z) in enumerate(known) if f != fold)
        for k in (1, 2, 7, 45):
            votes = [c for _, _, c in near[:k]]
            assert got[row, k] == pytest.approx(sum(votes) / len(votes)), (row, k)


def test_every_model_has_its_grid(tables):
    small = {"LR": {"max_iter": [2, 4]}, "KNN": {"n_neighbors": [2, 3]},
             "CART": {"max_depth": [1, None], "min_samples_split": [2, 9]},
             "RF": {"max_depth": [2, None], "max_features": [1, 2, "sqrt"], "min_samples_split": [2, 9],
                    "n_estimators": [2, 4]},
             "Adaboost": {"learning_rate": [0.5, 1.0], "n_estimators": [2, 3]},
             "GBM": {"max_depth": [1, 2], "n_estimators": [2, 4]},
             "XGBoost": {"learning_rate": [0.1, 0.3], "max_depth": [1, 2], "n_estimators": [2, 4]},
             "CatBoost": {"depth": [1, 2], "iterations": [2, 4], "learning_rate": [0.1, 1.0]},
             "LightGBM": {"learning_rate": [0.1, 0.3], "n_estimators": [2, 4]}}
    for model, grid in small.items():
        points = GR.grid_points(grid)
        tuned = {r.place: r for r in GR.tune(tables, model, grid, 3).collect()}
        assert [tuned[i].params for i in range(len(points))] == [GR.params_text(p) for p in points]
        for place in {0, len(points) - 1}:  # a point of the grid equals its model alone
            rows = GR.compare(tables, {"m": (model, points[place])}, 3).collect()
            alone = {r.metric: r.score for r in rows}
            assert tuned[place].mean_accuracy == pytest.approx(alone["accuracy"], abs=1e-9), model
        if model == "RF":  # sqrt of 4 features is 2
            by = {r.params: r.mean_accuracy for r in tuned.values()}
            assert all(by[p] == by[p.replace("max_features=2", "max_features=sqrt")] for p in by)


def test_unknown_settings_are_errors(tables):
    with pytest.raises(ValueError):
        GR.tune(tables, "CART", {"maxDepth": [1]}, 3)
    with pytest.raises(ValueError):
        GR.tune(tables, "Forest", {}, 3)


def test_best_point_is_the_first_of_equals(spark):
    tuned = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7 + 1e-15), (3, 0.6)], "place int, mean_accuracy double")
    assert GR.best_point(tuned, {"b": [1, 2], "a": [5, 6]}) == {"a": 5, "b": 2}


def test_a_stopped_search_goes_on_where_it_was(spark, tables, monkeypatch):
    grid = {"max_depth": [1, 3], "min_samples_split": [2, 5]}
    store, real, ran = GR.ScoreStore(spark), T.tree_grid_hits, []

    def stops(coded, fold, *more):
        ran.append(fold)
        if fold == 2 and ran.count(2) == 1:
            raise RuntimeError("executor lost")
        return real(coded, fold, *more)

    monkeypatch.setattr(T, "tree_grid_hits", stops)
    with pytest.raises(RuntimeError):
        GR.tune(tables, "CART", grid, 3, store)
    again = {r.place: r.mean_accuracy for r in GR.tune(tables, "CART", grid, 3, store).collect()}
    assert sorted(ran) == [0, 1, 2, 2]  # finished folds are read
    assert GR.tune(tables, "CART", grid, 3, store).count() == 4 and len(ran) == 4
    monkeypatch.undo()
    assert again == {r.place: pytest.approx(r.mean_accuracy) for r in GR.tune(tables, "CART", grid, 3).collect()}


def test_before_and_after(tables):
    grid = {"max_depth": [1, 2, 4], "min_samples_split": [2, 30]}
    best = GR.best_point(GR.tune(tables, "CART", grid, 3), grid)
    rows = {(r.stage, r.metric): r for r in GR.before_after(tables, "CART", grid, 3).collect()}
    assert set(rows) == {(s, m) for s in ("before", "after") for m in ("roc_auc", "f1")}
    alone = {r.metric: r.score for r in GR.compare(tables, {"x": ("CART", best)}, 3).collect()}
    assert rows["after", "f1"].score == pytest.approx(alone["f1"])
    assert rows["after", "f1"].params == GR.params_text(best)


def test_odd_tables(spark, frame):
    one = GR.Tables(frame.withColumn("y", F.lit(1)), FEATURES, "y")  # a single class
    empty = GR.Tables(frame.limit(0), FEATURES, "y")
    grids = {"CART": {"max_depth": [1, None]}, "RF": {"n_estimators": [2]}, "XGBoost": {"n_estimators": [2]},
             "GBM": {"n_estimators": [2]}, "KNN": {"n_neighbors": [3]}, "LR": {"max_iter": [3]}}
    for model, grid in grids.items():
        assert {r.mean_accuracy for r in GR.tune(one, model, grid, 3).collect()} == {1.0}, model
        assert GR.tune(empty, model, grid, 3).collect() == [], model


def test_published_grids():
    sizes = {k: len(GR.grid_points(g)) for k, g in S.COMPARISON_GRIDS.items()}
    assert sizes == {"KNN": 48, "CART": 532, "RF": 72, "XGBoost": 24, "LightGBM": 8}
    assert {k: (len(GR.grid_points(g)), folds) for k, (g, folds) in S.MODEL_GRIDS.items()} == {
        "Adaboost": (9, 10), "XGBoost": (8, 10), "LR": (3, 10), "CatBoost": (27, 10), "RF": (180, 5), "LightGBM": (8, 10)}


@pytest.mark.parametrize("kind", ["spread", "ties", "huge"])
def test_neighbours_by_a_product_are_those_measured_feature_by_feature(kind):
    draw = np.random.default_rng(3)
    x, points = draw.normal(size=(60, 7)) + 1e6, draw.normal(size=(300, 7)) + 1e6
    if kind == "ties":
        x, points = draw.integers(0, 3, (60, 7)).astype(float), draw.integers(0, 3, (300, 7)).astype(float)
    if kind == "huge":
        x[3], points[5, 1] = 1e200, np.inf
    fold, folds, classes, k = draw.integers(0, 3, 60), draw.integers(0, 3, 300), draw.integers(0, 2, 300), 9
    votes, voters = K.nearest_votes(x, fold, (points, classes, folds), k)
    measured = 0
    for i in range(len(x)):
        with np.errstate(over="ignore"):
            d = np.zeros(300)
            for f in range(7):
                d += (x[i, f] - points[:, f]) ** 2
        d[folds == fold[i]] = np.inf
        near = [j for j in np.argsort(d, kind="stable")[:k] if np.isfinite(d[j])]
        measured += len(near)
        want = np.cumsum([classes[j] for j in near])
        assert votes[i, :len(near)].tolist() == want.tolist()
        assert voters[i].tolist() == [min(n, len(near)) for n in range(1, k + 1)]
    assert measured
    if kind != "huge":  # only the few rows near the edge are measured again
        rough, slack = K.rough_distances(x, points, (points * points).sum(1))
        exact = ((x[:, None] - points[None]) ** 2).sum(2)
        assert (np.abs(rough - exact) <= slack[:, None]).all()


def test_sums_of_groups_of_features_are_those_of_each_feature():
    draw = np.random.default_rng(5)
    bins = [3, 7, 7, 2, 900, 7, 7, 5]
    offsets = np.concatenate(([0], np.cumsum(bins)))
    codes = np.stack([draw.integers(0, b, 400) for b in bins], axis=1).astype(np.uint16)
    w, node, rows = draw.integers(-50, 50, 400) / 64, draw.integers(0, 3, 150), draw.permutation(400)[:150]
    groups = Groups(offsets)
    assert len(groups.members) < len(bins) and sorted(sum(groups.members, [])) == list(range(len(bins)))
    for some, at, k in ((None, None, 1), (rows, node, 3)):
        own = np.arange(400) if some is None else some
        place = np.zeros(400, int) if at is None else at
        for weight, got in zip((w, None), groups.sums(groups.cells(codes), some, at, k, (w, None)), strict=True):
            for f, b in enumerate(bins):
                want = np.zeros((k, b))
                np.add.at(want, (place, codes[own, f]), 1.0 if weight is None else weight[own])
                assert (got[:, offsets[f]:offsets[f + 1]] == want).all()


def test_models_of_half_a_million_rows_take_no_scan_a_round(monkeypatch):
    def scan(*_):
        raise AssertionError("a scan")

    monkeypatch.setattr(G, "LargeBoosting", scan)
    monkeypatch.setattr(T, "_level_splits", scan)
    scanned = []
    monkeypatch.setattr(B, "_boost_in_tasks", lambda *_: None)
    monkeypatch.setattr(B, "_boost_by_scans", lambda coded, specs, models: scanned.extend(models))

    class Rows:
        features, bins = ["a"], B.Bins(["a"], [np.arange(3.0)], [True])

        def training_rows(self, fold=None):
            return 540_000

    tops = T.grow_tops(Rows(), T.ForestSpec(0), range(2), T.SUBTREE_ROWS)
    assert all(len(top.n) == 1 and not top.done[0] for top in tops.values())
    Rows.training_rows = lambda self, fold=None: [540_000]
    B.boost_coded(Rows(), [B.BoostSpec("m", None)])
    assert not scanned and G.TASK_ROWS >= 540_000


def test_each_model_and_each_group_of_trees_has_a_task_of_its_own(tables, monkeypatch):
    specs = [G.GradientSpec(0, 0.1 * k, 2) for k in range(1, 10)]
    rows = G.boosted(tables.binned(), specs, [1], False).withColumn("task", F.spark_partition_id())
    assert len({(r.model, r.task) for r in rows.collect()}) == len({r.task for r in rows.collect()}) == 9
    monkeypatch.setattr(T, "TREES_A_TASK", 1)
    spec = T.ForestSpec(0, features_per_node=2, bootstrap=True)
    shares = T.held_out_shares(tables.coded(), spec, range(9), [3], [2], False)
    assert len({r.task for r in shares.select(F.spark_partition_id().alias("task")).collect()}) == 9


@pytest.mark.parametrize("cells_a_row", [0, 8, 1000])
def test_bins_counted_or_sorted_are_those_of_each_node(cells_a_row, monkeypatch):
    monkeypatch.setattr(T, "CELLS_A_ROW", cells_a_row)
    draw = np.random.default_rng(4)
    at, bins = draw.choice([0, 2, 3, 3, 3, 3, 3], 300), np.array([5, 9, 700, 40])  # node 1 has no row
    code, w, y = draw.integers(0, bins[at]), draw.integers(1, 18, 300), draw.integers(0, 2, 300)
    want = {}
    for a, c, weight, one in zip(at, code, w, y, strict=True):
        total, ones = want.get((a, c), (0, 0))
        want[a, c] = (total + weight, ones + weight * one)
    node, bin_, sums = T.occupied_bins(code, at, w * np.where(y == 1, 1 + T.CLASS_UNIT, 1.0), 4, bins)
    assert list(zip(node, bin_, strict=True)) == sorted(want)
    assert [divmod(s, T.CLASS_UNIT)[::-1] for s in sums] == [want[k] for k in sorted(want)]


def test_levels_of_a_scan_in_several_sums(coded, monkeypatch):
    spec = T.ForestSpec(1, 2, 2, True, max_depth=4)
    whole = [T.tree_nodes(coded, spec, t) for t in range(2)]
    monkeypatch.setattr(T, "ADDED_ROWS", 1)
    assert [T.tree_nodes(coded, spec, t) for t in range(2)] == whole


def test_a_large_node_counts_no_bins_one_by_one(coded, monkeypatch):
    """Sums of a level and hits of a tree's leaves cost a feature and a leaf, not a node's feature and a row's point."""
    calls, real = [], np.bincount
    held = T.held_out_shares(coded, T.ForestSpec(1), range(1), list(range(1, 20)), list(range(2, 30)), True)
    assert held.count() == 532
    y, end = np.array([1, 0, 1, 1]), np.array([0, 0, 2, 2])
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = T.leaf_hits(np.array([[0.4, 0.6], [0.0, 0.0], [0.5, 1.0]]), end, y)
    assert got.column("hits").to_pylist() == [1, 3] and got.column("n").to_pylist() == [4, 4] and len(calls) == 2


def test_all_rows_of_the_other_folds_are_neighbours(spark):
    """24,000 rows in pairs that are far from all others: the nearest is the partner, whatever its hash."""
    draw = np.random.default_rng(6)
    n = 24_000
    y = np.repeat(draw.integers(0, 2, n // 2), 2)
    pairs = pd.DataFrame({"ID": draw.permutation(n), "a": np.repeat(draw.permutation(n // 2) * 10.0, 2),
                          "b": np.arange(n) % 2 * 0.5, "y": y, "fold": np.arange(n) % 2})
    tables = GR.Tables(spark.createDataFrame(pairs), ["a", "b"], "y")
    tuned = GR.tune(tables, "KNN", {"n_neighbors": [1]}, 2).collect()
    assert [r.mean_accuracy for r in tuned] == [1.0]
    tables.drop()


def test_neighbours_over_chunks_and_slabs_equal_brute_force(spark, frame, monkeypatch):
    for name, rows in (("CHUNK_ROWS", 60), ("SLAB_ROWS", 90), ("BLOCK_ROWS", 16), ("OWN_ROWS", 7),
                       ("FEW_POINTS", 9), ("MOST_POINTS", 40)):
        monkeypatch.setattr(K, name, rows)
    # keys repeat or are null, and half of the rows have equals at equal distances
    odd = frame.withColumn("ID", F.when(F.col("ID") % 3 > 0, F.col("ID") % 5)).withColumn("c", F.round("c"))
    data = GR.Tables(odd.unionByName(odd.filter("b < 2")), FEATURES, "y").numeric()
    rows = sorted((r.rid, r.row, r.y, r.fold, np.frombuffer(r.x)) for r in data.rows.collect())
    got = {(r.row, r.n_neighbors): r.score for r in K.held_out_votes(data, [0, 2], [1, 4, 300], False).collect()}
    assert len(got) == 3 * sum(fold != 1 for _, _, _, fold, _ in rows)
    for _, row, _, fold, x in rows:
        if fold != 1:
            near = sorted((sum((p - q) ** 2 for p, q in zip(x, z, strict=True)), i, c)
                          for i, (_, _, c, f, z) in enumerate(rows) if f != fold)
            for k in (1, 4, 300):
                assert got[row, k] == pytest.approx(np.mean([c for _, _, c in near[:k]])), (row, k)
    data.drop()


def test_votes_of_the_nearest_are_written_once(spark, frame, monkeypatch):
    made, real = [], K._write_votes
    monkeypatch.setattr(K, "_write_votes", lambda data, folds, k, most: made.append(k) or real(data, folds, k, most))
    tables = GR.Tables(frame, FEATURES, "y")
    assert GR.before_after(tables, "KNN", {"n_neighbors": [2, 3, 9]}, 3).count() == 4
    assert made == [9]
    assert GR.tune(tables, "KNN", {"n_neighbors": [11]}, 3).count() == 1 and made == [9, 11]
    tables.drop()


def test_models_of_a_grid_share_the_scans_of_its_large_nodes(frame, monkeypatch):
    grid, scans, real = {"max_depth": [1, 2, 30], "min_samples_split": [2, 30, 60]}, [], T._level_splits
    monkeypatch.setattr(T, "_level_splits", lambda *a: scans.append(1) or real(*a))
    large = GR.Tables(frame, FEATURES, "y", subtree_rows=40)
    tuned = {r.place: r.mean_accuracy for r in GR.tune(large, "CART", grid, 3).collect()}
    levels = len(scans)
    for place in (1, 4, 8):
        rows = GR.compare(large, {"m": ("CART", GR.grid_points(grid)[place])}, 3).collect()
        assert {r.metric: r.score for r in rows}["accuracy"] == pytest.approx(tuned[place], abs=1e-9)
    GR.before_after(large, "CART", grid, 3)
    assert levels and len(scans) == levels
    # a top that was cut short does not serve a larger tree
    short = GR.Tables(frame, FEATURES, "y", subtree_rows=40)
    GR.compare(short, {"m": ("CART", {"max_depth": 1})}, 3)
    monkeypatch.undo()
    small = GR.before_after(GR.Tables(frame, FEATURES, "y"), "CART", grid, 3).collect()
    for tables in (large, short):
        got = {(r.stage, r.metric): r.score for r in GR.before_after(tables, "CART", grid, 3).collect()}
        assert got == {(r.stage, r.metric): pytest.approx(r.score, abs=1e-9) for r in small}
