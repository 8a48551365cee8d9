"""Model comparison and grid search over folds, with a resumable store of held-out results.

Every (model, fold) of a comparison or grid is one job (all folds of a model at once where
one scan serves them).  Its results are written to the store as a Parquet folder when it is
done, so that a run that was lost or stopped continues where it was: jobs whose folder is
complete are read, not run.  Jobs of several folds run side by side.

A grid's best point has the largest mean accuracy over folds (what the study's search selects
by); of equal ones the first in the grid's order counts: parameter names ascending, the last
name's values varying fastest.

Edge cases: a store belongs to one table with its folds; a job's name holds its model,
settings and folds, so other grids may share the store; a folder left incomplete is written
anew; an unknown model or parameter is an error.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.operators import boost as B
from surveylens.operators import gradient as G
from surveylens.operators import logistic as L
from surveylens.operators import metrics as M
from surveylens.operators import neighbours as K
from surveylens.operators import trees as T
from surveylens.session import scratch_path

TRAINING_JOB_MODELS = ["Adaboost", "LightGBM"]
MODELS = ["LR", "KNN", "CART", "RF", "Adaboost", "GBM", "XGBoost", "CatBoost", "LightGBM"]

# --------------------------------------------------------------------------
# Default parameters of the compared models, in the study's names.  The
# boosting libraries' growth is stood in for by level-wise trees of equal depth (five levels
# for 31 leaves) with the libraries' penalties and limits.
# --------------------------------------------------------------------------
DEFAULTS = {
    "LR": {"max_iter": 100},
    "KNN": {"n_neighbors": 5},
    "CART": {"max_depth": None, "min_samples_split": 2},
    "RF": {"max_depth": None, "max_features": "sqrt", "min_samples_split": 2, "n_estimators": 100},
    "Adaboost": {"learning_rate": 1.0, "n_estimators": 50},
    "GBM": {"learning_rate": 0.1, "max_depth": 3, "n_estimators": 100},
    "XGBoost": {"learning_rate": 0.3, "max_depth": 6, "n_estimators": 100},
    "CatBoost": {"depth": 6, "iterations": 1000, "learning_rate": 0.1},
    "LightGBM": {"learning_rate": 0.1, "n_estimators": 100},
}
BOOSTERS = {
    "GBM": {},
    "XGBoost": {"l2": 1.0, "least_hessian": 1.0, "prior": False},
    "CatBoost": {"l2": 3.0, "prior": False},
    "LightGBM": {"least_hessian": 1e-3, "least_rows": 20},
}
LIGHTGBM_DEPTH = 5

GRID_JOBS = 10     # folds of a grid side by side: the last ones do not leave cores idle


def grid_points(grid: dict[str, list]) -> list[dict]:
    names = sorted(grid)
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*(grid[n] for n in names))]


def params_text(params: dict) -> str:
    return ", ".join(f"{k}={params[k]}" for k in sorted(params))


class ScoreStore:
    """Held-out results, a Parquet folder for each finished job."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "scores")

    def has(self, name: str) -> bool:
        context = self.spark.sparkContext
        mark = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return mark.getFileSystem(context._jsc.hadoopConfiguration()).exists(mark)

    def fill(self, jobs: dict[str, Callable[[], DataFrame]], parallelism: int = 4) -> list[str]:
        """Run the jobs that are not there yet; their names."""
        todo = [name for name in jobs if not self.has(name)]

        def run(name: str) -> None:
            jobs[name]().write.mode("overwrite").parquet(f"{self.path}/{name}")

        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for done in [pool.submit(run, name) for name in todo]:
                done.result()
        return todo

    def read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])


def job_name(model: str, folds, settings) -> str:
    return f"{model}-{hashlib.md5(repr((folds, settings)).encode()).hexdigest()[:12]}"


class Tables:
    """The forms of one table that the models read, each written when first asked for."""

    def __init__(self, df: DataFrame, features: list[str], label: str, fold_col: str = "fold",
                 key: str = "ID", subtree_rows: int = T.SUBTREE_ROWS, neighbour_rows: int | None = None) -> None:
        self.df, self.features, self.label, self.fold_col, self.key = df, list(features), label, fold_col, key
        self.spark, self.subtree_rows, self.neighbour_rows = df.sparkSession, subtree_rows, neighbour_rows
        self.held: dict[str, object] = {}

    def _form(self, name: str, make: Callable):
        if name not in self.held:
            self.held[name] = make(self.df, self.features, self.label, self.fold_col, self.key)
        return self.held[name]

    def coded(self) -> T.CodedRows:
        return self._form("coded", T.CodedRows)

    def binned(self) -> T.CodedRows:
        return self._form("binned", lambda *a: T.CodedRows(*a, max_bins=G.MAX_BINS))

    def numeric(self) -> L.NumericRows:
        return self._form("numeric", L.NumericRows)

    def prepare(self, models: list[str]) -> None:
        """Write the forms before jobs ask for them side by side."""
        for model in models:
            if model in ("CART", "RF"):
                self.coded()
            elif model in BOOSTERS:
                self.binned()
            elif model in ("LR", "KNN"):
                self.numeric()

    def drop(self) -> None:
        for form in self.held.values():
            form.drop()
        self.held = {}


# ------------------------------------------------------------------- grids ----

def features_per_node(value, width: int) -> int:
    return max(1, int(math.sqrt(width))) if value in ("sqrt", "auto") else int(value)


def _depth(value) -> int:
    return T.UNLIMITED if value is None else int(value)


def _booster(model: str, fold: int, p: dict) -> G.GradientSpec:
    depth = LIGHTGBM_DEPTH if model == "LightGBM" else p["depth" if model == "CatBoost" else "max_depth"]
    return G.GradientSpec(fold, float(p["learning_rate"]), int(depth), **BOOSTERS[model])


def _trees(model: str) -> str:
    return "iterations" if model == "CatBoost" else "n_estimators"


RESULT = "place int, fold int, hits long, n long"


def _named(spark, hits: DataFrame, keys: dict[tuple, list[int]], columns: list[str]) -> DataFrame:
    """``hits`` with the places of the points that have these key columns."""
    rows = [(*k, place) for k, places in keys.items() for place in places]
    types = [f"{c} {t}" for c, t in hits.dtypes if c in columns]
    order = [t.split()[0] for t in types]
    rows = [(*[r[columns.index(c)] for c in order], r[-1]) for r in rows]
    points = spark.createDataFrame(rows, ", ".join([*types, "place int"]))
    return hits.join(F.broadcast(points), order).select(  # a row a grid point
        "place", F.col("fold").cast("int").alias("fold"), "hits", "n")


def grid_jobs(tables: Tables, model: str, points: list[dict], folds: list[int]) -> dict[str, Callable[[], DataFrame]]:
    """Jobs that give (place, fold, hits, n) of every point: the places are those in ``points``."""
    unknown = {p for point in points for p in point} - set(DEFAULTS.get(model, {}))
    if model not in DEFAULTS or unknown:
        raise ValueError(f"{model} has no parameter {', '.join(sorted(unknown))}" if unknown else f"unknown model {model}")
    full = [DEFAULTS[model] | p for p in points]
    spark, width = tables.spark, len(tables.features)

    def places(*keys) -> dict[tuple, list[int]]:
        out: dict[tuple, list[int]] = {}
        for i, p in enumerate(full):
            out.setdefault(tuple(f(p) for f in keys), []).append(i)
        return out

    def cart(fold):
        keys = places(lambda p: _depth(p["max_depth"]), lambda p: p["min_samples_split"])
        depths, splits = (sorted({k[i] for k in keys}) for i in (0, 1))
        hits = T.tree_grid_hits(tables.coded(), fold, depths, splits, tables.subtree_rows)
        return _named(spark, hits.withColumn("fold", F.lit(fold)), keys, ["max_depth", "min_samples_split"])

    def forest(fold):
        keys = places(lambda p: features_per_node(p["max_features"], width), lambda p: p["n_estimators"],
                      lambda p: _depth(p["max_depth"]), lambda p: p["min_samples_split"])
        counts, depths, splits = (sorted({k[i] for k in keys}) for i in (1, 2, 3))
        out = None
        for m in sorted({k[0] for k in keys}):
            spec = T.ForestSpec(fold, features_per_node=m, bootstrap=True, seed=S.MODEL_SEED,
                                max_depth=max(depths), min_split=min(splits))
            part = T.forest_grid_hits(tables.coded(), spec, counts, depths, splits, tables.subtree_rows) \
                .withColumn("m", F.lit(m))
            out = part if out is None else out.unionByName(part)
        return _named(spark, out.withColumn("fold", F.lit(fold)), keys,
                      ["m", "n_estimators", "max_depth", "min_samples_split"])

    def boosting(fold):
        specs = list(dict.fromkeys(_booster(model, fold, p) for p in full))
        keys = places(lambda p: specs.index(_booster(model, fold, p)), lambda p: p[_trees(model)])
        hits = G.boosted(tables.binned(), specs, sorted({k[1] for k in keys}), True, tables.subtree_rows)
        return _named(spark, hits.withColumn("fold", F.lit(fold)), keys, ["model", "n_estimators"])

    def adaboost():
        df = tables.df.withColumnRenamed(tables.fold_col, "fold") if tables.fold_col != "fold" else tables.df
        rates, counts = (sorted({p[c] for p in full}) for c in ("learning_rate", "n_estimators"))
        specs = [B.BoostSpec(f"{k}|{r}", F.col("fold") != k, r, max(counts)) for k in folds for r in rates]
        coded = B.CodedTable(df, tables.features, tables.label, specs, B.MAX_BINS)
        fitted = B.boost_coded(coded, specs)
        number = {s.name: i for i, s in enumerate(specs)}
        wanted = {(k, r, n): f"{k}|{r}" for k in folds for r in rates for n in counts}
        got = coded.hits({key: coded.votes(fitted[name].stumps[:key[2]]) for key, name in wanted.items()},
                         {key: number[name] for key, name in wanted.items()})
        coded.drop()
        keys = places(lambda p: p["learning_rate"], lambda p: p["n_estimators"])
        return spark.createDataFrame([(place, k, hit, n) for (k, r, c), (hit, n) in got.items()
                                      for place in keys.get((r, c), [])], RESULT)

    def logistic():
        keys = places(lambda p: p["max_iter"])
        return _named(spark, L.grid_hits(tables.numeric(), folds, sorted(k[0] for k in keys)), keys, ["max_iter"])

    def neighbours():
        keys = places(lambda p: p["n_neighbors"])
        hits = K.held_out_votes(tables.numeric(), folds, sorted(k[0] for k in keys), True, tables.neighbour_rows)
        return _named(spark, hits, keys, ["n_neighbors"])

    at_once = {"LR": logistic, "KNN": neighbours, "Adaboost": adaboost}
    if model in at_once:
        return {job_name(model, folds, full): at_once[model]}
    by_fold = {"CART": cart, "RF": forest}.get(model, boosting)
    return {job_name(model, k, full): (lambda k=k: by_fold(k)) for k in folds}


def tune(tables: Tables, model: str, grid: dict[str, list], folds: int, store: ScoreStore | None = None) -> DataFrame:
    """(place, model, params, mean_accuracy, std_accuracy) of every point of the grid."""
    points, store = grid_points(grid), store or ScoreStore(tables.spark)
    tables.prepare([model])
    jobs = grid_jobs(tables, model, points, list(range(folds)))
    store.fill(jobs, GRID_JOBS)
    names = tables.spark.createDataFrame([(i, model, params_text(p)) for i, p in enumerate(points)],
                                         "place int, model string, params string")
    return (store.read(list(jobs), RESULT).filter("n > 0").groupBy("place")
            .agg(F.avg(F.col("hits") / F.col("n")).alias("mean_accuracy"),
                 F.stddev_pop(F.col("hits") / F.col("n")).alias("std_accuracy"))
            .join(F.broadcast(names), "place")  # a row a grid point
            .select("place", "model", "params", "mean_accuracy", "std_accuracy"))


def best_point(tuned: DataFrame, grid: dict[str, list]) -> dict:
    # accuracies of equal hits may differ in the last digit by the order of folds
    top = tuned.orderBy(F.round("mean_accuracy", 12).desc(), "place").first()
    return grid_points(grid)[top["place"]]


# -------------------------------------------------------------- comparison ----

SCORED = "model string, fold int, label int, prediction int, score double"


def score_jobs(tables: Tables, model: str, params: dict, folds: list[int],
               name: str | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Jobs that give (model, fold, label, prediction, score) of all held-out rows."""
    p, name = DEFAULTS[model] | params, name or model

    def scored(df: DataFrame, above: float, fold=None) -> DataFrame:
        own = F.col("fold") if fold is None else F.lit(fold)
        return df.select(F.lit(name).alias("model"), own.cast("int").alias("fold"),
                         F.col("y").cast("int").alias("label"),
                         (F.col("score") > above).cast("int").alias("prediction"), "score")

    def cart(fold):
        depth, split = _depth(p["max_depth"]), p["min_samples_split"]
        spec = T.ForestSpec(fold, max_depth=depth, min_split=split)
        rows = T.forest_shares(tables.coded(), spec, [1], [depth], [split], tables.subtree_rows)
        return scored(rows.withColumnRenamed("share", "score"), 0.5, fold)

    def forest(fold):
        depth, split = _depth(p["max_depth"]), p["min_samples_split"]
        spec = T.ForestSpec(fold, features_per_node=features_per_node(p["max_features"], len(tables.features)),
                            bootstrap=True, seed=S.MODEL_SEED, max_depth=depth, min_split=split)
        rows = T.forest_shares(tables.coded(), spec, [p["n_estimators"]], [depth], [split], tables.subtree_rows)
        return scored(rows.withColumnRenamed("share", "score"), 0.5, fold)

    def boosting(fold):
        rows = G.boosted(tables.binned(), [_booster(model, fold, p)], [p[_trees(model)]], False, tables.subtree_rows)
        return scored(rows, 0.0, fold)

    def adaboost():
        df = tables.df.withColumnRenamed(tables.fold_col, "fold") if tables.fold_col != "fold" else tables.df
        specs = [B.BoostSpec(str(k), F.col("fold") != k, p["learning_rate"], p["n_estimators"]) for k in folds]
        fitted = B.fit_boosted_stumps(df, tables.features, tables.label, specs)
        out = None
        for k in folds:
            part = fitted[str(k)].transform(df.filter(F.col("fold") == k)).select(
                F.lit(name).alias("model"), F.lit(k).alias("fold"), F.col(tables.label).cast("int").alias("label"),
                "prediction", F.col("decision").alias("score"))
            out = part if out is None else out.unionByName(part)
        return out

    def logistic():
        paths = L.fit(tables.numeric(), folds, p["max_iter"])
        return scored(L.held_out_scores(tables.numeric(), {k: path.w for k, path in paths.items()}), 0.5)

    def neighbours():
        return scored(K.held_out_votes(tables.numeric(), folds, [p["n_neighbors"]], False, tables.neighbour_rows), 0.5)

    at_once = {"LR": logistic, "KNN": neighbours, "Adaboost": adaboost}
    settings = ("scores", name, sorted(p.items(), key=lambda kv: kv[0]))
    if model in at_once:
        return {job_name(model, folds, settings): at_once[model]}
    by_fold = {"CART": cart, "RF": forest}.get(model, boosting)
    return {job_name(model, k, settings): (lambda k=k: by_fold(k)) for k in folds}


def compare(tables: Tables, candidates: dict[str, tuple[str, dict]], folds: int = S.COMPARISON_FOLDS,
            store: ScoreStore | None = None) -> DataFrame:
    """(model, metric, score): means over folds of the comparison's scores, for each candidate
    {name: (model, parameters that differ from its defaults)}."""
    store = store or ScoreStore(tables.spark)
    tables.prepare([model for model, _ in candidates.values()])
    jobs: dict[str, Callable[[], DataFrame]] = {}
    for name, (model, params) in candidates.items():
        jobs |= score_jobs(tables, model, params, list(range(folds)), name)
    store.fill(jobs, 8)
    per_fold = M.grouped_binary_metrics(store.read(list(jobs), SCORED), ["model", "fold"])
    stack = ", ".join(f"'{m}', {m}" for m in S.COMPARISON_METRICS)
    return (per_fold.selectExpr("model", f"stack({len(S.COMPARISON_METRICS)}, {stack}) AS (metric, score)")
            .groupBy("model", "metric").agg(F.avg("score").alias("score")))


def before_after(tables: Tables, model: str, grid: dict[str, list], folds: int = S.COMPARISON_FOLDS,
                 store: ScoreStore | None = None) -> DataFrame:
    """(model, stage, params, metric, score): cross-validated roc_auc and f1 of the default
    settings (before) and of the grid's best point (after)."""
    store = store or ScoreStore(tables.spark)
    best = best_point(tune(tables, model, grid, folds, store), grid)
    both = {"before": DEFAULTS[model], "after": DEFAULTS[model] | best}
    out = compare(tables, {stage: (model, p) for stage, p in both.items()}, folds, store) \
        .filter(F.col("metric").isin("roc_auc", "f1"))
    text = F.create_map(*[F.lit(x) for stage, p in both.items() for x in (stage, params_text(p))])
    return out.select(F.lit(model).alias("model"), F.col("model").alias("stage"),
                      text[F.col("model")].alias("params"), "metric", "score")
