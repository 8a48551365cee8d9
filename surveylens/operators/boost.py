"""Boosted decision stumps (discrete SAMME, two classes) built from Spark aggregations.

MLlib has no AdaBoost, so the booster is written as DataFrame jobs:

* **bins once.**  Every feature is coded once by its candidate thresholds and the narrow
  coded table is written to the shared checkpoint folder.  A feature of at most
  ``max_bins`` distinct values has a bin per value, so its splits are exact; one with more
  has its quantiles as upper bin edges.  A split keeps the rows of the same bins on the
  same side in training and in scoring.
* **small models in one task.**  A model of at most ``TASK_ROWS`` training rows is boosted by
  one task with the same rules; many of them run side by side.
* **one scan per round for many large models.**  They are boosted side by side.  A task sums, per model
  and bin, the weights of both classes with numpy; Spark adds the tasks' sums, whose
  number is bounded by models x features x bins, whatever the data and their skew.
* **exact best split in Spark.**  Windows over the bins of one (model, feature), at most
  ``max_bins`` rows, give the weighted Gini criterion of every split; one row per model
  comes back.  Ties go to the lowest feature index, then the lowest threshold.
* **no stored weights.**  A row's log-weight is the sum of alpha over the stumps that
  misclassify it: a sum over features of a table indexed by (class, bin), so its cost does
  not grow with the rounds, nothing is rewritten, and a lost executor only repeats its
  share of the current scan.
* **scoring is one projection.**  Stumps on the same feature are merged into one step
  function (a CASE over its sorted thresholds); the ensemble is the sum of these.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveylens.operators.packed import Groups, each_block, in_block, packed, spread, unpacked
from surveylens.session import drop_folder, scratch_path

MAX_BINS = 8192        # candidate thresholds per feature; more distinct values share bins
MOST_CELLS = 1 << 22   # models x bins of one scan's sums
TASK_ROWS = 1 << 20    # training rows of a model that one task boosts


@dataclass
class Stump:
    feature: str | None          # None: a leaf predicting ``left`` for every row
    threshold: float
    left: int                    # class for value <= threshold
    right: int                   # class for value > threshold (or null)
    alpha: float
    error: float


@dataclass
class BoostedStumps:
    features: list[str]
    learning_rate: float
    n_estimators: int
    stumps: list[Stump] = field(default_factory=list)
    stopped: str = ""            # why boosting ended early ("", "perfect", "worse_than_random")

    # ---- scoring ----
    def decision(self, n: int | None = None) -> Column:
        """Sum of alpha * (+1 for class 1, -1 for class 0) over the first ``n`` stumps."""
        return decision_expr(self.stumps[: n if n is not None else len(self.stumps)])

    def prediction(self, n: int | None = None) -> Column:
        return F.when(self.decision(n) > 0, 1).otherwise(0).cast("int")

    def transform(self, df: DataFrame, n: int | None = None) -> DataFrame:
        d = self.decision(n)
        return df.withColumn("decision", d).withColumn(
            "prediction", F.when(F.col("decision") > 0, 1).otherwise(0).cast("int"))

    def feature_importances(self) -> dict[str, float]:
        """alpha-weighted share of stumps splitting on each feature."""
        total = sum(s.alpha for s in self.stumps)
        imp = {f: 0.0 for f in self.features}
        for s in self.stumps:
            if s.feature is not None and total > 0:
                imp[s.feature] += s.alpha / total
        return imp

    # ---- persistence ----
    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "BoostedStumps":
        d = json.loads(text)
        d["stumps"] = [Stump(**s) for s in d["stumps"]]
        return BoostedStumps(**d)


@dataclass
class RealStump:
    """A stump whose leaves hold half the log odds of class 1."""
    feature: str | None          # None: a leaf of ``left_odds`` for every row
    threshold: float
    left_odds: float             # for value <= threshold
    right_odds: float            # for value > threshold (or null)
    error: float


@dataclass
class RealBoostedStumps:
    """SAMME.R: the prediction is the sign of the sum of the leaves' odds."""
    features: list[str]
    learning_rate: float
    stumps: list[RealStump] = field(default_factory=list)

    def transform(self, df: DataFrame, n: int | None = None) -> DataFrame:
        # odds are signed weights: a stump that votes (odds) for class 1 on either side
        halves = []
        for s in self.stumps[: n if n is not None else len(self.stumps)]:
            mean, half = (s.left_odds + s.right_odds) / 2, (s.left_odds - s.right_odds) / 2
            halves.append(Stump(None, 0.0, 1, 1, mean if s.feature else s.left_odds, 0.0))
            if s.feature:
                halves.append(Stump(s.feature, s.threshold, 1, 0, half, 0.0))
        return df.withColumn("decision", decision_expr(halves)).withColumn(
            "prediction", F.when(F.col("decision") > 0, 1).otherwise(0).cast("int"))


def stump_class(s: Stump) -> Column:
    if s.feature is None:
        return F.lit(s.left)
    return F.when(F.col(s.feature) <= F.lit(s.threshold), F.lit(s.left)).otherwise(F.lit(s.right))


def decision_expr(stumps: list[Stump]) -> Column:
    """Ensemble decision as one expression: one step function per feature.

    Boosting reuses the same splits many times; merging stumps per feature keeps the
    expression as long as the number of distinct thresholds, not of rounds.
    """
    const = 0.0
    per_feature: dict[str, dict[float, list[float]]] = {}
    for s in stumps:
        sign_l = 1.0 if s.left == 1 else -1.0
        sign_r = 1.0 if s.right == 1 else -1.0
        if s.feature is None:
            const += s.alpha * sign_l
            continue
        # contribution: alpha*sign_l if x <= t else alpha*sign_r
        # = alpha*sign_r + alpha*(sign_l - sign_r) * [x <= t]
        const += s.alpha * sign_r
        jump = s.alpha * (sign_l - sign_r)
        if jump != 0.0:
            per_feature.setdefault(s.feature, {}).setdefault(s.threshold, []).append(jump)
    expr = F.lit(const)
    for feat, steps in per_feature.items():
        ts = sorted(steps)
        # value <= t_k contributes the sum of jumps of all thresholds >= value
        suffix, acc = [], 0.0
        for t in reversed(ts):
            acc += sum(steps[t])
            suffix.append((t, acc))
        suffix.reverse()
        x = F.col(feat)
        case = None
        for t, v in suffix:
            case = F.when(x <= F.lit(t), F.lit(v)) if case is None else case.when(x <= F.lit(t), F.lit(v))
        expr = expr + case.otherwise(F.lit(0.0))
    return expr


@dataclass
class BoostSpec:
    """One model to boost: its training rows, learning rate and number of rounds."""
    name: str
    train: Column
    learning_rate: float = 1.0
    n_estimators: int = 50


@dataclass(frozen=True)
class Bins:
    """Upper bin edges per feature; ``exact``: a bin per distinct value."""
    features: list[str]
    edges: list[np.ndarray]
    exact: list[bool]

    @property
    def offsets(self) -> np.ndarray:
        """Start of each feature's slots in flat tables: its bins, then one for nulls."""
        return np.concatenate(([0], np.cumsum([len(e) + 1 for e in self.edges])))

    def threshold(self, f: int, left: int, right: int) -> float:
        """Split between bin ``left`` and ``right``, the next one that has rows."""
        e = self.edges[f]
        return float((e[left] + e[right]) / 2) if self.exact[f] else float(e[left])

    def side(self, stump: Stump) -> tuple[int, np.ndarray]:
        """Feature number, and for each of its slots the class that the stump gives it."""
        f = self.features.index(stump.feature)
        left = np.append(self.edges[f] <= stump.threshold, False)
        return f, np.where(left, stump.left, stump.right)


def find_bins(df: DataFrame, features: list[str], max_bins: int, dealt: DataFrame | None = None) -> Bins:
    """Distinct values are counted per feature; those of features with at most ``max_bins`` are
    the bins, the others get quantiles.  ``dealt``: the same rows over more tasks; the quantiles,
    which depend on how rows are dealt, are taken of ``df``."""
    dealt = df if dealt is None else dealt

    def run(batches):
        seen = [np.zeros(0)] * len(features)
        for b in batches:
            for k in range(len(features)):
                if len(seen[k]) <= max_bins:  # one more than max_bins says that they are too many
                    v = b.column(k).drop_null().to_numpy(zero_copy_only=False)
                    seen[k] = np.union1d(seen[k], v[~np.isnan(v)])[:max_bins + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(features)), [len(v) for v in seen]), pa.int32()),
             pa.array(np.concatenate(seen))], names=["fi", "value"])

    values = (dealt.select(*[F.col(f"`{f}`").cast("double") for f in features])
              .mapInArrow(run, "fi int, value double").distinct().persist())
    too_many = [r["fi"] for r in values.groupBy("fi").count().filter(F.col("count") > max_bins).collect()]
    few = values.filter(~F.col("fi").isin(too_many)).collect() if too_many else values.collect()
    values.unpersist()
    held: dict[int, list[float]] = {}
    for r in few:
        held.setdefault(r["fi"], []).append(r["value"])
    edges = [np.sort(np.array(held.get(k, []), float)) for k in range(len(features))]
    exact = [k not in too_many for k in range(len(features))]
    many = [k for k, e in enumerate(exact) if not e]
    if many:
        names = [features[k] for k in many]
        cuts = df.approxQuantile(names, [i / max_bins for i in range(1, max_bins)] + [1.0], 0.25 / max_bins)
        top = dealt.agg(*[F.max(f"`{n}`") for n in names]).first()
        for k, c, high in zip(many, cuts, top, strict=True):
            edges[k] = np.unique(np.append(c, high))  # the last bin is closed by the largest value
    return Bins(list(features), edges, exact)


class CodedTable:
    """Training rows as bin numbers: one column of slots per row, its class, and the models
    whose training part it is in."""

    def __init__(self, df: DataFrame, features: list[str], label: str, specs: list[BoostSpec],
                 max_bins: int) -> None:
        base = df.select(*[F.col(f).cast("double").alias(f) for f in features],
                         F.col(label).cast("int").alias("__y"),
                         *[F.coalesce(s.train, F.lit(False)).alias(f"__t{i}") for i, s in enumerate(specs)])
        dealt = spread(base).persist()  # read for the bins and for the codes
        self.bins = bins = find_bins(base, features, max_bins, dealt)
        self.models = len(specs)
        offsets, edges, n_models = bins.offsets, bins.edges, len(specs)
        self.groups, self.cells_path, self.present = Groups(offsets), None, {}

        def code(batches):
            for b in batches:
                slots = np.zeros((b.num_rows, len(edges)), np.int32)
                for k, e in enumerate(edges):
                    v = b.column(k).to_numpy(zero_copy_only=False)
                    null = np.isnan(v)
                    slots[:, k] = offsets[k] + np.where(null, len(e), np.searchsorted(e, v, "left"))
                used = np.stack([b.column(len(edges) + 1 + i).to_numpy(zero_copy_only=False)
                                 for i in range(n_models)], axis=1).astype(np.uint8)
                y = b.column(len(edges))
                yield pa.RecordBatch.from_arrays(
                    [y, packed(slots), packed(used)], names=["y", "slots", "used"])

        coded = dealt.filter("__y IS NOT NULL").mapInArrow(code, "y int, slots binary, used binary")
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, "boost-codes")
        coded.write.parquet(self.path)
        dealt.unpersist()
        self.rows = self.spark.read.schema(coded.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the written tables."""
        for path in (self.path, self.cells_path):
            if path:
                drop_folder(self.spark, path)

    def cells(self) -> DataFrame:
        """(block): of each batch its classes, training parts and cells of the groups of features,
        as the rounds read them; written once."""
        if self.cells_path is None:
            self.cells_path = scratch_path(self.spark, "boost-cells")
            groups, width = self.groups, len(self.bins.edges)
            names = ["y", "used", *map(str, range(len(groups.members)))]

            def run(batches):
                for b in batches:
                    if b.num_rows:
                        cells = groups.cells(unpacked(b.column("slots"), np.int32, width) - groups.offsets[:-1].astype(np.int32))
                        own = pa.RecordBatch.from_arrays([b.column("y"), b.column("used"), *map(pa.array, cells)], names=names)
                        yield pa.RecordBatch.from_arrays([pa.array([in_block(own)], pa.binary())], names=["block"])

            self.rows.mapInArrow(run, "block binary").write.parquet(self.cells_path)
        return self.spark.read.schema("block binary").parquet(self.cells_path)

    def training_rows(self) -> list[int]:
        """Number of training rows of each model."""
        models = self.models

        def run(batches):
            total = np.zeros(models, np.int64)
            for b in batches:
                if b.num_rows:
                    total += unpacked(b.column("used"), np.uint8, models).sum(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(models), pa.int32()), pa.array(total)], names=["m", "n"])

        out = [0] * models
        for r in self.rows.select("used").mapInArrow(run, "m int, n long").groupBy("m").agg(F.sum("n").alias("n")).collect():
            out[r["m"]] = r["n"]
        return out

    def misses(self, model: int, stumps: list[Stump], table: np.ndarray) -> None:
        """Add alpha to the (class, slot) cells that the stumps get wrong."""
        at = self.bins.offsets
        for s in stumps:
            if s.feature is None:
                table[1 - s.left, 0:at[1]] += s.alpha
                continue
            f, given = self.bins.side(s)
            for y in (0, 1):
                table[y, at[f]:at[f + 1]] += s.alpha * (given != y)

    def with_rows(self, models: list[int]) -> dict[int, np.ndarray]:
        """Whether each slot has training rows of a model; found by one scan for all rounds."""
        if new := [m for m in models if m not in self.present]:
            groups, n_models = self.groups, self.models

            def run(batches):
                held = [[np.zeros(int(np.prod(s)), np.int64) for s in groups.shapes] for _ in new]
                for b in each_block(batches):
                    used = unpacked(b.column("used"), np.uint8, n_models)
                    for own, m in zip(held, new, strict=True):
                        keep = np.flatnonzero(used[:, m])
                        for g, total in enumerate(own):
                            total += np.bincount(b.column(str(g)).to_numpy().take(keep), minlength=len(total))
                total = np.stack([groups.by_bin(own) for own in held])
                i, slot = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(new)[i], pa.int32()), pa.array(slot, pa.int32())],
                                                 names=["m", "slot"])

            found = self.cells().mapInArrow(run, "m int, slot int").distinct().toArrow()
            m, slot = (found.column(c).to_numpy() for c in ("m", "slot"))
            self.present |= {k: np.isin(np.arange(groups.offsets[-1]), slot[m == k]) for k in new}
        return {m: self.present[m] for m in models}

    def sums(self, tables: dict[int, np.ndarray], shift: dict[int, float]) -> DataFrame:
        """(m, fi, bin, w1, w0): weights of both classes per model and bin; bin is null for null
        values.  Only slots with training rows.  A row costs a look-up and a sum per group of
        features: its cell with its class is one number."""
        act, groups, models = sorted(tables), self.groups, self.models
        offsets, width = groups.offsets, len(groups.members)
        sizes = [int(np.prod(s)) for s in groups.shapes]
        present = self.with_rows(act)
        there = [(m, np.flatnonzero(present[m])) for m in act]

        def run(batches):
            logs = {m: [np.concatenate([groups.by_cell(tables[m][c], g) for c in (0, 1)]) for g in range(width)] for m in act}
            changed = {m: [g for g in range(width) if logs[m][g].any()] for m in act}
            held = {m: [np.zeros(2 * n) for n in sizes] for m in act}
            for b in each_block(batches):
                used = unpacked(b.column("used"), np.uint8, models)
                y = b.column("y").to_numpy()
                cells = [np.int64(n) * y + b.column(str(g)).to_numpy() for g, n in enumerate(sizes)]
                for m in act:
                    keep = np.flatnonzero(used[:, m])
                    own = cells if len(keep) == len(y) else [c.take(keep) for c in cells]
                    log_w = np.zeros(len(keep))
                    for g in changed[m]:
                        log_w += logs[m][g].take(own[g])
                    w = np.exp(log_w - shift[m])
                    for g, total in enumerate(held[m]):
                        total += np.bincount(own[g], w, len(total))
            for m, slot in there:
                w0, w1 = (groups.by_bin([t[c * n:(c + 1) * n] for t, n in zip(held[m], sizes, strict=True)]) for c in (0, 1))
                feature = np.searchsorted(offsets, slot, "right") - 1
                at = slot - offsets[feature]
                null = at == np.diff(offsets)[feature] - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), m), pa.int32()), pa.array(feature, pa.int32()),
                     pa.array(at, pa.int32(), mask=null), pa.array(w1[slot]), pa.array(w0[slot])],
                    names=["m", "fi", "bin", "w1", "w0"])

        return (self.cells().mapInArrow(run, "m int, fi int, bin int, w1 double, w0 double")
                .groupBy("m", "fi", "bin").agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0")))

    def hits(self, decisions: dict[tuple, np.ndarray], model_of: dict[tuple, int]) -> dict[tuple, tuple[int, int]]:
        """Right predictions and rows outside a model's training part, for each key's table of
        votes (the constant first, then one per slot); all in one scan."""
        keys, width, models = list(decisions), len(self.bins.edges), self.models

        def run(batches):
            hits = np.zeros((len(keys), 2), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                y = b.column("y").to_numpy()
                slots = unpacked(b.column("slots"), np.int32, width)
                used = unpacked(b.column("used"), np.uint8, models)
                for i, k in enumerate(keys):
                    out = used[:, model_of[k]] == 0
                    votes = decisions[k][0] + decisions[k][1:][slots[out]].sum(1)
                    hits[i] += (int(((votes > 0) == y[out]).sum()), int(out.sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(keys)), pa.int32()), pa.array(hits[:, 0]), pa.array(hits[:, 1])],
                names=["k", "hit", "n"])

        rows = (self.rows.mapInArrow(run, "k int, hit long, n long").groupBy("k")
                .agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).collect())
        return {keys[r["k"]]: (r["hit"], r["n"]) for r in rows if r["n"]}

    def accuracies(self, decisions: dict[tuple, np.ndarray], model_of: dict[tuple, int]) -> dict[tuple, float]:
        return {k: hit / n for k, (hit, n) in self.hits(decisions, model_of).items()}

    def votes(self, stumps: list[Stump]) -> np.ndarray:
        """Signed alphas: a constant, then one number per slot."""
        at = self.bins.offsets
        out = np.zeros(1 + at[-1])
        for s in stumps:
            if s.feature is None:
                out[0] += s.alpha if s.left == 1 else -s.alpha
                continue
            f, given = self.bins.side(s)
            out[1 + at[f]:1 + at[f + 1]] += np.where(given == 1, s.alpha, -s.alpha)
        return out


def fit_boosted_stumps(df: DataFrame, features: list[str], label: str, specs: list[BoostSpec],
                       max_bins: int = MAX_BINS) -> dict[str, BoostedStumps]:
    """Boost every spec's model; one aggregation job per round serves all of them.

    ``max_bins`` bounds the candidate thresholds of a feature: with at most that many
    distinct values its splits are exact, else at that many quantiles.
    """
    coded = CodedTable(df, features, label, specs, max_bins)
    fitted = boost_coded(coded, specs)
    coded.drop()
    return fitted


def boost_coded(coded: CodedTable, specs: list[BoostSpec]) -> dict[str, BoostedStumps]:
    """Each model in a task if its training rows are few, the others side by side by scans."""
    size = coded.training_rows()
    models = {i: BoostedStumps(list(coded.bins.features), s.learning_rate, s.n_estimators)
              for i, s in enumerate(specs)}
    small = [i for i in models if 0 < size[i] <= TASK_ROWS]
    if small:
        _boost_in_tasks(coded, specs, {i: models[i] for i in small})
    _boost_by_scans(coded, specs, {i: m for i, m in models.items() if i not in set(small)})
    return {specs[i].name: m for i, m in models.items()}


def _next_stump(model: BoostedStumps, spec: BoostSpec, stump: Stump, err: float) -> bool:
    """Give the stump its weight and add it to the model; whether boosting goes on."""
    if err <= 0:
        stump.alpha, stump.error = 1.0, 0.0
        model.stumps.append(stump)
        model.stopped = "perfect"
    elif err >= 0.5:
        model.stopped = "worse_than_random"
    else:
        stump.alpha, stump.error = spec.learning_rate * math.log((1 - err) / err), err
        model.stumps.append(stump)
    return not model.stopped


def _boost_by_scans(coded: CodedTable, specs: list[BoostSpec], models: dict[int, BoostedStumps]) -> None:
    tables = {i: np.zeros((2, coded.bins.offsets[-1])) for i in models}
    active = set(models)
    while act := sorted(i for i in active if len(models[i].stumps) < specs[i].n_estimators):
        shift = {i: sum(s.alpha for s in models[i].stumps) / 2 for i in act}
        best = _best_stumps(coded, {i: tables[i] for i in act}, shift)
        for i in act:
            if i not in best:
                active.discard(i)
                models[i].stopped = models[i].stopped or "no_rows"
            elif _next_stump(models[i], specs[i], *best[i]):
                coded.misses(i, models[i].stumps[-1:], tables[i])
            else:
                active.discard(i)


class _TaskRounds:
    """The splits of one model's rows, round by round, in numpy."""

    def __init__(self, bins: Bins, y: np.ndarray, slots: np.ndarray) -> None:
        self.bins, self.y, at = bins, y, bins.offsets
        self.groups = Groups(at)
        self.cells = self.groups.cells(slots - at[:-1].astype(slots.dtype))
        there = self.groups.sums(self.cells, None, None, 1, (None,))[0][0] > 0
        there[at[1:] - 1] = False                                 # nulls are on no split's left
        self.place = np.flatnonzero(there)                        # bins with rows
        self.feature = np.searchsorted(at, self.place, "right") - 1
        self.first = np.flatnonzero(np.append(True, np.diff(self.feature) != 0)) if len(self.place) else self.place
        self.runs = np.diff(np.append(self.first, len(self.place)))
        self.inner = np.append(np.diff(self.feature) == 0, False) if len(self.place) else np.zeros(0, bool)

    def best(self, w: np.ndarray) -> dict:
        by_class = self.groups.sums(self.cells, None, None, 1, (np.where(self.y == 1, w, 0.0), np.where(self.y == 1, 0.0, w)))
        t1, t0 = (float(w[self.y == c].sum()) for c in (1, 0))
        lefts = []
        for sums in by_class:
            run = np.cumsum(sums[0, self.place])
            lefts.append(run - np.repeat(run[self.first] - sums[0, self.place][self.first], self.runs))
        l1, l0 = lefts
        r1, r0 = t1 - l1, t0 - l0
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(l1 + l0 != 0, (l1 ** 2 + l0 ** 2) / (l1 + l0), 0.0)
            right = np.where(r1 + r0 != 0, (r1 ** 2 + r0 ** 2) / (r1 + r0), 0.0)
        score = np.where(self.inner, np.round((left + right) / (t1 + t0), 12), -1.0)
        if not self.inner.any():
            return {"score": -1.0, "t1": t1, "t0": t0}
        k = int(score.argmax())  # the lowest feature, then the lowest bin
        f = int(self.feature[k])
        start = self.bins.offsets[f]
        return {"score": float(score[k]), "fi": f, "bin": int(self.place[k] - start),
                "nxt": int(self.place[k + 1] - start), "l1": float(l1[k]), "l0": float(l0[k]),
                "r1": float(r1[k]), "r0": float(r0[k]), "t1": t1, "t0": t0}


def _boost_in_tasks(coded: CodedTable, specs: list[BoostSpec], models: dict[int, BoostedStumps]) -> None:
    """Boost each model in one task; the stumps come back, models x rounds of them at most."""
    bins, width = coded.bins, len(coded.bins.edges)
    wanted = {i: (specs[i].learning_rate, specs[i].n_estimators) for i in models}

    def run(key, table):
        m = key[0].as_py()
        rate, rounds = wanted[m]
        spec, model = BoostSpec("", None, rate, rounds), BoostedStumps([], rate, rounds)
        y = table.column("y").to_numpy()
        slots = unpacked(table.column("slots"), np.int32, width)
        task, log_w = _TaskRounds(bins, y, slots), np.zeros(len(y))
        while len(model.stumps) < rounds:
            shift = sum(s.alpha for s in model.stumps) / 2
            if not _next_stump(model, spec, *_discrete(bins, task.best(np.exp(log_w - shift)))):
                break
            stump = model.stumps[-1]
            if stump.feature is None:
                miss = y != stump.left
            else:
                f, given = bins.side(stump)
                miss = given[slots[:, f] - bins.offsets[f]] != y
            log_w += stump.alpha * miss
        return pa.table([pa.array([m], pa.int32()), pa.array([model.to_json()])], names=["m", "model"])

    sent = coded.rows.withColumn("m", F.explode(F.array(*[F.lit(i) for i in models]))) \
        .filter(F.expr("substring(used, m + 1, 1) = X'01'")).select("m", "y", "slots")
    # a task a model: few models must not be put together
    for r in sent.repartition(2 * len(models), "m").groupBy("m").applyInArrow(run, "m int, model string").collect():
        found = BoostedStumps.from_json(r["model"])
        models[r["m"]].stumps, models[r["m"]].stopped = found.stumps, found.stopped


def _best_stumps(coded: CodedTable, tables: dict[int, np.ndarray],
                 shift: dict[int, float]) -> dict[int, tuple[Stump, float]]:
    """Best stump and its weighted error for each model."""
    return {m: _discrete(coded.bins, b) for m, b in _best_splits(coded, tables, shift).items()}


def _best_splits(coded: CodedTable, tables: dict[int, np.ndarray], shift: dict[int, float]) -> dict[int, dict]:
    """Best split of each model; one row per model comes back.  A scan sums for as many models
    as its cells allow."""
    most, models = max(1, MOST_CELLS // (3 * int(coded.bins.offsets[-1]))), sorted(tables)
    out: dict[int, dict] = {}
    for low in range(0, len(models), most):
        own = models[low:low + most]
        out |= _best_of(coded, {m: tables[m] for m in own}, shift)
    return out


def _best_of(coded: CodedTable, tables: dict[int, np.ndarray], shift: dict[int, float]) -> dict[int, dict]:
    agg = coded.sums(tables, shift)
    part = Window.partitionBy("m", "fi")
    ordered = part.orderBy(F.col("bin").asc_nulls_first())
    cum = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nn = F.col("bin").isNotNull()
    cand = (agg
            .withColumn("t1", F.sum("w1").over(part)).withColumn("t0", F.sum("w0").over(part))
            .withColumn("l1", F.sum(F.when(nn, F.col("w1")).otherwise(0.0)).over(cum))
            .withColumn("l0", F.sum(F.when(nn, F.col("w0")).otherwise(0.0)).over(cum))
            .withColumn("nxt", F.lead("bin").over(ordered)))
    split = nn & F.col("nxt").isNotNull()
    r1, r0 = F.col("t1") - F.col("l1"), F.col("t0") - F.col("l0")
    lw, rw = F.col("l1") + F.col("l0"), r1 + r0
    score = (try_ratio(F.col("l1") ** 2 + F.col("l0") ** 2, lw) + try_ratio(r1 ** 2 + r0 ** 2, rw)) \
        / (F.col("t1") + F.col("t0"))
    cand = cand.select(
        "m", "fi", "bin", "nxt", "l1", "l0", r1.alias("r1"), r0.alias("r0"), "t1", "t0",
        F.when(split, F.round(score, 12)).otherwise(F.lit(-1.0)).alias("score"))  # -1: no split here
    key = F.struct(F.col("score"), (-F.col("fi")).alias("nfi"), (-F.coalesce("bin", F.lit(-1))).alias("nb"))
    pick = cand.groupBy("m").agg(F.max_by(F.struct(
        "fi", "bin", "nxt", "l1", "l0", "r1", "r0", "t1", "t0", "score"), key).alias("b"))
    return {r["m"]: r["b"].asDict() for r in pick.collect()}


def _discrete(bins: Bins, b: dict) -> tuple[Stump, float]:
    """Stump of class votes, and its weighted error."""
    total = b["t1"] + b["t0"]
    if b["score"] < 0:  # every feature is constant: a leaf
        cls = 1 if b["t1"] > b["t0"] else 0
        return Stump(None, 0.0, cls, cls, 0.0, 0.0), (b["t0"] if cls == 1 else b["t1"]) / total
    left = 1 if b["l1"] > b["l0"] else 0
    right = 1 if b["r1"] > b["r0"] else 0
    miss = (b["l0"] if left == 1 else b["l1"]) + (b["r0"] if right == 1 else b["r1"])
    return Stump(bins.features[b["fi"]], bins.threshold(b["fi"], b["bin"], b["nxt"]),
                 left, right, 0.0, 0.0), miss / total


SMALLEST_SHARE = 2.0 ** -52  # of a class in a leaf, so that odds are finite


def _odds(w1: float, w0: float) -> float:
    share = min(max(w1 / (w1 + w0), SMALLEST_SHARE), 1 - SMALLEST_SHARE)
    return 0.5 * (math.log(share) - math.log(1 - share))


def _real(coded: CodedTable, b: dict) -> RealStump:
    total = b["t1"] + b["t0"]
    if b["score"] < 0:
        odds = _odds(b["t1"], b["t0"])
        return RealStump(None, 0.0, odds, odds, min(b["t1"], b["t0"]) / total)
    miss = min(b["l1"], b["l0"]) + min(b["r1"], b["r0"])
    return RealStump(coded.bins.features[b["fi"]], coded.bins.threshold(b["fi"], b["bin"], b["nxt"]),
                     _odds(b["l1"], b["l0"]), _odds(b["r1"], b["r0"]), miss / total)


def fit_real_stumps(df: DataFrame, features: list[str], label: str, specs: list[BoostSpec],
                    max_bins: int = MAX_BINS) -> dict[str, RealBoostedStumps]:
    """SAMME.R for every spec, one scan a round: a row's log weight falls by learning rate x odds
    of its own class.  Boosting ends with a stump that makes no error, which is kept."""
    coded = CodedTable(df, features, label, specs, max_bins)
    models = {i: RealBoostedStumps(list(features), s.learning_rate) for i, s in enumerate(specs)}
    tables = {i: np.zeros((2, coded.bins.offsets[-1])) for i in models}
    shift, active = {i: 0.0 for i in models}, set(models)
    while act := sorted(i for i in active if len(models[i].stumps) < specs[i].n_estimators):
        best = _best_splits(coded, {i: tables[i] for i in act}, shift)
        for i in act:
            if i not in best:
                active.discard(i)
                continue
            stump = _real(coded, best[i])
            models[i].stumps.append(stump)
            if stump.error <= 0:
                active.discard(i)
                continue
            rate, at = specs[i].learning_rate, coded.bins.offsets
            if stump.feature is None:
                cells, odds = slice(0, at[1]), stump.left_odds
            else:
                f = coded.bins.features.index(stump.feature)
                cells = slice(at[f], at[f + 1])
                left = np.append(coded.bins.edges[f] <= stump.threshold, False)
                odds = np.where(left, stump.left_odds, stump.right_odds)
            tables[i][1, cells] -= rate * odds
            tables[i][0, cells] += rate * odds
            # weights are divided by the largest that any row could have
            shift[i] = float(sum(tables[i][:, at[k]:at[k + 1]].max() for k in range(len(at) - 1)))
    coded.drop()
    return {specs[i].name: m for i, m in models.items()}


def try_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (weights that underflow to nothing)."""
    return F.when(b != 0, a / b).otherwise(0.0)


# ------------------------------------------------------------------ grid ----

def grid_search(df: DataFrame, features: list[str], label: str, n_estimators: list[int],
                learning_rates: list[float], folds: int, fold_col: str = "fold",
                max_bins: int = MAX_BINS) -> tuple[DataFrame, dict]:
    """Cross-validated accuracy for every (n_estimators, learning_rate).

    Rounds are nested, so each (fold, rate) model is boosted once to
    ``max(n_estimators)`` and scored at every prefix; all fold x rate models are
    boosted side by side (one scan per round), and one scan of the coded table scores
    all of them on their folds.  Returns (scores frame, fitted models).
    """
    top = max(n_estimators)
    specs = [BoostSpec(f"{k}|{lr}", F.col(fold_col) != k, lr, top)
             for k in range(folds) for lr in learning_rates]
    coded = CodedTable(df, features, label, specs, max_bins)
    fitted = boost_coded(coded, specs)
    number = {s.name: i for i, s in enumerate(specs)}
    keys = {(k, lr, n): f"{k}|{lr}" for k in range(folds) for lr in learning_rates for n in n_estimators}
    scores = coded.accuracies({key: coded.votes(fitted[name].stumps[:key[2]]) for key, name in keys.items()},
                              {key: number[name] for key, name in keys.items()})
    coded.drop()
    rows = [(float(lr), int(n), float(a)) for (_, lr, n), a in scores.items()]
    long = df.sparkSession.createDataFrame(rows, "learning_rate double, n_estimators long, accuracy double")
    result = (long.groupBy("learning_rate", "n_estimators")
              .agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy")))
    return result, fitted
