"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample (``sample`` vectors, drawn by hash): k-means, and
lists that grow beyond twice the mean are split, so posting lists are balanced.  Every
vector is indexed: it goes to the list of its nearest centroid and, near a boundary, to
further lists whose centroids are hardly farther.  Centroids are found through a
neighbour graph in memory, walked best-first.  A query searches the lists whose centroids
are within a ratio of its nearest one's distance; the ratio is the one that reaches
``recall`` on the sample, measured against brute force there.

The number of lists follows the number of vectors (``list_size`` a list) up to ``most_lists``
and half the sample.  A query's nearest vectors of the sample are found first: they bound its
answer from above, so a block returns only what lies within that distance; nothing else can
be among the nearest.

Equal vectors form one class, indexed once, whose smallest ids stand for it; so a vector
that a third of all rows share costs no more than another.  Posting lists are cut into
blocks of bounded size, each searched by all queries of the list with matrix products;
the best of every block are merged by Spark, with exact distances in double precision.

Edge cases: vectors that are null, all zero, or hold null or non-finite components, and
vectors whose number of components is not the usual one, take no part; rows that repeat
an id and its vector count once; with fewer than k candidates all are returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveylens.llm.common import load, materialise


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0)


def _nearest(x: np.ndarray, centroids: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Nearest centroid of each row, a part of the rows at a time."""
    return np.concatenate([_square_distances(x[i:i + rows], centroids).argmin(1)
                           for i in range(0, len(x), rows)])


def _first(d: np.ndarray, n: int, but: np.ndarray) -> np.ndarray:
    """Columns of each row's ``n - 1`` smallest values (all, if fewer) but column ``but``."""
    d[np.arange(len(d)), but] = np.inf
    return np.argsort(d, axis=1, kind="stable")[:, :min(n - 1, d.shape[1] - 1)]


def fit_centroids(x: np.ndarray, n_lists: int, rounds: int = 12, seed: int = 8) -> np.ndarray:
    """k-means; lists of more than twice the mean size are split in two, empty ones refilled."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(n_lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        owner = _nearest(x, centroids)
        sizes = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        large = np.argsort(-sizes)
        for empty, big in zip(np.flatnonzero(~full), large, strict=False):
            centroids[empty] = x[rng.choice(np.flatnonzero(owner == big))]
    owner = _nearest(x, centroids)
    sizes = np.bincount(owner, minlength=len(centroids))
    extra = []
    for big in np.flatnonzero(sizes > 2 * max(1.0, sizes.mean())):
        own = x[owner == big]
        parts = own[rng.choice(len(own), 2, replace=False)].copy()
        for _ in range(5):
            side = _nearest(own, parts)
            for s in (0, 1):
                if (side == s).any():
                    parts[s] = own[side == s].mean(0)
        centroids[big] = parts[0]
        extra.append(parts[1])
    return np.concatenate([centroids, np.array(extra)]) if extra else centroids


@dataclass(frozen=True)
class ListIndex:
    """Centroids, their neighbour graph, and the distance ratio that queries search."""

    centroids: np.ndarray
    graph: np.ndarray        # for each centroid the numbers of some others
    ratio: float

    @staticmethod
    def build(x: np.ndarray, n_lists: int, degree: int = 16, recall: float = 0.97, k: int = 10,
              replicas: int = 3, near: float = 1.03, probes: int = 256) -> ListIndex:
        centroids = fit_centroids(x, n_lists)
        n = len(centroids)
        nearest = np.concatenate([_first(_square_distances(centroids[i:i + 512], centroids), degree + 1, np.arange(i, min(n, i + 512)))
                                  for i in range(0, n, 512)])
        rng = np.random.default_rng(1)
        far = rng.integers(0, n, (n, 4))  # a few long links, and a ring that connects everything
        graph = np.concatenate([nearest, far, np.roll(np.arange(n), 1)[:, None]], axis=1)
        index = ListIndex(centroids, graph, 1.0)
        # the ratio at which the sample's own neighbours are found
        queries = x[:: max(1, len(x) // probes)]
        best = np.concatenate([np.argsort(_square_distances(queries[i:i + 32], x), axis=1)[:, 1:k + 1]
                               for i in range(0, len(queries), 32)])
        lists = index.lists_of(x, replicas, near)
        reach = np.sqrt(_square_distances(queries, centroids))
        reach /= np.maximum(reach.min(1, keepdims=True), 1e-12)
        needed = [min(reach[q, c] for c in lists[v]) for q in range(len(queries)) for v in best[q]]
        ratio = float(np.quantile(needed, recall)) if needed else 1.0
        return ListIndex(centroids, graph, max(1.0, ratio) * (1 + 1e-9))

    def walk(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids met by a best-first walk of the graph (inf: not met); it
        ends when every centroid within ``ratio`` of the nearest one met is expanded."""
        c = self.centroids
        d = np.full((len(x), len(c)), np.inf)
        open_ = np.zeros_like(d, bool)
        seeds = np.arange(0, len(c), max(1, len(c) // 8))
        d[:, seeds] = np.sqrt(_square_distances(x, c[seeds]))
        open_[:, seeds] = True
        rows = np.arange(len(x))
        while len(rows):
            reach = np.where(open_[rows], d[rows], np.inf)
            at = reach.argmin(1)
            go = reach[np.arange(len(rows)), at] <= np.maximum(ratio, 1.05) * d[rows].min(1)
            rows, at = rows[go], at[go]
            open_[rows, at] = False
            near = self.graph[at]
            new = ~np.isfinite(d[rows[:, None], near])
            r, j = np.nonzero(new)
            who, cell = rows[r], near[r, j]
            d[who, cell] = np.sqrt(((x[who] - c[cell]) ** 2).sum(1))
            open_[who, cell] = True
        return d

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids met by a best-first walk that ends when all of them are
        expanded: distances and numbers, nearest first."""
        c, rows = self.centroids, np.arange(len(x))
        beam = min(beam, len(c))
        seeds = np.arange(0, len(c), max(1, int(len(c) / max(beam, len(c) ** 0.5))))
        d = _square_distances(x, c[seeds])
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        d, at = np.take_along_axis(d, order, 1), seeds[order]
        done = np.zeros(at.shape, bool)
        while len(rows):
            todo = np.where(done[rows], np.inf, d[rows])
            pick = todo.argmin(1)
            go = np.isfinite(todo[np.arange(len(rows)), pick])
            rows, pick = rows[go], pick[go]
            done[rows, pick] = True
            near = np.sort(self.graph[at[rows, pick]], axis=1)
            new = np.ones(near.shape, bool)
            new[:, 1:] = near[:, 1:] != near[:, :-1]
            new &= ~(near[:, :, None] == at[rows][:, None, :]).any(2)
            gap = x[rows][:, None, :] - c[near]
            far = np.where(new, np.einsum("rnd,rnd->rn", gap, gap), np.inf)
            all_d = np.concatenate([d[rows], far], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            all_at = np.concatenate([at[rows], near], axis=1)
            all_done = np.concatenate([done[rows], ~new], axis=1)
            d[rows], at[rows], done[rows] = (np.take_along_axis(v, order, 1) for v in (all_d, all_at, all_done))
        return np.sqrt(d), at

    def lists_of(self, x: np.ndarray, replicas: int = 3, near: float = 1.03, rows: int = 512) -> list[list[int]]:
        """Lists that each vector is posted to: the nearest centroid's, then those within
        ``near`` of its distance that are not closer to a centroid already taken."""
        out = []
        for i in range(0, len(x), rows):
            for far, at in zip(*self.nearest(x[i:i + rows], 8 * replicas), strict=True):
                taken = [int(at[0])]
                for f, c in zip(far[1:], at[1:], strict=True):
                    if not f <= near * far[0] or len(taken) == replicas:
                        break
                    gap = self.centroids[taken] - self.centroids[c]
                    if (np.sqrt((gap * gap).sum(1)) >= f).all():
                        taken.append(int(c))
                out.append(taken)
        return out

    def searched(self, x: np.ndarray, rows: int = 256) -> list[np.ndarray]:
        """Lists within the index's ratio of each vector's nearest centroid."""
        out = []
        for i in range(0, len(x), rows):
            d = self.walk(x[i:i + rows], self.ratio)
            out += [np.flatnonzero(row <= m) for row, m in zip(d, self.ratio * d.min(1), strict=True)]
        return out


def nearest_of(x: np.ndarray, some: np.ndarray, k: int, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Distances and row numbers of ``k`` of the nearest vectors in ``some`` (all, if fewer)."""
    k, far, at = min(k, len(some)), [], []
    for i in range(0, len(x), rows):
        part = x[i:i + rows]
        best = np.argpartition(_square_distances(part, some), k - 1, axis=1)[:, :k]
        gap = part[:, None, :] - some[best]
        far.append(np.sqrt((gap * gap).sum(2)))
        at.append(best)
    return np.concatenate(far), np.concatenate(at)


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0))


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id",
                       vector_col: str = "embedding", k: int = 10, sample: int = 20_000,
                       list_size: int = 256, most_lists: int = 4096, block: int = 4096,
                       query_block: int = 4096, replicas: int = 3, near: float = 1.03) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest rows found for each row that ``is_query``
    selects (a condition on the column "id")."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    first = Window.partitionBy("v").orderBy("id")
    classes = materialise(
        rows.dropDuplicates(["id", "v"]).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= k + 1)
        .groupBy("v").agg(F.min("id").alias("class"), F.sort_array(F.collect_list("id")).alias("ids")),
        "vector-classes")
    n = classes.count()
    taken = classes.select("class", "v").orderBy(F.xxhash64("class"), "class").limit(sample).collect()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double") \
            .withColumnRenamed("id", id_col)
    x = _matrix([r["v"] for r in taken])
    taken = [(r["class"],) for r in taken]
    index = ListIndex.build(x, int(max(1, min(most_lists, len(x) // 2, n // list_size))), k=k,
                            replicas=replicas, near=near)
    some = x[:max(k + 1, (16 << 20) // x[0].nbytes)]  # sent to the tasks: 16 MB at most, or k + 1 vectors
    names = np.array([r[0] for r in taken], np.int64)[:len(some)]
    queries = materialise(rows.filter(is_query).dropDuplicates(["id", "v"]).select("id", "v")
                          .join(classes.select("v", "class"), "v").select("id", "class", "v"), "vector-queries")
    asked = queries.groupBy("class").agg(F.first("v").alias("v"))

    def post(batches):
        for b in batches:
            lists = index.lists_of(_matrix(b["v"]), replicas, near) if len(b) else []
            yield pd.DataFrame({"list": [c for own in lists for c in own]}, dtype="int64").assign(
                **{"class": np.repeat(b["class"].to_numpy(), [len(o) for o in lists]),
                   "v": [v for v, own in zip(b["v"], lists, strict=True) for _ in own]})

    def probe(batches):
        for b in batches:
            for i in range(0, len(b), 256):  # a query's vector is repeated for each of its lists
                part = b.iloc[i:i + 256]
                lists = index.searched(_matrix(part["v"]))
                times = [len(o) for o in lists]
                yield pd.DataFrame({"list": np.concatenate(lists).astype("int64")}).assign(
                    **{"class": np.repeat(part["class"].to_numpy(), times),
                       "v": [v for v, own in zip(part["v"], lists, strict=True) for _ in own],
                       "most": np.repeat(part["most"].to_numpy(), times)})

    def start(batches):
        for b in batches:
            if len(b):
                far, at = nearest_of(_matrix(b["v"]), some, k + 1)
                yield b[["class", "v"]].assign(
                    most=far.max(1) if far.shape[1] > k else np.inf, found=list(names[at]), score=list(far))

    schema = "list long, class long, v array<double>"
    posted = materialise(classes.select("class", "v").mapInPandas(post, schema), "vector-lists")
    # a row a list, at most twice ``most_lists``
    sizes = F.broadcast(posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
    posted = posted.join(sizes, "list").select("list", "class", "v", F.pmod(
        F.xxhash64("class"), F.col("blocks")).alias("block"))
    known = materialise(asked.mapInPandas(
        start, "class long, v array<double>, most double, found array<long>, score array<double>"), "vector-starts")
    probing = materialise(known.select("class", "v", "most").mapInPandas(probe, schema + ", most double")
                          .join(sizes, "list"), "vector-probes")
    parts = F.broadcast(probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("parts")))
    probed = probing.join(parts, "list").select(
        "list", "class", "v", "most", F.pmod(F.xxhash64("class"), F.col("parts")).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    # every block of a list's vectors meets every block of its queries
    posted = posted.join(parts, "list").select("list", "class", "v", "block", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = {"class": [], "found": [], "score": []}
        if len(q) and len(p):
            a, b = _matrix(q["v"]), _matrix(p["v"])
            own, ids = q["class"].to_numpy(), p["class"].to_numpy()
            limit = q["most"].to_numpy()
            slack = 1e-9 * (1.0 + (b * b).sum(1).max())  # of squares of differences by products
            for s in range(0, len(a), 256):
                d = _square_distances(a[s:s + 256], b)
                inside = d <= (limit[s:s + 256] ** 2 + slack + 1e-9 * (a[s:s + 256] ** 2).sum(1))[:, None]
                for i in np.flatnonzero(inside.any(1)):
                    cand = np.flatnonzero(inside[i])
                    exact = np.sqrt(((b[cand] - a[s + i]) ** 2).sum(1))
                    order = np.lexsort((ids[cand], exact))[:k + 1]
                    out["class"].append(np.full(len(order), own[s + i]))
                    out["found"].append(ids[cand][order])
                    out["score"].append(exact[order])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    near_by = (probed.groupBy("list", "block", "part").cogroup(posted.groupBy("list", "block", "part"))
               .applyInPandas(search, "class long, found long, score double"))
    near_by = near_by.unionByName(known.select("class", F.explode(F.arrays_zip("found", "score")).alias("m"))
                                  .select("class", "m.found", "m.score"))
    best = (near_by.groupBy("class", "found").agg(F.min("score").alias("score"))
            .withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("score", "found")))
            .filter(F.col("r") <= k + 1))
    found = (best.join(classes.select(F.col("class").alias("found"), "ids"), "found")
             .select("class", "score", F.explode("ids").alias("id"))
             .withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("score", "id")))
             .filter(F.col("r") <= k + 1)
             .groupBy("class").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("all")))
    other = F.slice(F.filter("all", lambda m: m["id"] != F.col("query_id")), 1, k)
    return (queries.select(F.col("id").alias("query_id"), "class").join(found, "class")
            .select("query_id", F.posexplode(other).alias("p", "m"))
            .select("query_id", (F.col("p") + 1).alias("rank"), F.col("m.id").alias(id_col),
                    F.col("m.score").alias("score")))


def op8_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(load(spark, sf_dir, "embeddings", "vec_id", "embedding"),
                              F.col("id") % 100 == 0)
