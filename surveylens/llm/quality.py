"""Document quality from a linear-chain conditional random field over lines.

Every line has a feature vector from its own characters and words and from its
neighbouring lines.  The field has two states (good, bad); exact forward-backward
recursions give each line's marginal, and the length-weighted mean of a document's
marginals is its score.

Training: line labels are their document's label.  A bounded sample of labelled
documents (``sample_docs``, a documented parameter) is drawn by hash; Spark computes
their features, and the field (a few dozen weights) is fitted on that sample by
full-batch gradient steps.  Scoring runs in the tasks that read the documents; the only
thing sent to them is the weights.  Work arrays stay within a few MB of text at a time.

Edge cases: a null or empty text is one empty line; labels that are null or contradict
each other for one document are not learnt from; without labels of both kinds every
score is 0.5; repeated rows are scored separately; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylens.llm.common import load, text_bytes, text_slices

N_OWN = 14      # features of a line by itself
N_FEATURES = 1 + N_OWN + 2 * 7 + 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _class_table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars.encode(), np.uint8)] = True
    return t


_UPPER = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class_table("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0xC0)
_DIGIT = _class_table("0123456789")
_SPACE = _class_table(" \t\n\v\f\r")
_SYMBOL = _class_table("#$%&*@^~+=<>/\\_{}[]")
_BANG = _class_table("!?")
_BAR = _class_table("|")
_STOP = _class_table(".,;:")
_TAIL = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)


def line_features(raw: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, code points and document number of every line of the documents whose
    concatenated UTF-8 bytes are ``raw``.  Every document has at least one line."""
    n_docs = len(doc_ends) - 1
    breaks = np.flatnonzero(raw == 10)
    # a document's lines end at its line breaks and at its own end
    ends = np.concatenate((breaks, doc_ends[1:]))
    order = np.argsort(np.concatenate((2 * breaks, 2 * doc_ends[1:] - 1)), kind="stable")
    doc = np.concatenate((np.searchsorted(doc_ends[1:], breaks, "right"), np.arange(n_docs)))[order]
    ends = ends[order]
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    starts = np.where(first, doc_ends[doc], np.concatenate(([0], ends[:-1] + 1)))
    n = len(ends)

    def count(flags):
        c = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
        return (c[ends] - c[starts]).astype(np.float64)

    size = count(~_TAIL[raw])
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    at = doc_ends[:-1]
    at = at[at < len(raw)]
    begins[at] = ~space[at]
    letters, upper = count(_LETTER[raw]), count(_UPPER[raw])
    words = count(begins)
    # words as hashes: positions in the word times a fixed odd number, summed over its bytes
    w_at = np.flatnonzero(begins)
    n_unique = np.zeros(n)
    repeats = np.zeros(n)
    line_hash = np.zeros(n, np.uint64)
    if len(w_at):
        codes = np.where(space, 0, raw).astype(np.uint64)
        number = np.cumsum(begins) - 1
        place = np.arange(len(raw)) - w_at[np.maximum(number, 0)]
        place[space] = 0
        codes = (codes + np.uint64(1)) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX)
        codes[space] = 0
        h = np.add.reduceat(codes, w_at)
        h ^= h >> np.uint64(29)
        w_line = np.searchsorted(ends, w_at, "right")
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (w_line[1:] == w_line[:-1])))
        repeats = np.bincount(w_line[same], minlength=n).astype(np.float64)
        by = np.lexsort((h, w_line))
        new = np.concatenate(([True], (h[by][1:] != h[by][:-1]) | (w_line[by][1:] != w_line[by][:-1])))
        n_unique = np.bincount(w_line[by][new], minlength=n).astype(np.float64)
        lines, at = np.unique(w_line, return_index=True)
        line_hash[lines] = np.add.reduceat(
            h * (np.uint64(2) * (w_at - starts[w_line]).astype(np.uint64) + np.uint64(1)), at)
    length = np.maximum(size, 1)
    wordy = np.maximum(words, 1)
    own = np.stack([
        np.log1p(size) / 5, upper / np.maximum(letters, 1), count(_DIGIT[raw]) / length,
        count(_SYMBOL[raw]) / length, np.minimum(count(_BANG[raw]) / wordy, 1),
        np.minimum(count(_BAR[raw]) / wordy, 1), np.minimum(count(_STOP[raw]) / wordy, 1),
        repeats / wordy, n_unique / wordy, letters / length, np.log1p(words) / 4,
        np.minimum((letters / wordy) / 10, 2), (words == 0).astype(float),
        (upper > 0.5 * letters).astype(float)], axis=1)
    before = np.where(first, -1, np.arange(n) - 1)
    after = np.concatenate((np.where(first[1:], -1, np.arange(1, n)), [-1]))
    picked = own[:, [1, 3, 4, 5, 7, 8, 9]]
    near = [np.where((k >= 0)[:, None], picked[k], 0.0) for k in (before, after)]
    equal = [((k >= 0) & (line_hash == line_hash[k]) & (words == words[k])).astype(float)
             for k in (before, after)]
    x = np.concatenate([np.ones((n, 1)), own, *near, np.stack(equal, 1)], axis=1)
    return x, size, doc


@dataclass(frozen=True)
class LineField:
    """weights: evidence for "good" per feature; change: score of a pair of unlike
    neighbours (like pairs score 0); scale and shift: logistic calibration of the
    documents' mean marginals."""

    weights: np.ndarray
    change: float
    scale: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """P(line is good), by forward-backward over each document's lines."""
        return _forward_backward(x @ self.weights, doc, self.change)[0]

    def scores(self, x: np.ndarray, size: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Length-weighted mean marginal of each document, calibrated."""
        return 1 / (1 + np.exp(-(self.scale * _logit(self.raw(x, size, doc, n_docs)) + self.shift)))

    def raw(self, x, size, doc, n_docs) -> np.ndarray:
        weight = size + 1e-6
        return (np.bincount(doc, self.marginals(x, doc) * weight, minlength=n_docs)
                / np.bincount(doc, weight, minlength=n_docs))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _soft(a, b):
    return np.logaddexp(a, b)


def _forward_backward(u: np.ndarray, doc: np.ndarray, change: float):
    """Marginals of "good" and the expected number of unlike neighbours, for chains given
    by runs of equal ``doc``.  Messages are log-odds; all chains advance together."""
    n = len(u)
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    length = np.diff(np.concatenate((start, [n])))
    by = np.argsort(-length, kind="stable")
    start, length = start[by], length[by]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right") if n else []

    def through(m):  # message through one transition
        return _soft(m, change) - _soft(m + change, 0.0)

    f, b = np.zeros(n), np.zeros(n)
    for t, k in enumerate(alive):
        at = start[:k] + t
        f[at] = u[at] if t == 0 else u[at] + through(f[at - 1])
    for t in range(len(alive) - 2, -1, -1):
        at = start[:alive[t + 1]] + t
        b[at] = through(u[at + 1] + b[at + 1])
    p = 1 / (1 + np.exp(-np.clip(f + b, -60, 60)))
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    left, right = f[inner], (u + b)[inner + 1]
    like = np.stack([left + right, np.zeros(len(inner))])
    unlike = np.stack([left + change, right + change])
    total = np.logaddexp.reduce(np.concatenate([like, unlike]), axis=0)
    pairs = np.exp(np.logaddexp.reduce(unlike, axis=0) - total).sum() if len(inner) else 0.0
    return p, pairs


def fit_field(x: np.ndarray, size: np.ndarray, doc: np.ndarray, good: np.ndarray, steps: int = 300,
              rate: float = 0.1, l2: float = 1e-4) -> LineField:
    """Penalised maximum likelihood by Adam on standardised features.  ``good`` has a label
    per document; documents weigh equally, whatever their number of lines."""
    if not len(x) or good.all() or not good.any():
        return LineField(np.zeros(x.shape[1]), 0.0)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    mean[0], spread[0] = 0.0, 1.0
    z, label = np.where(spread > 1e-6, (x - mean) / spread, 0.0), good[doc]
    w, change = np.zeros(x.shape[1]), 0.0
    weight = 1.0 / np.bincount(doc)[doc]
    n_docs = weight.sum()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    inner = max(1, int((doc[1:] == doc[:-1]).sum()))
    for t in range(1, steps + 1):
        p, pairs = _forward_backward(z @ w, doc, change)
        g = np.append(z.T @ ((p - label) * weight) / n_docs + l2 * w, pairs / inner + 10 * l2 * change)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, change = w - step[:-1], max(-3.0, min(0.0, change - step[-1]))
    weights = np.where(spread > 1e-6, w / spread, 0.0)
    weights[0] -= (weights * mean).sum()
    field = LineField(weights, change)
    # calibration: one-feature logistic regression by Newton steps
    s = _logit(field.raw(x, size, doc, len(good)))
    design, beta = np.stack([s, np.ones(len(s))], 1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        h = design.T @ (design * (p * (1 - p) + 1e-6)[:, None]) / len(s) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (p - good) / len(s) + 1e-3 * (beta - np.array([1.0, 0.0])))
        beta = beta - np.clip(step, -1, 1)
    return LineField(weights, change, float(max(beta[0], 0.05)), float(beta[1]))


def _features_of(sample: DataFrame, text_col: str) -> DataFrame:
    def run(batches):
        for b in text_slices(batches, text_col):
            x, size, doc = line_features(*text_bytes(b.column(text_col)))
            x = np.concatenate([size[:, None], x], axis=1)
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
            rows = [x[cuts[k]:cuts[k + 1]].astype(np.float32).tobytes() for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("good"), pa.array(rows, pa.binary())],
                                             names=["good", "features"])

    return sample.select("good", text_col).mapInArrow(run, "good int, features binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_docs: int = 3000) -> LineField:
    """Fit on at most ``sample_docs`` labelled documents, drawn by hash of their id."""
    known = (labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col)
             .agg(F.min(label_col).cast("int").alias("good"), F.max(label_col).alias("most"))
             .filter("good = most").drop("most")
             .orderBy(F.xxhash64(id_col), id_col).limit(sample_docs))
    sample = docs.select(id_col, text_col).join(F.broadcast(known), id_col).dropDuplicates([id_col])
    rows = sorted((r["good"], bytes(r["features"])) for r in _features_of(sample, text_col).collect())
    parts = [np.frombuffer(f, np.float32).reshape(-1, 1 + N_FEATURES) for _, f in rows]
    if not parts:
        return LineField(np.zeros(N_FEATURES), 0.0)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    x = np.concatenate(parts).astype(np.float64)
    return fit_field(x[:, 1:], x[:, 0], doc, np.array([float(g) for g, _ in rows]))


def score_documents(docs: DataFrame, field: LineField, text_col: str = "text",
                    name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and ``name`` (0 to 1, higher is better), which no column of
    ``docs`` may be called."""
    keep = docs.columns
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches):
        for b in text_slices(batches, text_col):
            x, size, doc = line_features(*text_bytes(b.column(text_col)))
            score = field.scores(x, size, doc, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.clip(score, 0.0, 1.0), pa.float64())], names=[*keep, name])

    return docs.mapInArrow(run, schema)


THRESHOLD = 0.3


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def learnt_field(spark: SparkSession, sf_dir: str) -> LineField:
    """The field learnt from the rows of ``labels`` that are not held out."""
    labels = load(spark, sf_dir, "labels", "doc_id", "quality").filter(~held_out())
    return train(load(spark, sf_dir, "documents", "doc_id", "text"), labels)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = learnt_field(spark, sf_dir)
    scored = score_documents(load(spark, sf_dir, "documents", "doc_id", "text"), field)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                         F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
