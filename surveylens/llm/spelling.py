"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Two words of one edit share at least the first or the last half of the shorter one.  So every
word stands in sorted lists by (way, m): way 0 as it is, way 1 backwards, each for m = its
own length and the length below; a list holds the words of m and m + 1 code points.  A word
of m code points scans that list only where its first m // 2 code points are shared, which
finds each pair once (way 1 leaves out those that way 0 finds).

The scan goes along the sorted list with the edit matrix's rows of the current entry, kept
in a band of three cells.  An entry takes over the rows of the prefix that it shares with
the entry before it and adds the others; as soon as a row exceeds one edit, all entries that
share that prefix are skipped.  All queries of a block walk side by side in numpy.

The lists are range-sorted by Spark and cut into blocks of at most 8,192 words, or of fewer
where words are long, so that a block's table is bounded.  A directory of the blocks' first
and last words is collected: blocks grow with the vocabulary so that the full ones number at
most 50,000 (beside one for the end of each list and partition).  A word is sent to every
block with words of its prefix, unless the block's shared prefix exceeds one edit.  A block
that many words are sent to is repeated for each part of them; no group grows with the data.

A word's form is its near word of largest count, if that is at least twice its own; roots are
found by doubling pointers along the forms, whose counts double with each step, so that a
few rounds suffice.

Edge cases: a null or empty text has no words; a null id counts as an empty one; repeated
rows count each; a table without words, or without near words, is no special case; very long
runs are words like others; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylens.llm.common import LOWER, UPPER, Tables, ascii_lower, load, materialise, shuffle_partitions

SHORTEST = 5          # code points of a word
LEAST_COUNT = 3       # occurrences of a word
EVERY = 97            # a run whose crc32 this divides loses a code point
BLOCK_WORDS = 8192    # of a block
WORD_CELLS = 64       # a block's table has this many cells a word
MOST_BLOCKS = 50_000  # full ones
DIRECTORY_CHARS = 64  # of a first or last word


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the whole corpus, after the deletions."""
    # a run below the least length cannot become a word
    runs = F.regexp_extract_all(F.col(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))
    one = (docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("r"))
           .select("i", ascii_lower(F.col("r")).alias("r"))
           .withColumn("h", F.crc32(F.concat("i", F.lit(":"), "r").cast("binary"))))
    at = (F.col("h") % F.length("r")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substring(F.col("r"), F.lit(1), at),
                                                    F.substring(F.col("r"), at + 2, F.length("r")))
                  ).otherwise(F.col("r"))
    return (one.select(word.alias("word")).filter(F.length("word") >= SHORTEST)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT))


def list_entries(words: DataFrame) -> DataFrame:
    """(way, m, key, n): the places of the words in the sorted lists."""
    size = F.length("word")
    ms = F.when(size > SHORTEST, F.array(size - 1, size)).otherwise(F.array(size))
    key = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    return (words.select("word", "n", F.explode(ms).alias("m"))
            .select("word", "n", "m", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
            .select("way", "m", key.alias("key"), "n"))


def cut_blocks(entries: DataFrame, block_words: int) -> DataFrame:
    """The entries with their block: neighbours of one list, at most ``block_words`` of them."""
    def run(batches):
        from pyspark import TaskContext
        block, way, m, held = (TaskContext.get().partitionId() << 32) - 1, None, None, 0
        for b in batches:
            ways, ms = b.column("way").to_numpy(), b.column("m").to_numpy()
            out = np.empty(b.num_rows, np.int64)
            cuts = np.flatnonzero((np.diff(ways) != 0) | (np.diff(ms) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if low == high:
                    continue
                if (ways[low], ms[low]) != (way, m):
                    way, m, held, block = ways[low], ms[low], 0, block + 1
                most = max(1, min(block_words, block_words * WORD_CELLS // (int(m) + 1)))
                number = held + np.arange(high - low)
                out[low:high] = block + number // most
                block, held = int(block + number[-1] // most), int(number[-1] % most)
                held += 1
                if held == most:
                    held, block = 0, block + 1
            yield pa.RecordBatch.from_arrays([pa.array(out), *b.columns], names=["block", *b.schema.names])

    schema = T.StructType([T.StructField("block", T.LongType()), *entries.schema.fields])
    return entries.mapInArrow(run, schema)


def code_points(words: list[str], width: int) -> np.ndarray:
    """A row of code points for each word, zeros behind it."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def shared_lengths(table: np.ndarray) -> np.ndarray:
    """Code points that each row shares with the one before; 0 for the first and behind the last."""
    out = np.zeros(len(table) + 1, np.int64)
    same = table[1:] == table[:-1]
    out[1:-1] = np.where(same.all(1), table.shape[1], same.argmin(1))
    return out


class EditRows:
    """Rows of the edit matrices of many queries against growing prefixes: for a prefix of d
    code points, the distances to the query's first d - 1, d and d + 1.  Distances above 2
    are held as 2."""

    def __init__(self, queries: np.ndarray, depth: int, width: int) -> None:
        self.query = np.pad(queries, ((0, 0), (1, 3)))
        self.rows = np.full((len(queries), width + 2, 3), 2, np.uint8)
        self.rows[:, depth] = (1, 0, 1)  # the first ``depth`` code points are shared

    def extend(self, q: np.ndarray, d: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Add the rows of prefixes of d + 1 code points that end in ``symbol``; their minima."""
        old = self.rows[q, d]
        before = np.minimum(old[:, 1] + 1, old[:, 0] + (self.query[q, d] != symbol))
        at = np.minimum(np.minimum(old[:, 2], before) + 1, old[:, 1] + (self.query[q, d + 1] != symbol))
        after = np.minimum(at + 1, old[:, 2] + (self.query[q, d + 2] != symbol))
        new = np.minimum(np.stack([before, at, after], axis=1), 2).astype(np.uint8)
        self.rows[q, d + 1] = new
        return new.min(1)


def scan_list(table: np.ndarray, sizes: np.ndarray, queries: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) pairs of one edit between queries of m code points and the sorted entries
    (of m or m + 1) that share their first m // 2."""
    k, n = m // 2, len(table)
    shared = shared_lengths(table)
    heads = np.ascontiguousarray(table[:, :k].astype(">u4")).view(f"S{4 * k}").ravel()
    wanted = np.ascontiguousarray(queries[:, :k].astype(">u4")).view(f"S{4 * k}").ravel()
    place, end = np.searchsorted(heads, wanted, "left"), np.searchsorted(heads, wanted, "right")
    # first entry behind i that shares fewer than d code points with the one before it
    skip = np.full((m + 2, n + 1), n, np.int64)
    for d in range(k + 1, m + 2):
        other = np.where(shared[:n] < d, np.arange(n), n)
        skip[d, :n] = np.minimum.accumulate(np.append(other[1:], n)[::-1])[::-1]
    rows = EditRows(queries, k, m + 1)
    q = np.flatnonzero(place < end)
    i, end, d = place[q], end[q], np.full(len(q), k)
    found_q, found_i = [], []
    while len(q):
        whole = d == sizes[i]
        if whole.any():
            at = np.flatnonzero(whole)
            hit = at[rows.rows[q[at], d[at], m - sizes[i[at]] + 1] == 1]
            found_q.append(q[hit])
            found_i.append(i[hit])
            i[at] += 1
        more = np.flatnonzero(~whole)
        least = rows.extend(q[more], d[more], table[i[more], d[more]])
        d[more] += 1
        over = more[least > 1]
        i[over] = skip[d[over], i[over]]
        moved = whole
        moved[over] = True
        alive = i < end
        d = np.where(moved, shared[i], d)
        if not alive.all():
            q, i, d, end = q[alive], i[alive], d[alive], end[alive]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_i])


def near_pairs(listed: pa.Table, asked: pa.Table) -> pa.Table:
    """(word, n, near, near_n) of the queries sent to one block; both directions where the near
    word is longer, as it does not ask here."""
    names = ["word", "n", "near", "near_n"]
    empty = pa.table([pa.array([], t) for t in (pa.string(), pa.int64()) * 2], names=names)
    if not listed.num_rows or not asked.num_rows:
        return empty
    way, m = listed.column("way")[0].as_py(), listed.column("m")[0].as_py()
    keys, ns = np.array(listed.column("key").to_pylist(), object), listed.column("n").to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, ns = keys[order], ns[order]
    table, sizes = code_points(list(keys), m + 1), np.array([len(x) for x in keys])
    own, own_n = asked.column("key").to_pylist(), asked.column("n").to_numpy()
    queries = code_points(own, m)
    q, i = scan_list(table, sizes, queries, m)
    k = m // 2
    if way:  # pairs that share their first half too are found by the other way
        tails = table[i[:, None], sizes[i][:, None] - k + np.arange(k)]
        keep = (tails != queries[q][:, m - k:]).any(1)
        q, i = q[keep], i[keep]
    own = np.array(own, object)
    longer = sizes[i] > m
    word, near = np.concatenate([own[q], keys[i][longer]]), np.concatenate([keys[i], own[q][longer]])
    n, near_n = np.concatenate([own_n[q], ns[i][longer]]), np.concatenate([ns[i], own_n[q][longer]])
    turn = (lambda x: [w[::-1] for w in x]) if way else list
    return pa.table([pa.array(turn(word), pa.string()), pa.array(n, pa.int64()),
                     pa.array(turn(near), pa.string()), pa.array(near_n, pa.int64())], names=names)


def shared_prefix(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def within_one(prefix: str, word: str) -> bool:
    """Whether some continuation of ``prefix`` may be within one edit of ``word``."""
    rows = EditRows(np.array([[ord(c) for c in word]], np.uint32).reshape(1, -1), 0, len(prefix))
    rows.rows[0, 0] = (2, 0, 1)
    one = np.zeros(1, np.int64)
    return all(d > len(word) or rows.extend(one, one + d, np.array([ord(c)], np.uint32))[0] <= 1
               for d, c in enumerate(prefix))


def send_queries(listed: DataFrame, directory: list) -> DataFrame:
    """(target, way, m, key, n): each query once for every block that may hold near words of it."""
    lists: dict[tuple[int, int], list] = {}
    for r in sorted(directory, key=lambda r: (r["way"], r["m"], r["first"], r["last"])):
        lists.setdefault((r["way"], r["m"]), []).append(
            (r["first"], r["last"], r["block"], shared_prefix(r["first"], r["last"])))

    def run(batches):
        from bisect import bisect_left, bisect_right
        edges = {key: ([x[0] for x in v], [x[1] for x in v]) for key, v in lists.items()}
        for b in batches:
            rows, target = [], []
            for j, (way, m, key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("way", "m", "key")),
                                                  strict=True)):
                if len(key) != m:
                    continue
                blocks, (first, last) = lists[way, m], edges[way, m]
                head = key[:min(m // 2, DIRECTORY_CHARS)]
                # the directory's words may be cut short: compare with the same length
                low, high = bisect_left(last, head), bisect_right(first, head + "\U0010ffff")
                for f, _, block, prefix in blocks[low:high]:
                    if high - low == 1 or prefix == key[:len(prefix)] or within_one(prefix, key):
                        rows.append(j)
                        target.append(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(target, pa.int64()), *(c.take(pa.array(rows, pa.int64())) for c in
                                                 (b.column(x) for x in ("m", "key", "n")))],
                names=["block", "m", "key", "n"])

    return listed.select("way", "m", "key", "n").mapInArrow(run, "block long, m int, key string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words of one edit, in both directions."""
    spark = words.sparkSession
    tables = Tables(spark)
    entries = list_entries(words)
    block_words = max(BLOCK_WORDS, entries.count() // MOST_BLOCKS)
    order = ("way", "m", "key")
    ranged = entries.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    listed = tables.write(cut_blocks(ranged, block_words), "spelling-lists")
    directory = listed.groupBy("block").agg(
        F.first("way").alias("way"), F.first("m").alias("m"),
        F.min(F.substring("key", 1, DIRECTORY_CHARS)).alias("first"),
        F.max(F.substring("key", 1, DIRECTORY_CHARS)).alias("last")).collect()
    sent = tables.write(send_queries(listed, directory), "spelling-queries")
    # one row a block, like the directory
    most = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(block_words * WORD_CELLS / (F.max("m") + 1))))
    parts = F.broadcast(sent.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")))
    asked = sent.join(parts, "block").select(
        "block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "n")
    lists = listed.join(parts, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "way", "m", "key", "n")
    pairs = (lists.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
             .applyInArrow(near_pairs, "word string, n long, near string, near_n long"))
    out = materialise(pairs, "spelling-pairs")
    tables.drop()
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for all words with a form: the last of their forms."""
    spark = forms.sparkSession
    state = materialise(forms.select("word", F.col("form").alias("at")), "spelling-forms")
    done = None
    while True:
        ahead = state.select(F.col("word").alias("at"), F.col("at").alias("next"))
        if done is not None:
            ahead = ahead.unionByName(done.select(F.col("word").alias("at"), F.col("root").alias("next")))
        step = materialise(state.join(ahead, "at", "left"), "spelling-step")
        ended = step.filter("next IS NULL").select("word", F.col("at").alias("root"))
        done = ended if done is None else done.unionByName(ended)
        state = step.filter("next IS NOT NULL").select("word", F.col("next").alias("at"))
        if state.isEmpty():
            return done


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word."""
    words = materialise(vocabulary(docs, id_col, text_col), "spelling-words")
    best = (near_words(words).groupBy("word").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        .select("word", "n_near", F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.near")).alias("form"),
                F.when(-F.col("best.less") >= 2 * F.col("n"), -F.col("best.less")).alias("form_n")))
    best = materialise(best, "spelling-best")
    last = roots(best.filter("form IS NOT NULL"))
    return (words.join(best, "word", "left").join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(load(spark, sf_dir, "documents", "doc_id", "text"))


def oracle() -> str:
    """The same in DuckDB SQL: crc32 bit by bit, near words by common deletions."""
    step = "CASE WHEN (xor(c, e) & 1) = 1 THEN xor(xor(c, e) >> 1, 3988292384) ELSE xor(c, e) >> 1 END"
    return rf"""
WITH RECURSIVE runs AS (
  SELECT id, r, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
      unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]{{{SHORTEST},}}')) AS r
    FROM documents) GROUP BY id, r),
bytes AS (SELECT *, hex(encode(id || ':' || r)) AS x FROM runs),
bits AS (SELECT *, list_transform(range(0, len(x) * 4), lambda k: CASE WHEN k % 8 = 0
    THEN CAST('0x' || substr(x, CAST(k // 4 + 1 AS BIGINT), 2) AS BIGINT) ELSE CAST(0 AS BIGINT) END) AS b FROM bytes),
sums AS (SELECT r, n, xor(list_reduce(b, lambda c, e: {step}, CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bits),
cut AS (SELECT n, CASE WHEN h % {EVERY} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2)
    ELSE r END AS word FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= {SHORTEST}
  GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
dels AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM dels a JOIN dels b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM dels d JOIN words w ON d.rest = w.word
  UNION SELECT w.word, w.n, d.word, d.n FROM dels d JOIN words w ON d.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
forms AS (SELECT n.word, min(n.near) AS form, n.near_n AS form_n FROM near n JOIN best b
  ON n.word = b.word AND n.near_n = b.top WHERE n.near_n >= 2 * n.n GROUP BY n.word, n.near_n),
walk AS (
  SELECT word, form AS place FROM forms
  UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.place),
ends AS (SELECT word, place AS root FROM walk WHERE place NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(l.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN forms f ON f.word = w.word
LEFT JOIN ends l ON l.word = w.word
"""
