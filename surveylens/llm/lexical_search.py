"""Ranked lexical search by presence masks.

A block of items is searched at a time.  One scan of the texts writes a narrow index: each
document's number of terms and its counts of the block's terms.  From it come the corpus
statistics.  The search then works on pieces of the index.  Bitmaps of the documents that
hold each term are turned into one mask of matched terms per (item, document), and the
documents are grouped by mask.  A mask's score is at most the sum of its terms' largest
gains in the piece; masks are evaluated in descending order of that bound, all documents of
a mask at once, until the next bound is below the item's last place so far.  Masks below
hold no document that could enter (one with an equal bound is evaluated, as an equal score
with a smaller id is better), so the result is exact.

Work: one scan of texts a block, then only the index; a task returns ``k`` rows an item, and
these are ranked in two levels so that no group holds those of all tasks.  A block has at
most ``most_terms`` distinct terms (one item may have more and is then alone) and 512 items;
pieces shrink as the terms grow, so that a table of documents x terms has 4 million cells.

Edge cases: a null or empty text, or one without terms, is no document of the statistics and
is never found; an item without terms, or of terms that no document has, gives no rows;
repeated rows are documents (or items) of their own; among equal scores the smaller id comes
first, a null id last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveylens.llm.common import LOWER, UPPER, Tables, load, text_bytes, text_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the contract's terms
CELLS = 1 << 22        # documents x terms of one piece
MOST_ITEMS = 512       # of one block
MERGE_PARTS = 32       # groups of the first ranking level

# a byte of a term in lower case, a blank for every other
TERM_BYTES = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    TERM_BYTES[_low:_high + 1] = np.arange(_low, _high + 1)
TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def item_terms(text: str | None) -> list[str]:
    lowered = (text or "").translate(str.maketrans(UPPER, LOWER))
    return list(dict.fromkeys(re.findall(TERM, lowered)))


def item_blocks(items: DataFrame, id_col: str, text_col: str,
                most_terms: int) -> Iterator[tuple[list, list[list[str]]]]:
    """(ids, terms) of the items in blocks; the driver holds one block at a time."""
    ids, terms, seen = [], [], set()
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        own = item_terms(r["t"])
        if not own:
            continue
        if ids and (len(ids) >= MOST_ITEMS or len(seen | set(own)) > most_terms):
            yield ids, terms
            ids, terms, seen = [], [], set()
        ids.append(r["i"])
        terms.append(own)
        seen.update(own)
    if ids:
        yield ids, terms


def index_documents(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts): all terms of each document, and the numbers and counts of
    those in ``vocabulary``."""
    id_type, size = docs.schema[id_col].dataType.simpleString(), len(vocabulary)

    def run(batches):
        known = pa.array(vocabulary, pa.large_string())
        for b in text_slices(batches, text_col):
            raw, offsets = text_bytes(b.column(text_col))
            clean = pa.LargeStringArray.from_buffers(
                b.num_rows, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(TERM_BYTES[raw]))
            lists = pc.ascii_split_whitespace(clean)
            words = lists.flatten().dictionary_encode()
            doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            at = words.indices.to_numpy(zero_copy_only=False)
            full = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)
            number = pc.fill_null(pc.index_in(words.dictionary, value_set=known), -1).to_numpy()
            n = np.bincount(doc[full[at]], minlength=b.num_rows)
            term = number[at].astype(np.int64)
            hit = term >= 0
            cell, count = np.unique(doc[hit] * size + term[hit], return_counts=True)
            cuts = np.searchsorted(cell, np.arange(b.num_rows + 1) * size)
            cuts = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(cuts, pa.array(cell % size, pa.int32())),
                 pa.ListArray.from_arrays(cuts, pa.array(count, pa.int32()))],
                names=["id", "n", "terms", "counts"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {id_type}, n long, terms array<int>, counts array<int>")


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)


def mask_groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each distinct mask, and the mask number of every row."""
    packed = np.packbits(present, axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    words = np.ascontiguousarray(packed).view(np.uint64)
    group = np.zeros(len(present), np.int64)
    for k in range(words.shape[1]):
        _, own = np.unique(words[:, k], return_inverse=True)
        _, first, group = np.unique(group * len(present) + own, return_index=True, return_inverse=True)
    return first, group


class Ranking:
    """The best ``k`` documents of every item that a task has seen."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.best = k, [[] for _ in range(items)]

    def least(self, item: int) -> int:
        """A score below this cannot enter."""
        held = self.best[item]
        return -held[-1][0] if len(held) == self.k else 1

    def add(self, item: int, score: np.ndarray, docs: np.ndarray, place: np.ndarray, ids: pa.Array) -> None:
        keep = score >= self.least(item)
        score, docs = score[keep], docs[keep]
        for j in np.lexsort((place[docs], -score))[:self.k]:
            i = ids[int(docs[j])].as_py()
            self.best[item].append((-int(score[j]), i is None, i))
        self.best[item].sort(key=lambda x: x[:2] if x[1] else x)
        del self.best[item][self.k:]


def search_piece(part: pa.RecordBatch, items: list[np.ndarray], weight: np.ndarray, documents: int,
                 all_terms: int, ranking: Ranking) -> None:
    ids = part.column("id")
    place = np.empty(part.num_rows, np.int64)  # order of the ids, a null last
    place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(part.num_rows)
    lists, counts = part.column("terms"), part.column("counts")
    doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    term = lists.flatten().to_numpy()
    tf = counts.flatten().to_numpy().astype(np.int64)
    m = 10 + 90 * part.column("n").to_numpy() * documents // all_terms
    gain = np.zeros((part.num_rows, len(weight)), np.int64)
    gain[doc, term] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    present = np.zeros(gain.shape, bool)
    present[doc, term] = True
    largest = gain.max(0)
    for item, terms in enumerate(items):
        bits = present[:, terms]
        first, group = mask_groups(bits)
        bound = bits[first] @ largest[terms]
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        docs = np.argsort(rank[group], kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(rank[group], minlength=len(order)))))
        at, step = 0, 16
        while at < len(order) and bound[at] >= ranking.least(item):
            upto = min(at + step, len(order))
            own = docs[start[at]:start[upto]]
            ranking.add(item, gain[own[:, None], terms].sum(1), own, place, ids)
            at, step = upto, 2 * step


def _search_block(docs: DataFrame, ids: list, item_schema, terms: list[list[str]], k: int, id_col: str,
                  text_col: str, out_item: str) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({t for own in terms for t in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    items = [np.array([number[t] for t in own]) for own in terms]
    tables = Tables(spark)
    index = tables.write(index_documents(docs, vocabulary, id_col, text_col), "lexical-index")
    total = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    documents, all_terms = total["documents"], total["terms"]
    if not documents:
        tables.drop()
        return None
    df = np.zeros(len(vocabulary))
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = term_weights(df, documents)
    rows = max(1, CELLS // len(vocabulary))
    id_type = docs.schema[id_col].dataType

    def run(batches):
        ranking = Ranking(len(items), k)
        kind = None
        for b in batches:
            kind = b.column("id").type
            for at in range(0, b.num_rows, rows):
                search_piece(b.slice(at, rows), items, weight, documents, all_terms, ranking)
        if kind is not None:
            found = [(i, x[2], -x[0]) for i, best in enumerate(ranking.best) for x in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], kind),
                 pa.array([f[2] for f in found], pa.int64())], names=["item", "id", "score"])

    found = index.mapInArrow(run, f"item int, id {id_type.simpleString()}, score long") \
        .withColumn("part", F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS)))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))) \
        .filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))) \
        .filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(zip(range(len(ids)), ids, strict=True)), item_schema)
    named = found.join(F.broadcast(names), "item").select(
        F.col("item_name").alias(out_item), "rank", F.col("id").alias(id_col), "score")
    result = Tables(spark).write(named, "lexical-found")
    tables.drop()
    return result


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   most_terms: int = 4096) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of every item."""
    item_type = items.schema[item_col].dataType.simpleString()
    out = None
    for ids, terms in item_blocks(items, item_col, item_text_col, most_terms):
        part = _search_block(docs, ids, f"item int, item_name {item_type}", terms, k, id_col, text_col, item_col)
        if part is None:  # no document has a term
            break
        out = part if out is None else out.unionByName(part)
    if out is None:
        id_type = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"`{item_col}` {item_type}, rank int, `{id_col}` {id_type}, score long")
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(load(spark, sf_dir, "documents", "doc_id", "text"),
                          load(spark, sf_dir, "benchmark", "item_id", "text"))


def oracle() -> str:
    """The same ranking in DuckDB SQL."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, {words} AS words FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(len(words)) AS BIGINT) AS terms
  FROM docs WHERE len(words) > 0),
items AS (SELECT iid, item_id, unnest(words) AS term
  FROM (SELECT row_number() OVER () AS iid, item_id, list_distinct({words}) AS words FROM benchmark)),
counts AS (SELECT uid, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT uid, unnest(words) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY uid, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total),
scores AS (SELECT iid, item_id, uid, doc_id, CAST(sum(w * ((1000000000 * tf) //
    (1000 * tf + 8 * (10 + (90 * len(words) * documents) // terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN docs USING (uid), total
  GROUP BY iid, item_id, uid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
