"""Mixing sources to target weights.

Words are packed into blocks of fixed length along each source's stream of documents.
A source's target fixes its number of slots.  All output shards but the last hold
``shard_blocks`` slots.  How many of them are each source's is drawn: multinomial counts,
given the sources' totals.  A binary tree over the shards splits the counts of all
sources together (a multivariate hypergeometric draw seeded with (seed, node)), so that any
node's counts and first slot numbers follow from its parent's and no running sum over
shards is needed.  Slot j of a
source is block perm(j) of its stream, ``perm`` being a pseudorandom permutation of the
block numbers (a Feistel network) that differs per source and epoch; joining slots and
documents' block pieces by (source, block) gives the output shards (``mixed_shards``), and
from the same rows what the mix takes of every document and its texts in every shard.

Totals are exact: a source's slots add up to its rounded target, its last slot being
taken in part.  No block is taken twice before all were taken once.

Scale: the stream offsets come from two-level prefix sums (hash buckets of about
``bucket_rows`` rows per source, then rows inside a bucket); the tree's nodes are
split over tasks after its upper levels, and a task yields one shard's counts at a time; joins are on (source, block), which
spreads a hot source over all tasks.  Nothing but one row per source is narrow.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source
of its own, ordered last; repeated rows are rows of their own; if all sizes are 0 all
targets are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylens.llm.common import columns_of, fresh, load, materialise, shuffle_partitions, text_slices

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_no, source_size, target: ``share`` of all sizes by weight (in the order
    of the sources' code points, null last, repeating), at most ``most`` times a source's
    size; the excess goes to the others by weight.

    In the order of cap / weight a source is capped as long as its cap is below its part of
    what the earlier ones left, so two running sums settle all targets at once.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           (F.col("source_no") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "source_no")
    everything = Window.partitionBy()
    per = (per.withColumn("caps_before", F.sum("cap").over(order) - F.col("cap"))
           .withColumn("w_from", F.sum("w").over(everything) - F.sum("w").over(order) + F.col("w"))
           .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
           .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("w_from"))
           .withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
           .withColumn("free_level", F.max(F.when(~F.col("capped"), F.struct(
               -F.col("caps_before"), F.col("level")))).over(everything)["level"]))
    return per.select("source", "source_no", "source_size", "n",
                      F.when(F.col("capped"), F.col("cap"))
                      .otherwise(F.col("free_level") * F.col("w")).alias("target"))


def permute(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Element-wise pseudorandom permutation of [0, n): a four-round Feistel network on the
    next power of four, walked along its cycle until the value is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = j.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ (f & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _mix64(*parts: int) -> int:
    x = 0
    for p in parts:
        x = ((x ^ (p & (2**64 - 1))) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)
        x ^= x >> 31
    return x


def drawn(rng: np.random.Generator, counts: np.ndarray, places: int) -> np.ndarray:
    """How many of each source's ``counts`` slots are among the first ``places`` of all of them in
    random order (a multivariate hypergeometric draw)."""
    total = int(counts.sum())
    if total < 10**9:  # the generator's own bound
        return rng.multivariate_hypergeometric(counts, places, method="marginals")
    out = np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):  # source after source; large ones by the normal law
        rest = total - c
        if total < 10**9:
            out[i] = rng.hypergeometric(c, rest, places) if c and places else 0
        else:
            share = places / total
            sd = (c * share * (1 - share) * (rest / max(1, total - 1))) ** 0.5
            out[i] = min(max(round(rng.normal(c * share, sd)), places - rest, 0), c, places)
        total, places = rest, places - int(out[i])
    return out


def descend(seed: int, shard_blocks: int, node: int, low: int, high: int, sources: np.ndarray,
            first: np.ndarray, counts: np.ndarray, until: int):
    """Splits the slots (``counts`` a source, from number ``first``) over the shards [low, high) down
    to groups of at most ``until`` shards; yields (node, low, high, sources, first, counts)."""
    if not len(counts):
        return
    if high - low <= until:
        yield node, low, high, sources, first, counts
        return
    mid = (low + high) // 2
    left = drawn(np.random.default_rng(_mix64(seed, node)), counts, (mid - low) * shard_blocks)
    for lo, hi, child, begin, own in ((low, mid, 2 * node, first, left),
                                      (mid, high, 2 * node + 1, first + left, counts - left)):
        some = own > 0
        yield from descend(seed, shard_blocks, child, lo, hi, sources[some], begin[some], own[some], until)


def draw_slots(sources: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """One row per slot: source_no, shard, slot, epoch, block, words (taken of the block)."""
    size, want = F.col("source_size"), F.round("target").cast("long")
    plan = (sources.filter("source_size > 0 and round(target) > 0")
            .withColumn("full", F.floor(size / block_words))
            .withColumn("blocks", F.ceil(size / block_words))
            .withColumn("epochs", F.floor(want / size)).withColumn("rest", want % size)
            .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block_words))
            .select(*[F.col(c).cast("long") for c in
                      ("source_no", "source_size", "full", "blocks", "epochs", "rest", "slots")]))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    group = max(1, -(-shards // 16_384))  # shards of a group that one row stands for
    tasks = min(-(-shards // group), shuffle_partitions(sources.sparkSession))
    tree_schema = "node long, low long, high long, sources array<long>, first array<long>, counts array<long>"

    def upper(batches):
        for b in batches:
            for r in b.column("all").to_pylist():
                own = np.array([(x["source_no"], x["slots"]) for x in r], np.int64).reshape(-1, 2)
                for *at, no, first, counts in descend(seed, shard_blocks, 1, 0, shards, own[:, 0],
                                                      np.zeros(len(own), np.int64), own[:, 1], group):
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([v], pa.int64()) for v in at),
                         *(pa.array([v], pa.list_(pa.int64())) for v in (no, first, counts))],
                        names=["node", "low", "high", "sources", "first", "counts"])

    def lower(batches):
        for b in batches:
            for r in b.to_pylist():
                arrays = (np.array(r[c], np.int64) for c in ("sources", "first", "counts"))
                for _, shard, _, no, first, counts in descend(seed, shard_blocks, r["node"], r["low"], r["high"],
                                                              *arrays, 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, pa.int64()) for v in (no, np.full(len(no), shard), first, counts)],
                        names=["source_no", "shard", "first", "count"])

    def choose(batches):
        for b in batches:
            no, epoch, place, full = (b.column(c).to_numpy() for c in ("source_no", "epoch", "place", "full"))
            pairs, which = np.unique(np.stack([no, epoch], 1), axis=0, return_inverse=True)
            keys = np.array([_mix64(seed, *pair) for pair in pairs.tolist()], np.uint64)[which.reshape(-1)]
            block, inner = place.copy(), place < full  # the short last block stays in its place
            if inner.any():
                block[inner] = permute(place[inner], full[inner], keys[inner])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("source_no", "shard", "slot", "epoch")), pa.array(block, pa.int64()),
                 b.column("words")], names=["source_no", "shard", "slot", "epoch", "block", "words"])

    # one row a source, together in the top node as in the targets' window
    top = plan.agg(F.sort_array(F.collect_list(F.struct("source_no", "slots"))).alias("all"))
    counts = (top.mapInArrow(upper, tree_schema).repartition(tasks, "node")  # given in number: few bytes, many slots
              .mapInArrow(lower, "source_no long, shard long, first long, count long"))
    whole = F.when(F.col("place") < F.col("full"), F.lit(block_words)).otherwise(
        F.col("source_size") - F.col("full") * block_words)
    slots = (counts.join(source_side(plan), "source_no")
             .withColumn("slot", F.explode(F.expr("sequence(first, first + count - 1)")))
             .withColumn("epoch", F.expr("slot div blocks")).withColumn("place", F.expr("slot % blocks"))
             # the epoch that stops after ``rest`` words takes its last block in part
             .withColumn("words", F.when(F.col("epoch") == F.col("epochs"), F.least(
                 whole, F.col("rest") - F.col("place") * block_words)).otherwise(whole).cast("long")))
    # (joins with the slots are hinted: the planner takes their size for that of the sources)
    return slots.select("source_no", "shard", "slot", "epoch", "place", "full", "words").mapInArrow(
        choose, "source_no long, shard long, slot long, epoch long, block long, words long")


def block_pieces(rows: DataFrame, sources: DataFrame, block_words: int, bucket_rows: int = 4_000) -> DataFrame:
    """One row per document and block of its source's stream (documents in an order that
    depends on ids and sizes alone, so reruns agree whatever the partitioning): uid, id, source_no, block, low and
    high (words of the block that are the document's), at (document word at ``low``)."""
    n = sources.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-n // bucket_rows))
    rows = (rows.filter("size > 0").join(source_side(sources.select("source", "source_no")),
                                         F.col("s").eqNullSafe(F.col("source")))
            .select("uid", "id", "source_no", "size",
                    F.pmod(F.xxhash64("id", "size"), F.lit(buckets)).alias("bucket")))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("held"))
    before = sums.withColumn("begin", F.sum("held").over(
        Window.partitionBy("source_no").orderBy("bucket")) - F.col("held")).drop("held")
    run = Window.partitionBy("source_no", "bucket").orderBy("id", "size", "uid")
    placed = (rows.withColumn("upto", F.sum("size").over(run)).join(before, ["source_no", "bucket"])
              .select("uid", "id", "source_no", "size", (F.col("begin") + F.col("upto") - F.col("size")).alias("a"),
                      (F.col("begin") + F.col("upto")).alias("z")))
    cut = placed.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("a") / block_words), F.floor((F.col("z") - 1) / block_words))))
    base = F.col("block") * block_words
    low = F.greatest(F.col("a") - base, F.lit(0))
    return cut.select("uid", "id", "source_no", "block", low.alias("low"),
                      F.least(F.col("z") - base, F.lit(block_words)).alias("high"),
                      (base + low - F.col("a")).alias("at"))


def source_side(sources: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Broadcast while there are at most ``most_rows`` sources (they are counted); beyond
    that a shuffled join, whose hot keys adaptive execution splits."""
    return F.broadcast(sources) if sources.count() <= most_rows else sources


def sized(docs: DataFrame, source_col: str, text_col: str, size: str = "size", source: str = "s") -> DataFrame:
    return docs.select("*", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias(size),
                       F.col(source_col).alias(source))


def shard_pieces(rows: DataFrame, sources: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """One row per slot and document that it takes words of: shard, slot, epoch, source_no, block,
    uid, id, at, low (the block's word that is the document's word ``at``) and n (words)."""
    slots = draw_slots(sources, block_words, shard_blocks, seed)
    return (block_pieces(rows, sources, block_words).join(slots.hint("shuffle_merge"), ["source_no", "block"])
            .filter("words > low").select("shard", "slot", "epoch", "source_no", "block", "uid", "id", "at",
                                          "low", (F.least("high", "words") - F.col("low")).alias("n")))


def prepared(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights, share: float,
             most: float) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, id, s, size) and sources with their targets, both written."""
    rows = materialise(sized(docs.select(id_col, source_col, text_col), source_col, text_col).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), "s", "size"), "mix-rows")
    return rows, materialise(source_targets(rows.withColumnRenamed("s", "source"), weights, share, most),
                             "mix-sources")


def mixed_shards(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                 text_col: str = "text", weights=(3, 1, 2), share: float = 1.5, most: float = 2.0,
                 block_words: int = 256, shard_blocks: int = 1024, seed: int = 20) -> DataFrame:
    """The output shards, one row per slot: shard, slot (the source's), source, block, pieces
    (array of <id>, at, n in the block's order).  A shard's slots of a source follow each other."""
    rows, sources = prepared(docs, id_col, source_col, text_col, weights, share, most)
    cut = shard_pieces(rows, sources, block_words, shard_blocks, seed)
    per = cut.groupBy("shard", "slot", "source_no", "block").agg(
        F.sort_array(F.collect_list(F.struct("low", "uid", "id", "at", "n"))).alias("p"))
    return (per.join(source_side(sources.select("source_no", "source")), "source_no")
            .select("shard", "slot", "source", "block", F.transform("p", lambda x: F.struct(
                x["id"].alias(id_col), x["at"].alias("at"), x["n"].alias("n"))).alias("pieces")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", weights=(3, 1, 2), share: float = 1.5, most: float = 2.0,
                block_words: int = 256, shard_blocks: int = 1024, seed: int = 20) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (over all shards), first_shard
    and n_shards (the first shard with words of it, null without any, and their number)."""
    rows, sources = prepared(docs, id_col, source_col, text_col, weights, share, most)
    per = shard_pieces(rows, sources, block_words, shard_blocks, seed).groupBy("uid").agg(
        F.sum("n").alias("taken"), F.min("shard").alias("first_shard"),
        F.size(F.collect_set("shard")).cast("long").alias("n_shards"))
    return (rows.join(per, "uid", "left")
            .join(source_side(sources), F.col("s").eqNullSafe(F.col("source")))
            .select(F.col("id").alias(id_col), "size", F.col("source_size").cast("long"), "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard",
                    F.coalesce("n_shards", F.lit(0).cast("long")).alias("n_shards")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                    text_col: str = "text", weights=(3, 1, 2), share: float = 1.5, most: float = 2.0,
                    block_words: int = 256, shard_blocks: int = 1024, seed: int = 20) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per shard, document and epoch that
    takes words of it.  Where a shard takes a document whole, the text stays; of one taken in part
    the rows of words that the shard takes follow each other, joined by a line break.  Documents
    without words are not taken."""
    columns = docs.columns
    uid, size, source, cuts = (fresh(docs, c) for c in ("uid", "size", "s", "spans"))
    kept = materialise(sized(docs, source_col, text_col, size, source)
                       .withColumn(uid, F.monotonically_increasing_id()), "mix-texts")
    rows = kept.select(F.col(uid).alias("uid"), F.col(id_col).alias("id"), F.col(source).alias("s"),
                       F.col(size).alias("size"))
    sources = materialise(source_targets(rows.withColumnRenamed("s", "source"), weights, share, most),
                          "mix-sources")
    spans = (shard_pieces(rows, sources, block_words, shard_blocks, seed)
             .groupBy(F.col("uid").alias(uid)).agg(
                 F.sort_array(F.collect_list(F.struct("epoch", "shard", "at", "n"))).alias(cuts)))
    # one row a document, whose words are found once for all shards
    found = kept.join(spans, uid).select(*columns_of(docs), size, cuts)
    schema = T.StructType([docs.schema[c] for c in columns])
    word = re.compile(WORD)

    def rows_of(b, of, texts):
        of = pa.array(of, pa.int64())
        out = {c: pa.array(texts, pa.string()) if c == text_col else b.column(c).take(of) for c in columns}
        if "n_chars" in out:
            out["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(out["n_chars"].type)
        return pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    def cut(batches, most: int = 4 << 20):
        for b in text_slices(batches, text_col):
            of, texts, held = [], [], 0
            for i in range(b.num_rows):
                text, whole, pieces = (b.column(c)[i].as_py() for c in (text_col, size, cuts))
                ends = None
                for _, own in groupby(pieces, key=lambda x: (x["epoch"], x["shard"])):
                    runs: list[list[int]] = []
                    for x in own:
                        if runs and runs[-1][1] == x["at"]:
                            runs[-1][1] += x["n"]
                        else:
                            runs.append([x["at"], x["at"] + x["n"]])
                    part = text
                    if runs != [[0, whole]]:
                        if ends is None:
                            ends = np.fromiter((e for m in word.finditer(text) for e in m.span()), np.int64)
                        part = "\n".join(text[ends[2 * a]:ends[2 * z - 1]] for a, z in runs)
                    of.append(i)
                    texts.append(part)
                    held += len(part)
                    if held > most:
                        yield rows_of(b, of, texts)
                        of, texts, held = [], [], 0
            if of:
                yield rows_of(b, of, texts)

    return found.mapInArrow(cut, schema)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents", "doc_id", "source", "text"))
