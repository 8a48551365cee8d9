"""Near-duplicate groups by n-gram Jaccard, with adaptive multi-match prefixes.

A document's set holds its distinct word n-grams as 64-bit hashes; documents of equal
sets form one node.  Two nodes whose Jaccard similarity reaches t share at least
ceil(t * size) n-grams, so in any common order of all n-grams the first
``size - ceil(t * size) + 1 + e`` of them (the prefix, lengthened by e) share at least
e + 1.  The order is that of the hashes.

Adaptive lengths: prefixes begin short.  An n-gram that more than ``frequent`` prefixes
hold is expensive, since its candidates grow with the square of its frequency, and gives
none.  A node remains cheap while it has fewer expensive n-grams than any partner must
share with it: then a cheap n-gram is among the shared ones and finds the pair.  Nodes
with more expensive ones take longer prefixes among themselves, asked to share
correspondingly more, and at last their whole sets.  Pairs that share as many as they
must are verified on whole sets: first each node's most promising pair, then those pairs
that the links found so far do not join.

Large groups of near copies: nodes that consist of expensive n-grams even as whole sets
are much alike.  They are grouped by shared prefix n-grams; a group's consensus is the
n-grams of more than half of its nodes, and a node is kept as its difference from the
consensus.  The node closest to the consensus is compared with all others.  Two sets
without a common difference are apart by both their differences, so if they are similar
both are similar to the closest node.  Other pairs have common differences, and the
farther the nodes are from the consensus the more of them; so prefixes of the
differences, rare ones first, find those pairs.  The lists of nodes per difference are
compared in blocks, and each block returns a spanning forest instead of its pairs.

Components of the links are found by label propagation with pointer jumping; each round
is written to the shared checkpoint folder.

Edge cases: a text of fewer words than n is one n-gram of all its words; a null or empty
text has the empty set, is linked with nothing and forms its own component; repeated
rows are equal sets; rows that share an id are one document; for a null id the component
is the smallest id reached, or null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveylens.llm.common import Tables, columns_of, fresh, load, materialise, text_slices

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX2
    return h ^ (h >> np.uint64(29))


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts (uint64), text after text, and each text's
    number of them.  Words are cut at ASCII white space after A-Z became a-z."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    ends -= ends[0]
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(real)))[ends]
    coded = words.filter(pa.array(real)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    own = pd.util.hash_array(np.asarray(distinct, object), categorize=False) if len(distinct) else \
        np.zeros(0, np.uint64)
    h = own[coded.indices.to_numpy(zero_copy_only=False)]
    count = np.diff(ends)
    # n-grams that begin at every word; those that run over a text's end are left out
    grams = np.zeros(len(h), np.uint64)
    for k in range(n):
        shifted = np.zeros(len(h), np.uint64)
        shifted[:max(0, len(h) - k)] = h[k:]
        grams = _scramble(grams * _MIX + shifted)
    doc = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(h)) + n <= ends[1:][doc]
    grams, doc = grams[inside], doc[inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence as one
        rest = []
        for s in short:
            g = np.array([count[s]], np.uint64) * _MIX2
            for w in h[ends[s]:ends[s + 1]]:
                g = _scramble(g * _MIX + w)
            rest.append(g)
        grams, doc = np.concatenate([grams, *rest]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.bincount(doc[new], minlength=len(count))


class Measure:
    """Jaccard threshold num / den, and prefix lengths."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def must_share(self, size):
        """ceil(t * size): n-grams that a set of this size shares with any similar one."""
        return -((-self.num * size) // self.den)

    def prefix(self, size):
        return size - self.must_share(size) + 1

    def longer(self, size, level: int):
        """How many n-grams a prefix is lengthened by."""
        p = self.prefix(size)
        return (p + 1) // 2 + 1 if level == 0 else 3 * p + 8 if level == 1 else size

    # the same as columns
    def share_col(self, size: Column) -> Column:
        return F.floor((size * self.num + (self.den - 1)) / self.den).cast("long")

    def longer_col(self, size: Column, level: int) -> Column:
        p = size - self.share_col(size) + 1
        if level == 0:
            return F.floor((p + 1) / 2).cast("long") + 1
        return 3 * p + 8 if level == 1 else size

    def window_col(self, size: Column, level: int) -> Column:
        return F.least(size, size - self.share_col(size) + 1 + self.longer_col(size, level))

    def overlap_col(self, a: Column, b: Column) -> Column:
        """Least intersection of two similar sets: ceil(t / (1 + t) * (|a| + |b|))."""
        return F.ceil((a + b) * self.num / F.lit(self.num + self.den)).cast("long")

    def expected_col(self, size: Column, level: int) -> Column:
        """What a prefix surely shares with any similar set's."""
        least = self.share_col(size)
        return F.least(self.longer_col(least, level) + 1, least)

    def linked(self, common, union):
        return self.den * common >= self.num * union


def signed_sets(docs: DataFrame, id_col: str, text_col: str, n: int, measure: Measure | None) -> DataFrame:
    """id, node (hash of the set; null if empty), size, grams: the level-0 prefix, or the whole
    set without a measure.  Hashes are 64-bit."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in text_slices(batches, text_col):
            grams, sizes = ngram_sets(b.column(text_col), n)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            mixed = np.concatenate((_scramble(grams * _MIX + np.uint64(1)), np.zeros(1, np.uint64)))
            full = sizes > 0
            node = np.zeros(len(sizes), np.uint64)
            node[full] = np.add.reduceat(mixed, ends[:-1][full]) if full.any() else 0
            if full.any():  # reduceat runs to the next begin; begins of full sets are contiguous
                node[full] = _scramble(node[full] + sizes[full].astype(np.uint64) * _MIX)
            held = sizes if measure is None else np.minimum(
                sizes, measure.prefix(sizes) + measure.longer(sizes, 0))
            at = np.repeat(ends[:-1] - np.concatenate(([0], np.cumsum(held)[:-1])), held) \
                + np.arange(held.sum())
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32()),
                pa.array(grams[at].view(np.int64) if len(at) else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(node.view(np.int64), pa.int64(), mask=~full),
                 pa.array(sizes, pa.int64()), lists], names=["id", "node", "size", "grams"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {id_type}, node long, size long, grams array<long>")


def prefix_pairs(nodes: DataFrame, measure: Measure, level: int, frequent: int,
                 tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) by prefixes of this level, and the nodes that are not cheap.
    ``nodes``: node, size, grams in ascending unsigned order, at least the prefix."""
    size = F.col("size")
    prefixes = nodes.select("node", "size", F.explode(F.slice(
        "grams", F.lit(1), measure.window_col(size, level).cast("int"))).alias("gram"))
    # at most frequent + 1 holders of each n-gram are kept, already before the shuffle
    few = prefixes.withColumn("k", F.row_number().over(
        Window.partitionBy("gram").orderBy("size", "node"))).filter(F.col("k") <= frequent + 1)
    lists = tables.write(few.groupBy("gram").agg(F.sort_array(F.collect_list(
        F.struct("size", "node"))).alias("held")).filter(F.size("held") > 1), "gram-lists")
    costly = lists.filter(F.size("held") > frequent).select("gram")
    side = F.broadcast(costly) if costly.count() <= 500_000 else costly
    burden = tables.write(prefixes.join(side, "gram").groupBy("node", "size").agg(
        F.count(F.lit(1)).alias("costly")), "gram-burden")
    dear = burden.filter(F.col("costly") >= measure.expected_col(size, level)).select("node")
    cheap = lists.filter(F.size("held") <= frequent)
    pairs = (cheap.select("held", F.posexplode("held").alias("i", "x"))
             .select("x", F.explode(F.slice(F.col("held"), F.col("i") + 2, F.lit(frequent))).alias("y"))
             .filter(F.col("x.size") * measure.den >= F.col("y.size") * measure.num)
             .groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
             .agg(F.count(F.lit(1)).alias("shared"), F.first("x.size").alias("m"), F.first("y.size").alias("n")))
    cost = burden.select("node", "costly")
    pairs = (pairs.join(cost.withColumnsRenamed({"node": "a", "costly": "ca"}), "a", "left")
             .join(cost.withColumnsRenamed({"node": "b", "costly": "cb"}), "b", "left"))
    m, n = F.col("m"), F.col("n")
    least = F.least(measure.longer_col(m, level) + 1, measure.longer_col(n, level) + 1,
                    measure.overlap_col(m, n))
    hidden = F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0)))
    return pairs.filter(F.col("shared") + hidden >= least).select("a", "b", "shared"), dear


def verified(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """The pairs whose whole sets are similar."""
    x = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    y = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - common
    return both.filter(common * measure.den >= union * measure.num).select("a", "b")


def joining_links(pairs: DataFrame, sets: DataFrame, measure: Measure, tables: Tables) -> DataFrame:
    """Links that join all similar pairs: each node's pair with the most shared n-grams is
    verified first; of the others those that are not joined yet."""
    best = [pairs.groupBy(x).agg(F.max_by(y, F.struct("shared", y)).alias(y)).select("a", "b")
            for x, y in (("a", "b"), ("b", "a"))]
    first = tables.write(verified(best[0].unionByName(best[1]).distinct(), sets, measure), "first-links")
    labels = components(first, tables)
    rest = (pairs.join(labels.withColumnsRenamed({"node": "a", "label": "la"}), "a", "left")
            .join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b", "left")
            .filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))
    return first.unionByName(verified(rest, sets, measure))


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node, label: the smallest node of its component, for every node of a link."""
    links = tables.write(links.select("a", "b"), "links")
    both = tables.write(links.unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links-both-ways")
    labels = tables.write(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnsRenamed({"node": "b", "label": "l"}), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l")))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                F.least("label", "l").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = tables.write(step.join(jump, "label").select(
            "node", F.least("label", "far").alias("label"), "old"), "labels")
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels


def _forest(size, diffs, ids, is_new, measure) -> list[tuple[int, int]]:
    """Spanning links of the similar pairs among nodes given by their differences."""
    _, inverse, counts = np.unique(np.concatenate(diffs), return_inverse=True, return_counts=True)
    d = np.array([len(x) for x in diffs])
    owner = np.repeat(np.arange(len(diffs)), d)
    number = np.cumsum(counts > 1) - 1  # only differences of several nodes count
    several = counts[inverse] > 1
    owner, column = owner[several], number[inverse[several]]
    shared = np.zeros((len(diffs), len(diffs)), np.float32)
    for low in range(0, int((counts > 1).sum()), 4096):
        at = (column >= low) & (column < low + 4096)
        part = np.zeros((len(diffs), 4096), np.float32)
        part[owner[at], column[at] - low] = 1
        shared += part @ part.T
    apart = d[:, None] + d[None] - 2 * shared
    total = size[:, None] + size[None]
    common = (total - apart) / 2
    link = measure.linked(common, total - common) & (is_new[:, None] | is_new[None])
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label, np.where(link, label[None], len(ids)).min(1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(ids[i]), int(ids[label[i]])) for i in np.flatnonzero(label != np.arange(len(ids)))]


def alike_links(sets: DataFrame, measure: Measure, tables: Tables, block: int = 512) -> DataFrame:
    """Links (a, b) that join all similar pairs of ``sets`` (node, size, grams), for large
    groups of sets that are much alike."""
    size = F.col("size")
    p = (size - measure.share_col(size) + 1).cast("int")
    held = sets.select("node", F.explode(F.slice("grams", F.lit(1), p)).alias("gram"))
    # groups: nodes that share prefix n-grams, directly or through others
    held = tables.write(held, "alike-prefixes")
    labels = tables.write(sets.select("node", F.col("node").alias("label")), "alike-labels")
    while True:
        by_gram = held.join(labels, "node").groupBy("gram").agg(F.min("label").alias("l"))
        low = held.join(by_gram, "gram").groupBy("node").agg(F.min("l").alias("l"))
        step = labels.join(low, "node").select("node", F.col("label").alias("old"),
                                               F.least("label", "l").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = tables.write(step.join(jump, "label").select(
            "node", F.least("label", "far").alias("label"), "old"), "alike-labels")
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            break
    grouped = tables.write(sets.join(labels, "node").withColumnRenamed("label", "group"), "alike-sets")
    members = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    usual = (grouped.select("group", F.explode("grams").alias("gram")).groupBy("group", "gram")
             .agg(F.count(F.lit(1)).alias("n")).join(members, "group").filter(2 * F.col("n") > F.col("members"))
             .groupBy("group").agg(F.collect_list("gram").alias("usual")))
    centre = tables.write(members.join(usual, "group", "left").select(
        "group", F.coalesce("usual", F.array().cast("array<long>")).alias("usual")), "alike-centres")
    small = lambda df: F.broadcast(df) if df.count() <= 2_000 else df
    away = tables.write(
        grouped.join(small(centre), "group")
        .select("group", "node", "size", F.concat(F.array_except("grams", "usual"),
                                                  F.array_except("usual", "grams")).alias("diff"))
        .withColumn("d", F.size("diff")), "alike-differences")
    # two sets without a common difference are similar if and only if their closeness adds up to
    # 0 or more; so what is similar to any set in that way is similar to the closest one
    closeness = (measure.den - measure.num) * F.col("size") - (measure.den + measure.num) * F.col("d")
    best = away.groupBy("group").agg(F.max(F.struct(closeness.alias("f"), "node", "size", "diff")).alias("best"))
    best = tables.write(best.select("group", F.col("best.node").alias("hub"), F.col("best.size").alias("m"),
                                   F.col("best.f").alias("hub_f"), F.col("best.diff").alias("hub_diff")),
                       "alike-hubs")
    apart = F.col("d") + F.size("hub_diff") - 2 * F.size(F.array_intersect("diff", "hub_diff"))
    total = F.col("size") + F.col("m")
    common = (total - apart) / 2
    tested = tables.write(away.join(small(best), "group").select(
        "group", "node", "size", "diff", "d", "hub", "hub_f", closeness.alias("f"),
        (common * measure.den >= (total - common) * measure.num).alias("linked")), "alike-tested")
    star = tested.filter("linked and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # A node that is not linked to the hub is new.  It shares more differences with a similar node
    # z than half of what the hub is closer than z by, and no fewer than both lack to 0.  So, with
    # rare differences first, a new node is found by its leading ones among z's leading ones.
    unit = 2 * (measure.den + measure.num)
    listed = tested.select("group", "node", "d", "f", "hub_f", "linked", F.explode("diff").alias("by"))
    several = listed.groupBy("group", "by").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") > 1)
    ranked = listed.join(several, ["group", "by"])
    same = Window.partitionBy("group", "node")
    ranked = ranked.withColumn("place", F.col("d") - F.count(F.lit(1)).over(same)  # single ones lead
                               + F.row_number().over(same.orderBy("all", "by")))
    shares = F.floor((F.col("hub_f") - F.col("f")) / unit) + 1
    probes = F.greatest(F.lit(1), F.ceil((-F.col("f") - F.col("hub_f")) / unit))
    ranked = (ranked.withColumn("probe", ~F.col("linked") & (F.col("place") <= F.col("d") - probes + 1))
              .filter(F.col("probe") | (F.col("place") <= F.col("d") - shares + 1))
              .select("group", "by", "node", "probe"))
    lists = (ranked.groupBy("group", "by").agg(F.count(F.lit(1)).alias("all"),
                                               F.count_if("probe").alias("probes"))
             .filter((F.col("all") > 1) & (F.col("probes") > 0))
             .select("group", "by", F.ceil(F.col("all") / block).alias("blocks")))
    spread = (ranked.join(lists, ["group", "by"])
              .join(tested.select("node", "size", "diff", "linked"), "node")
              .withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    pairs = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .select("group", "by", "node", "size", "diff", "linked",
                F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        found = []
        if len(rows) > 1 and not rows["linked"].all():
            found = _forest(rows["size"].to_numpy(), list(rows["diff"]), rows["node"].to_numpy(),
                            ~rows["linked"].to_numpy(bool), measure)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    more = pairs.groupBy("group", "by", "i", "j").applyInPandas(compare, "a long, b long")
    return star.unionByName(more)


def similar_links(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, n: int,
                  measure: Measure, frequent: int, tables: Tables) -> DataFrame:
    """Links (a, b) between nodes that join all similar nodes."""
    nodes = tables.write(signed.filter("node is not null").groupBy("node").agg(
        F.first("size").alias("size"), F.first("grams").alias("grams"), F.min("id").alias("id")), "gram-nodes")
    pairs, dear = prefix_pairs(nodes, measure, 0, frequent, tables)
    pairs = tables.write(pairs, "gram-pairs")
    dear = tables.write(dear, "gram-dear")
    # whole sets of the nodes that take part, from one of their texts
    wanted = dear.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(
        pairs.select(F.col("b").alias("node"))).distinct()
    wanted = tables.write(nodes.select("node", "id").join(wanted, "node").select("node", "id"), "gram-wanted")
    ids = wanted.select(F.col("id").alias("_wanted")).distinct()
    side = F.broadcast(ids) if wanted.count() <= 1_000_000 else ids
    texts = docs.select(id_col, text_col).join(side, F.col(id_col).eqNullSafe(F.col("_wanted")), "left_semi")
    sets = tables.write(signed_sets(texts, id_col, text_col, n, None).join(wanted.select("node"), "node",
                                                                         "left_semi")
                       .groupBy("node").agg(F.first("size").alias("size"), F.first("grams").alias("grams")),
                       "gram-sets")
    for level in (1, 2):
        if dear.isEmpty():
            break
        more, rest = prefix_pairs(sets.join(dear, "node", "left_semi"), measure, level, frequent, tables)
        pairs = pairs.unionByName(tables.write(more, "gram-pairs"))
        dear = tables.write(rest, "gram-dear")
    links = joining_links(pairs, sets, measure, tables)
    if dear.isEmpty():
        return links
    return links.unionByName(alike_links(sets.join(dear, "node", "left_semi"), measure, tables))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                          num: int = 80, den: int = 100, frequent: int = 50) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links) per row.  Sets of word
    ``n``-grams are linked when den * |intersection| >= num * |union|."""
    measure, tables = Measure(num, den), Tables(docs.sparkSession)
    signed = materialise(signed_sets(docs, id_col, text_col, n, measure), "gram-signed")
    labels = components(similar_links(docs, signed, id_col, text_col, n, measure, frequent, tables), tables)
    named = signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("id")) \
        .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    found = materialise(named.join(least, "label").select("node", "component_id"), "gram-components")
    tables.drop()
    return signed.select("id", "node", "size").join(found, "node", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                      num: int = 80, den: int = 100, frequent: int = 50) -> DataFrame:
    """One row of each group: that of its smallest id.  Rows of a null id stay."""
    groups = near_duplicate_groups(docs, id_col, text_col, n, num, den, frequent)
    key, least, many = (fresh(docs, c) for c in ("group_id", "group_least", "group_rows"))
    rows = groups.groupBy(F.col(id_col).alias(key)).agg(
        F.min("component_id").alias(least), F.count(F.lit(1)).alias(many)).filter(F.col(key).isNotNull())
    odd = materialise(rows.filter((F.col(key) != F.col(least)) | (F.col(many) > 1)), "gram-odd")
    side = F.broadcast(odd) if odd.count() <= 1_000_000 else odd
    known = docs.join(side, F.col(id_col) == F.col(key), "left")
    columns = columns_of(docs)
    alone = known.filter(F.col(key).isNull()).select(*columns)
    repeated = known.filter((F.col(key) == F.col(least)) & (F.col(many) > 1)).select(*columns)
    return alone.unionByName(repeated.dropDuplicates([id_col]))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(load(spark, sf_dir, "documents", "doc_id", "text"), n=3, num=90)
