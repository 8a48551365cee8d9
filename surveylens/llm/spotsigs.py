"""Document fingerprints by spot signatures (DataFrame operations only).

Common words (articles and auxiliaries of four languages) are anchors; the content words
that follow an anchor form a chain, and anchor + chain is a signature.  A document's
fingerprint is the set of its signatures (64-bit hashes, sorted, in hexadecimal), led by
the set's size.  Two sets are compared by Jaccard similarity.

Near duplicates (``near_duplicates``) are all pairs of sets whose similarity reaches a
threshold t.  It is at most the smaller size over the larger one, so sizes are cut into
length partitions in which a set's partners lie in its own partition or in the next.
Inside a partition sets are indexed by their rarest signatures: in an order common to all
sets, by the number of sets that hold a signature, a pair's first common signature is among
the first ones of both.  The pair is a candidate there only, if its sizes and what follows
in both sets still allow t, and is verified on the whole sets.  Equal sets are compared once.
The query ``op5_spot_signatures`` compares given pairs; ``op5_near_duplicates`` is the join, a
row a document with its class of equal sets and that class's number of similar classes.

The next document of a document, in ascending order of ids, is found without a global
sort: ids, of any type with an order, are cut into ranges, every range also gets the first document of
the next one, and a window runs inside a bucket.

Edge cases: a null text counts as empty; a text without signatures has a single one, the
hash of the whole text; rows that share an id follow each other in the order of their
texts; a null id comes first; one row alone is its own next document; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylens.llm.common import load, materialise, shuffle_partitions

# Anchors, and further common words that chains pass over (en, de, fr, es).
ANCHORS = ("a an the is are was be der die das ist ein eine und le la les un une est et el los las es y "
           "una").split()
PASSED = ("of and to in that it with for as on by this from at or not have in zu den von mit sich des dem "
          "auf für im nicht als auch de du des en dans que qui au pour par sur pas avec de en que del se "
          "por con para al lo").split()
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def with_signatures(docs: DataFrame, text: Column, name: str, chain: int = 2) -> DataFrame:
    """Adds column ``name``: the sorted distinct signature hashes of a whole text."""
    common = sorted(set(ANCHORS) | set(PASSED))
    w, c, s = f"_{name}_words", f"_{name}_content", f"_{name}_text"
    df = docs.withColumn(s, F.coalesce(text, F.lit("")))
    df = df.withColumn(w, F.filter(F.split(F.lower(s), SEPARATORS), lambda x: x != ""))
    df = df.withColumn(c, F.filter(F.transform(w, lambda x, i: F.when(
        ~x.isin(common), F.struct(x.alias("x"), i.alias("i")))), lambda m: m.isNotNull()))
    # an anchor is followed by the chain that begins at the next content word
    chains = F.transform(c, lambda m, k: F.when(
        F.get(w, m["i"] - 1).isin(ANCHORS) & (k + chain <= F.size(c)),
        F.xxhash64(F.get(w, m["i"] - 1), m["x"], *[F.get(c, k + j)["x"] for j in range(1, chain)])))
    found = F.array_sort(F.array_distinct(F.filter(chains, lambda h: h.isNotNull())))
    df = df.withColumn(name, found)
    return df.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(
        F.array(F.xxhash64(s)))).drop(w, c, s)


def fingerprint(signature_set: Column) -> Column:
    """Set size, then the signatures as sixteen hexadecimal digits each."""
    return F.concat(F.size(signature_set).cast("string"), F.lit(":"), F.array_join(
        F.transform(signature_set, lambda h: F.lpad(F.hex(h), 16, "0")),
        ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def with_next(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """Rows of ``docs`` with next_<column> for every carried column: those of the next row
    in ascending order of (id, text), the first row's after the last."""
    n = 4 * shuffle_partitions(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("i"))
    # ids that begin a range, whatever their type; the least id first, nulls in a range before it
    ranged = ids.filter("i IS NOT NULL").repartitionByRange(n, "i").withColumn("part", F.spark_partition_id())
    bounds = sorted(r["i"] for r in ranged.groupBy("part").agg(F.min("i").alias("i")).collect())
    nulls = 0 if ids.filter("i IS NULL").isEmpty() else 1
    kind = docs.schema[id_col].dataType
    starts = F.array(*[F.lit(b).cast(kind) for b in bounds]).cast(T.ArrayType(kind))
    last = max(0, len(bounds) - 1 + nulls)
    before = F.size(F.filter(starts, lambda b: b <= F.col("_id")))
    bucket = F.when(F.col("_id").isNull(), 0).otherwise(F.greatest(before - 1 + nulls, F.lit(0)))
    rows = docs.withColumn("_id", F.col(id_col)).withColumn("_bucket", bucket)
    # the rows that begin a bucket also close the one before it
    begins = F.col("_id").isNull() | F.coalesce(F.array_contains(starts, F.col("_id")), F.lit(False))
    homes = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("ghost")))
    ghosts = F.array(F.struct(F.when(F.col("_bucket") == 0, last).otherwise(F.col("_bucket") - 1).alias("b"),
                              F.lit(True).alias("ghost")))
    rows = rows.withColumn("_home", F.explode(F.when(begins, F.concat(homes, ghosts)).otherwise(homes)))
    order = Window.partitionBy("_home.b").orderBy("_home.ghost", "_id", text_col)
    return (rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
            .filter(~F.col("_home.ghost")).drop("_id", "_bucket", "_home"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n_chars, signatures, fingerprint of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias(text_col))
    rows = with_signatures(rows, F.col(text_col), "signatures")
    return rows.select(id_col, text_col, F.length(text_col).cast("long").alias("n_chars"), "signatures",
                       fingerprint(F.col("signatures")).alias("fingerprint"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (its last half replaced by the first
    code points of the next document), and the likeness of the text's fingerprint to the
    edited text's and to the next document's."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_signatures(docs.select(F.col(id_col), text.alias("text")), F.col("text"), "signatures")
    rows = with_next(rows, id_col, "text", ["text", "signatures"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select(id_col, "n_chars", "signatures", "next_signatures", "edited")
    rows = with_signatures(rows, F.col("edited"), "edited_signatures")
    return rows.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"))


def length_bounds(most: int, num: int, den: int) -> list[int]:
    """Least size of each length partition, for sets of at most ``most`` signatures.  A set's
    partners of its own size or more lie in its partition or the next."""
    bounds = [1]
    while bounds[-1] * den // num < most:
        bounds.append(bounds[-1] * den // num + 1)
    return bounds


def similar_sets(docs: DataFrame, id_col: str, text_col: str, num: int,
                 den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (uid, id, signatures); distinct sets (uid, id, signatures, size) with the least
    id of their documents; pairs (a_uid, a, b_uid, b, likeness) of sets whose Jaccard similarity
    is num / den or more, the smaller set first."""
    rows = materialise(fingerprints(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), "signatures"), "spot-rows")
    first = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "uid"))  # a null id is the least
    sets = materialise(rows.groupBy("signatures").agg(first.alias("m")).select(
        "m.uid", "m.id", "signatures", F.size("signatures").alias("size")), "spot-sets")
    bounds = length_bounds(sets.agg(F.max("size")).first()[0] or 1, num, den)

    # the signatures of each set, those of few sets first
    each = sets.select("uid", F.explode("signatures").alias("signature"))
    held = each.groupBy("signature").agg(F.count(F.lit(1)).alias("held"))
    ordered = (each.join(held.hint("shuffle_merge"), "signature").groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("held", "signature"))).alias("o"))
        .select("uid", F.col("o.signature").alias("o")))
    ordered = materialise(ordered.select("uid", "o", F.size("o").alias("size")), "spot-orders")

    def posted(shared: Column, name: str) -> DataFrame:
        """A row for each signature of a prefix that meets every partner, of which at least
        ``shared`` signatures are the partner's too."""
        prefix = F.slice("o", F.lit(1), F.col("size") - shared.cast("int") + 1)
        own = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("size")))
        cut = ordered.select("uid", "size", own.alias("own"), F.col("o").alias("all"), F.posexplode(prefix).alias(
            "place", "signature"))
        return cut.select("signature", "own", *[c.alias(f"{name}_{n}") for n, c in (
            ("uid", F.col("uid")), ("size", F.col("size")), ("place", F.col("place")),
            ("earlier", F.slice("all", F.lit(1), F.col("place"))))])

    size = F.col("size")
    large = posted(F.ceil(size * num / den), "b").withColumnRenamed("own", "part")
    small = posted(F.ceil(size * (2 * num) / (num + den)), "a").withColumn(
        "part", F.explode(F.array(F.col("own"), F.col("own") + 1))).drop("own")
    sizes = F.col("a_size") + F.col("b_size")
    left = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    pairs = small.hint("shuffle_merge").join(large, ["part", "signature"]).filter(
        (F.struct("a_size", "a_uid") < F.struct("b_size", "b_uid"))
        & (F.col("a_size") * den >= F.col("b_size") * num)
        & (left * (num + den) >= sizes * num)
        & ~F.arrays_overlap("a_earlier", "b_earlier")).select("a_uid", "b_uid")
    side = {n: sets.select(F.col("uid").alias(f"{n}_uid"), F.col("id").alias(n),
                           F.col("signatures").alias(f"{n}_set")) for n in ("a", "b")}
    common = F.size(F.array_intersect("a_set", "b_set"))
    found = (pairs.join(side["a"], "a_uid").join(side["b"], "b_uid")
             .withColumn("common", common)
             .withColumn("either", F.size("a_set") + F.size("b_set") - F.col("common"))
             .filter(F.col("common") * den >= F.col("either") * num)
             .select("a_uid", "a", "b_uid", "b", (F.col("common") / F.col("either")).alias("likeness")))
    return rows, sets, found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80,
                    den: int = 100) -> DataFrame:
    """<id>, other_<id>, likeness, copy: the pairs of documents whose signature sets have a
    Jaccard similarity of num / den or more.

    Documents of equal sets stand behind the one of the least id: each other one has a row
    with it (``copy``, likeness 1), and only it is paired with other sets, the smaller set first.
    """
    rows, sets, found = similar_sets(docs, id_col, text_col, num, den)
    copies = (rows.alias("r").join(sets.alias("s"), "signatures").filter(F.col("r.uid") != F.col("s.uid"))
              .select(F.col("s.id").alias("a"), F.col("r.id").alias("b"), F.lit(1.0).alias("likeness"),
                      F.lit(True).alias("copy")))
    pairs = found.select("a", "b", "likeness", F.lit(False).alias("copy")).unionByName(copies)
    return pairs.select(F.col("a").alias(id_col), F.col("b").alias(f"other_{id_col}"), "likeness", "copy")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80,
                           den: int = 100) -> DataFrame:
    """<id>, class_<id>, n_links: a row for each document.  Documents of equal signature sets are
    a class, named by their least id; n_links counts the other classes whose sets have a Jaccard
    similarity of num / den or more with its own."""
    rows, sets, found = similar_sets(docs, id_col, text_col, num, den)
    ends = found.select(F.explode(F.array("a_uid", "b_uid")).alias("uid"))
    links = ends.groupBy("uid").agg(F.count(F.lit(1)).alias("n_links"))
    classes = sets.join(links, "uid", "left").select(
        "signatures", F.col("id").alias(f"class_{id_col}"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(classes, "signatures").select(F.col("id").alias(id_col), f"class_{id_col}", "n_links")


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(load(spark, sf_dir, "documents", "doc_id", "text"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(load(spark, sf_dir, "documents", "doc_id", "text"))
