"""Secret scans with a random forest that removes false positives (DataFrame operations and
Spark ML only).

Every whole text is cut into tokens; long runs of key characters in them are candidates,
and shorter ones after an assignment or a credential name.  Each has features of its
length, character transitions, dictionary coverage (letter triples that ordinary words of
the corpus use), of the path (the document's source) and of the neighbouring words.  A
forest trained on labelled findings scores all candidates.

Labelled findings are a parameter; the registered query labels those candidates whose
surroundings leave no doubt (an assignment to a credential word on the one hand; plain
words, plain numbers and checksums on the other) and trains on a bounded sample of them,
``sample`` per class, drawn by hash.  Candidates of all documents are scored.

Work: one scan of the texts that writes only the candidates, one that counts letter triples
(at most 26**3 rows a task leave it); everything later is narrow.

Edge cases: a null or empty text has no candidates; a null path is an empty one; equal
candidates at several places are separate rows; with findings of one class only, every
score is that class's label (0 without findings); other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylens.llm.common import columns_of, fresh, load, materialise

# Names that announce a credential as a part of a key's name (github_token,
# dbPassword, aws_access_key_id), and words that announce a harmless digest.
PARTS = "token|secret|password|passwd|passphrase|apikey|credential|(?:access|secret|private|api|auth|signing)[-]?key"
WHOLE = "key|pwd|pass|auth|authorization|bearer"  # short or common ones stand alone between separators
CREDENTIAL = rf"(?:{PARTS})s?(?:id)?(?:[_\-.0-9]|$)|(?:^|[_\-.])(?:{WHOLE})s?(?:[_\-.0-9]|$)"
HARMLESS = ("sha sha1 sha256 sha512 md5 commit revision checksum digest hash etag uuid guid "
            "fingerprint integrity version").split()
PLAIN_PATH = r"(?i)(test|example|sample|fixture|mock|docs?|readme|lock)"

# an assignment sign before a blank or a quote, = inside a token, : after a credential's name
SIGNS = (r"([=:])(?=[\s\"'])|(?<=\w)(=)(?=\w)"
         r"|(:)(?<=(?i:token|secret|password|passwd|passphrase|pwd|key):)(?=\w)")
CORE = r"([A-Za-z0-9](?:[A-Za-z0-9_+/.~:@-]{%d,})[A-Za-z0-9=])"
FEATURES = ["length", "classes", "runs", "digits", "uppers", "letters", "hex", "distinct",
            "vowels", "switches", "coverage", "plain_path", "credential", "harmless", "near_credential",
            "next_word"]
WORD = r"""(?<![^\s"'(,;])([a-z]{3,})(?![^\s"'),;.:!?])"""
MARK = "[SECRET]"


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9_\-.]|\.+$", "")


def _names_credential(c: Column) -> Column:
    return F.coalesce(_bare(c).rlike(CREDENTIAL), F.lit(False))


def candidate_rows(docs: DataFrame, id_col: str, text_col: str, path_col: str | None,
                   least: int = 16, least_named: int = 8) -> DataFrame:
    """id, path, at (number of the token), value, before, before2, after, assigned: every run
    of ``least`` key characters in a token, of ``least_named`` where the token is assigned or
    one of the two words before it names a credential."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    words = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.filter(
        F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SIGNS, " $1$2$3 "),
                r"""[\s"'`,;|()<>\[\]{}]+"""), lambda w: w != "").alias("w"))
    core = CORE % (least_named - 2)
    sign = lambda x: F.coalesce(x.isin("=", ":", ":="), F.lit(False))
    found = F.filter(F.transform("w", lambda x, i: F.when(
        (F.length(x) >= least_named) & x.rlike(core), F.struct(
            i.cast("long").alias("at"), F.regexp_extract_all(x, F.lit(core), F.lit(1)).alias("values"),
            sign(F.get("w", i - 1)).alias("assigned"),
            F.when(sign(F.get("w", i - 1)), F.get("w", i - 2)).otherwise(F.get("w", i - 1)).alias("before"),
            F.when(sign(F.get("w", i - 1)), F.get("w", i - 3)).otherwise(F.get("w", i - 2)).alias("before2"),
            F.get("w", i + 1).alias("after")))), lambda m: m.isNotNull())
    named = F.col("assigned") | _names_credential(F.col("before")) | _names_credential(F.col("before2"))
    return (words.select("id", "path", F.explode(found).alias("m"))
            .select("id", "path", "m.at", F.explode("m.values").alias("value"), "m.assigned",
                    *[F.coalesce(F.lower(f"m.{c}"), F.lit("")).alias(c)
                      for c in ("before", "before2", "after")])
            .filter((F.length("value") >= least) | named))


def _triples(word: Column) -> Column:
    """Letter triples of a word (array)."""
    return F.when(F.length(word) >= 3, F.transform(
        F.sequence(F.lit(1), F.length(word) - 2), lambda k: F.substring(word, k, F.lit(3)))
    ).otherwise(F.array().cast("array<string>"))


def dictionary(docs: DataFrame, text_col: str, share: float = 1e-4) -> list[str]:
    """Letter triples that make up at least ``share`` of all triples of the words of letters
    only in all texts.  At most 26**3 triples exist."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(1))
    counts = docs.select(F.explode(F.flatten(F.transform(words, _triples))).alias("t")).groupBy("t").agg(
        F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    return sorted(r["t"] for r in counts if r["n"] >= share * total)


def add_features(rows: DataFrame, triples: list[str]) -> DataFrame:
    v, n = F.col("value"), F.length("value")

    def part(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)) / n

    own = _triples(F.lower("value"))
    harmless = lambda c: F.regexp_replace(c, r"[^a-z0-9_\-]", "").isin(HARMLESS)
    before, before2 = F.col("before"), F.col("before2")
    known = F.size(F.filter(own, lambda t: t.isin(triples))) if triples else F.lit(0)
    return rows.select(
        "*", n.cast("double").alias("length"),
        (v.rlike("[a-z]").cast("int") + v.rlike("[A-Z]").cast("int") + v.rlike("[0-9]").cast("int")
         + v.rlike("[^A-Za-z0-9]").cast("int")).cast("double").alias("classes"),
        part("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+").alias("runs"),
        part("[0-9]").alias("digits"), part("[A-Z]").alias("uppers"), part("[A-Za-z]").alias("letters"),
        part("[0-9a-fA-F]").alias("hex"),
        (F.size(F.array_distinct(F.split("value", ""))) / n).alias("distinct"),
        part("[aeiouAEIOU]").alias("vowels"),
        part("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])").alias("switches"),
        (known / F.greatest(F.size(own), F.lit(1))).alias("coverage"),
        F.col("path").rlike(PLAIN_PATH).cast("double").alias("plain_path"),
        (_names_credential(before) & F.col("assigned")).cast("double").alias("credential"),
        (harmless(before) | harmless(before2)).cast("double").alias("harmless"),
        (_names_credential(before) | _names_credential(before2)).cast("double").alias("near_credential"),
        F.col("after").rlike("^[a-z]").cast("double").alias("next_word"))


def clear_findings(rows: DataFrame) -> DataFrame:
    """The candidates whose surroundings leave no doubt, with label 0 or 1."""
    mixed = (F.col("digits") > 0) & (F.col("letters") > 0)
    yes = (F.col("credential") == 1) & mixed & (F.col("coverage") < 0.5)
    no = (F.col("harmless") == 1) | (F.col("letters") == 1) | (F.col("letters") == 0) \
        | (F.col("value").contains("@")) | F.col("value").contains("://")
    return rows.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).filter(F.col("label").isNotNull())


def train_forest(findings: DataFrame, sample: int = 5000, trees: int = 40, depth: int = 6, seed: int = 9):
    """A forest from labelled findings (features and label), at most ``sample`` a class; the
    label itself if there is one class, 0.0 without findings."""
    order = [F.xxhash64("value", "id", "at"), F.col("value"), F.col("at")]
    parts = [findings.filter(F.col("label") == y).orderBy(*order).limit(sample) for y in (0.0, 1.0)]
    chosen = materialise(parts[0].unionByName(parts[1]).select("label", *FEATURES), "secret-findings")
    classes = [r["label"] for r in chosen.select("label").distinct().collect()]
    if len(classes) < 2:
        return classes[0] if classes else 0.0
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(chosen.coalesce(1))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth,
                                  seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def score_candidates(rows: DataFrame, model) -> DataFrame:
    """Adds score: the forest's probability that a candidate is a secret."""
    if isinstance(model, float):
        return rows.withColumn("score", F.lit(model))
    wide = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)
    model = model.setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("_r") \
        .setPredictionCol("_y")
    return model.transform(wide).withColumn("score", vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_y")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path_col: str | None = "source", findings: DataFrame | None = None,
                 threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, at, value, score, is_secret, and its features.

    ``findings`` (value, before, before2, after, assigned, path, label) are labelled
    findings to train on; unset, the candidates that leave no doubt.
    """
    rows = materialise(candidate_rows(docs, id_col, text_col, path_col), "secret-candidates")
    triples = dictionary(docs, text_col)
    featured = add_features(rows, triples)
    known = clear_findings(featured) if findings is None else add_features(
        findings.withColumn("id", F.lit(0)).withColumn("at", F.lit(0)), triples)
    scored = score_candidates(featured, train_forest(known))
    return scored.select(F.col("id").alias(id_col), "at", "value", "score",
                         (F.col("score") >= threshold).alias("is_secret"), *FEATURES)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   path_col: str | None = "source", broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with every accepted secret in a text replaced by a mark; nothing else changes."""
    key, values = fresh(docs, "secret_id"), fresh(docs, "secret_values")
    secrets = materialise(
        scan_secrets(docs, id_col, text_col, path_col).filter("is_secret")
        .groupBy(F.col(id_col).alias(key)).agg(F.array_sort(
            F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias(values)), "secrets-found")
    side = F.broadcast(secrets) if secrets.count() <= broadcast_rows else secrets
    text = F.aggregate(F.coalesce(values, F.array().cast("array<string>")), F.col(text_col),
                       lambda t, s: F.replace(t, s, F.lit(MARK)))
    joined = docs.join(side, F.col(id_col).eqNullSafe(F.col(key)), "left")
    out = dict(zip(docs.columns, columns_of(docs), strict=True)) | {text_col: text.alias(text_col)}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col(values).isNull(), F.col("n_chars")).otherwise(
            F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return joined.select(*out.values())


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
