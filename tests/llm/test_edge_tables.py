"""Every operator and stage on odd rows, on an empty table, and with clashing column names."""

import time

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from surveylens.llm import (licenses, mixing, ngram_join, packing, page_text, quality, secrets, spotsigs,
                            token_counts, vector_search)

CLASHES = ("uid", "id", "size", "s", "spans", "got", "node", "grams", "label", "quality_score", "group_id",
           "group_least", "group_rows", "secret_id", "secret_values", "value", "path", "score", "n", "w",
           "next_text", "signatures", "words", "block", "source_no")

OPERATORS = {
    "quality": lambda d: quality.score_documents(d.select("doc_id", "text"), quality.LineField(
        quality.np.zeros(quality.N_FEATURES), 0.0)),
    "licenses": licenses.scan_licenses,
    "mixing": mixing.mix_sources,
    "packing": packing.pack,
    "spotsigs": spotsigs.edited_likeness,
    "token_counts": token_counts.count_tokens,
    "ngram_join": lambda d: ngram_join.near_duplicate_groups(d, n=3, num=90),
    "secrets": secrets.scan_secrets,
    "near_duplicates": spotsigs.near_duplicates,
    "near_duplicate_classes": spotsigs.near_duplicate_classes,
    "mixed_shards": mixing.mixed_shards,
    "pages": lambda d: page_text.extract_pages(d, "text", ("doc_id", "source")),
}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(odd_docs, name):
    plain = rows(OPERATORS[name](odd_docs))
    clashing = odd_docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    assert rows(OPERATORS[name](clashing)) == plain
    assert plain


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd_docs, name):
    assert OPERATORS[name](odd_docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "quality"])
def test_string_ids(odd_docs, name):
    named = odd_docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert any("d10" in r for r in rows(OPERATORS[name](named)))


def test_next_document_by_string_ids(odd_docs):
    named = odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]) \
        .withColumn("doc_id", F.chr(F.lit(96) + F.col("doc_id")))  # the same order
    plain = odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    strip = [c for c in spotsigs.edited_likeness(plain).columns if c != "doc_id"]
    assert rows(spotsigs.edited_likeness(named).select(strip)) == rows(spotsigs.edited_likeness(plain).select(strip))


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x", "<div>" * 100_000 + "</q>" * 100_000 + "x", "<b>" * 100_000 + "<hr>" * 100_000 + "x",
    "<table>" + "<i>" * 50_000 + "</div>" * 50_000 + "x", "<div>" * 50_000 + "<table>" + "</div>" * 100_000 + "x",
    "<p><b>" * 50_000 + "x"])
def test_deep_pages_take_time_in_proportion(page):
    start = time.process_time()
    assert page_text.main_text(page) == "x"
    assert time.process_time() - start < 10


@pytest.mark.parametrize("name", ["ngram_join", "secret_scans", "source_mixing"])
def test_stage_keeps_columns(spark, odd_docs, name):
    stage = dict(pipeline.STAGES)[name]
    clashing = odd_docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    out = stage(spark, clashing, "")
    assert out.columns == clashing.columns
    assert out.filter("uid <> 'clash' or score <> 'clash'").count() == 0
    base = stage(spark, odd_docs, "")
    assert base.schema.simpleString() == odd_docs.schema.simpleString()
    assert rows(out.select(*odd_docs.columns)) == rows(base)
    assert stage(spark, odd_docs.limit(0), "").collect() == []


def test_quality_stage_keeps_columns_and_clean_rows(spark, odd_docs):
    stage = dict(pipeline.STAGES)["quality_classifier"]
    sf_dir = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").select(odd_docs.columns)
    docs = some.unionByName(odd_docs.withColumn("doc_id", -F.col("doc_id")))
    base = stage(spark, docs, sf_dir)
    assert base.schema.simpleString() == docs.schema.simpleString()
    kept = rows(base)
    clashing = docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    out = stage(spark, clashing, sf_dir)
    assert out.columns == clashing.columns and rows(out.select(*docs.columns)) == kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = {r.doc_id for r in some.collect() if labels.get(r.doc_id) == 1}
    left = {r.doc_id for r in base.select("doc_id").collect()}
    assert len(good & left) >= 0.95 * len(good)
    assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_packing_stage_on_clashing_columns_and_no_rows(spark, odd_docs):
    stage = dict(pipeline.STAGES)["curve_packing"]
    clashing = odd_docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    assert rows(stage(spark, clashing, "")) == rows(stage(spark, odd_docs, ""))
    assert stage(spark, odd_docs.limit(0), "").collect() == []


def test_vectors_odd_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0]), (4, None),
           (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (9, [1.0]),
           (None, [1.0, 0.0]), (100, None), (200, [0.0, 0.5])]
    table = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    find = lambda t: rows(vector_search.nearest_neighbours(t, F.col("id") % 100 == 0))
    got = vector_search.nearest_neighbours(table, F.col("id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == [
        (0, 1, 1, 0.0), (0, 2, 200, round(1.25 ** 0.5, 9)), (0, 3, 2, round(2 ** 0.5, 9)),
        (0, 4, 3, round(2 ** 0.5, 9)), (200, 1, 2, 0.5), (200, 2, 0, round(1.25 ** 0.5, 9)),
        (200, 3, 1, round(1.25 ** 0.5, 9)), (200, 4, 3, 1.5)]
    clash = table.select("*", *[F.lit("c").alias(c) for c in ("id", "v", "k", "class", "list", "score", "rank", "all")])
    assert find(clash) == sorted(map(str, got))
    assert find(table.limit(0)) == [] and find(table.filter("vec_id IN (4, 5, 6)")) == []


def test_defined_results(odd_docs):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(odd_docs).collect()}
    assert got[9]["base_labels"] == "mit" and got[9]["first_word"] == 3 and got[9]["n_words"] == 5
    assert got[2]["n_words"] == 0 and got[2]["labels"] == "" and got[2]["first_word"] is None
    groups = ngram_join.near_duplicate_groups(odd_docs, n=3, num=90).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in groups} >= {
        (1, 18, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 18, 1), (None, 0, None), (7, 1, 7)}
    found = [r for r in secrets.scan_secrets(odd_docs).collect() if r["doc_id"] == 10]
    assert [r["value"] for r in found] == ["0c497b5014f705c0be648d68b816f88c209136eb"]
    sections = [r for r in token_counts.count_tokens(odd_docs).collect() if r["doc_id"] == 2]
    assert [(r["section"], r["n_tokens"]) for r in sections] == [(0, 0)]
    pieces = [r for r in packing.pack(odd_docs).collect() if r["doc_id"] == 3]
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in pieces] == [(0, 1, 1)]
