"""A training-data pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared checkpoint folder and rereads it as the next stage's ``docs``.  All
stages but the last return the columns of ``documents``:

1. quality_classifier drops the documents that the line field scores below 0.3;
2. ngram_join keeps one document of each group of near duplicates (five-word n-grams,
   Jaccard 0.8 or more);
3. secret_scans replaces the secrets that the forest accepts by a mark;
4. source_mixing returns what each shard takes of every document, one row per epoch;
5. curve_packing cuts the mix into sequences of 4096 tokens.

A table without rows passes through all stages; extra columns are kept up to the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylens.llm import mixing, ngram_join, packing, quality, secrets
from surveylens.llm.common import columns_of, fresh, load, materialise

ORACLE_SQL = None  # the learnt and the random stages have no SQL form


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels", "doc_id", "quality").filter(~quality.held_out())
    score = fresh(docs, "quality_score")
    scored = quality.score_documents(docs, quality.train(docs, labels), name=score)
    return scored.filter(F.col(score) >= quality.THRESHOLD).select(*columns_of(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs, n=5, num=80)


def mark_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("ngram_join", keep_one_of_each),
    ("secret_scans", mark_secrets),
    ("source_mixing", mix),
    ("curve_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
