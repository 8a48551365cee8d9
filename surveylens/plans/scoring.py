"""Scoring requests: validation, preparation with the frozen model, prediction, outcome.

The same function serves a batch (``spark.read``) and a stream (``readStream``):
everything after the source is one stateless projection, with fitted
statistics and stumps inlined as literals -- no join, no state, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.functions import columns as C
from surveylens.operators.boost import BoostedStumps
from surveylens.plans.prep import PrepModel, apply_prep, features_from_encoded
from surveylens.sources.model_store import load_model
from surveylens.sources.survey_io import read_survey, write_predictions

# --------------------------------------------------------------------------
# Outcome messages of the one-record scoring form (class 1 / 0).
# --------------------------------------------------------------------------
OUTCOME_SATISFIED = "satisfied customer"
OUTCOME_UNSATISFIED = "unsatisfied customer"


def violations_expr(ranges: dict[str, tuple[int, int]] = S.REQUEST_RANGES) -> Column:
    """Comma-separated names of fields that are missing or outside their range."""
    parts = [F.when(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi), F.lit(c))
             for c, (lo, hi) in ranges.items()]
    return F.concat_ws(",", *parts)


def validate_ranges(requests: DataFrame, ranges: dict[str, tuple[int, int]] = S.REQUEST_RANGES) -> DataFrame:
    """Requests with at least one violation: key, violations, n_violations."""
    n = sum(F.when(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi), 1).otherwise(0)
            for c, (lo, hi) in ranges.items())
    return (requests.withColumn("n_violations", n.cast("long"))
            .filter(F.col("n_violations") > 0)
            .select("ID", violations_expr(ranges).alias("violations"), "n_violations"))


def score_requests(requests: DataFrame, prep: PrepModel, model: BoostedStumps,
                   ranges: dict[str, tuple[int, int]] = S.REQUEST_RANGES) -> DataFrame:
    """Every request -> (ID, decision, prediction, outcome, violations).  Requests with missing
    or out-of-range answers are rejected: violations names the fields, the rest is null.
    Derived features are always recomputed from the base answers, so they can never
    contradict them."""
    # features_from_encoded keeps the columns it knows; the violations travel in the key
    base = requests.select(F.struct("ID", violations_expr(ranges).alias("violations")).alias("ID"),
                           *S.BASE_FEATURES)
    scored = model.transform(features_from_encoded(base, prep, keep_target=False))
    ok = F.col("ID.violations") == ""
    outcome = F.when(F.col("prediction") == 1, OUTCOME_SATISFIED).otherwise(OUTCOME_UNSATISFIED)
    return scored.select(F.col("ID.ID").alias("ID"), F.when(ok, F.col("decision")).alias("decision"),
                         F.when(ok, F.col("prediction")).alias("prediction"),
                         F.when(ok, outcome).alias("outcome"), F.col("ID.violations").alias("violations"))


def requests_from_survey(survey: DataFrame) -> DataFrame:
    """Requests as a form would send them: key + the 22 base answers, encoded; an answer that
    was not given stays null.  ``survey`` has upper-case names and string values."""
    kept = survey.withColumns({c: F.when(F.col(c).isNotNull(), C.encode(c, codes))
                               for c, codes in S.ENCODERS.items()})
    return kept.select("ID", *[F.col(c).cast("long").alias(c) for c in S.BASE_FEATURES])


def predict_file(spark: SparkSession, source: str, model_path: str, sink: str) -> DataFrame:
    """Batch scoring: read a raw survey file, prepare it with the saved statistics, score it with
    the saved booster, write the predictions; returns what was written."""
    prep, model = load_model(spark, model_path)
    raw = read_survey(spark, source)
    scored = model.transform(apply_prep(raw, prep)).select(prep.key, "decision", "prediction")
    write_predictions(scored, sink)
    return spark.read.parquet(sink)
