"""The survey frames the queries start from (all lazy, all derived from the driver tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveylens import schema as S
from surveylens.functions import columns as C
from surveylens.operators.profile import string_columns
from surveylens.sources.tables import survey_view


def survey_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey with upper-case column names (ID kept as the key)."""
    return C.upper_names(survey_view(spark, sf_dir))


def survey_target_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-case names and string values, label encoded to 0/1, ID kept."""
    df = survey_upper(spark, sf_dir)
    df = C.upper_values(df, string_columns(df))
    return C.encode_target(df)


def survey_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All encoders applied and the nine interaction features added (no imputation)."""
    df = C.encode_labels(survey_target_encoded(spark, sf_dir))
    return C.add_derived_features(df)


def survey_features_no_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_ids(survey_target_encoded(spark, sf_dir))


NUM_COLS = ["AGE", "FLIGHT_DISTANCE", "DEPARTURE_DELAY_IN_MINUTES", "ARRIVAL_DELAY_IN_MINUTES"]
CAT_STRING_COLS = ["GENDER", "CUSTOMER_TYPE", "TYPE_OF_TRAVEL", "CLASS"]
TARGET = S.TARGET
