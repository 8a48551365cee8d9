"""Reading survey files, writing predictions, reading scoring requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylens import schema as S
from surveylens.operators.profile import nan_to_null
from surveylens.sources.tables import SURVEY_VIEW_COLUMNS


def read_survey(spark: SparkSession, path: str, fmt: str = "csv",
                schema: T.StructType | None = S.RAW_SURVEY_SCHEMA) -> DataFrame:
    """A survey file as a DataFrame: explicit schema (no inference pass), NaN -> NULL.

    CSV is split by Spark across tasks like any text file; parquet gets column pruning
    and filter pushdown.
    """
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.csv(path)
    elif fmt == "parquet":
        df = reader.parquet(path)
    else:
        df = reader.format(fmt).load(path)
    return nan_to_null(df)


def to_raw_survey(view: DataFrame) -> DataFrame:
    """The survey view under the study file's own headers (spaces, '-', '/').

    The key doubles as the row-number column; numbering rows densely would need one
    global ordering task, which the study never relies on (the column is dropped).
    """
    names = [n for n, _ in S.RAW_SURVEY_COLUMNS]
    types = dict(S.RAW_SURVEY_COLUMNS)
    src = ["id", *SURVEY_VIEW_COLUMNS]
    return view.select(*[F.col(s).cast(types[n]).alias(n) for s, n in zip(src, names)])


def write_survey_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Predictions with their key; overwrite is idempotent, so a retried job is safe."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Scoring requests (key + 22 encoded base answers) with a fixed schema."""
    return spark.read.schema(S.REQUEST_SCHEMA).format(fmt).load(path)
