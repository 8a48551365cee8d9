import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

GOOD = "The river runs past the old mill. It was a quiet morning in the valley.\nBirds sang by the water."


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text, source) rows."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of the stream{i}" for i in range(60_000))
    return make_docs([
        (1, GOOD, "a"), (1, GOOD, "a"), (2, None, "a"), (3, "", None), (4, "   \n\t ", "b"), (None, GOOD, "b"),
        (5, long, "b"), (6, GOOD + " More words came.", None), (7, "x", ""), (8, "é中 \U0001f600 ok", "c"),
        (9, "Released under the MIT License.", "c"),
        (10, 'api token = "0c497b5014f705c0be648d68b816f88c209136eb" end', "c"), (None, None, None)])
