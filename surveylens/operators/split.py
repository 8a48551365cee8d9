"""Splits, folds and row sampling -- all deterministic functions of the key.

A hash of (seed, key) decides membership, so a split is stable under repartitioning,
re-execution after executor loss, and adding rows; ``randomSplit``/``rand`` are
neither.  Folds are hash buckets too (approximately stratified: the label plays no
part, but with millions of rows each fold's label rate matches the whole to within
sampling noise -- a per-class ``row_number`` would put each class into one task).

``exact_train`` and ``with_stratified_folds`` give exact sizes: rows are ranked by the hash of
their key, in two levels (equal ranges of hashes with their counts, then a window inside one
range), so no task holds a whole class.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.functions.columns import hash_bucket


def split_column(key: str = "ID", seed: int = S.SPLIT_SEED,
                 test_fraction: float = S.SPLIT_TEST_FRACTION):
    """True for training rows: md5(seed:key) bucket below (1 - test) of the buckets.  There are
    100 buckets, or the power of ten (up to 10**9) that resolves a finer fraction."""
    buckets = 100
    while buckets < 10**9 and abs(test_fraction * buckets - round(test_fraction * buckets)) > 1e-9 * buckets:
        buckets *= 10
    return hash_bucket(F.col(key), seed, buckets) < buckets - int(round(buckets * test_fraction))


def train_test_split(df: DataFrame, key: str = "ID", seed: int = S.SPLIT_SEED,
                     test_fraction: float = S.SPLIT_TEST_FRACTION) -> tuple[DataFrame, DataFrame]:
    is_train = split_column(key, seed, test_fraction)
    return df.filter(is_train), df.filter(~is_train)


def with_folds(df: DataFrame, k: int, key: str = "ID", seed: int = S.MODEL_SEED,
               col: str = "fold") -> DataFrame:
    return df.withColumn(col, hash_bucket(F.col(key), seed, k).cast("int"))


def with_rank(df: DataFrame, name: str, by: list[str], key: str = "ID", seed: int = S.SPLIT_SEED) -> DataFrame:
    """Adds ``name``: the row's place (from 0) by (md5(seed:key), key) among the rows of equal
    ``by``.  Rows of one key stand together in any order; a null key is first."""
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit("0" * 32))
    rows = df.withColumn("__h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")) \
        .withColumn("__range", F.floor(F.col("__h") / (2.0 ** 60 / ranges)).cast("int"))
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    classes = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    starts = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__rows")) \
        .withColumn("__start", F.coalesce(F.sum("__rows").over(upto), F.lit(0))) \
        .select(F.col("__range").alias("__r"), "__start", *[F.col(c).alias(f"__{c}") for c in by])
    join = F.col("__range") == F.col("__r")
    for c in classes:
        join = join & c
    inside = Window.partitionBy(*by, "__range").orderBy("__h", key)
    return (rows.withColumn("__own", F.row_number().over(inside)).join(starts, join)
            .withColumn(name, F.col("__start") + F.col("__own") - 1).select(*df.columns, name))


def exact_train(df: DataFrame, name: str, key: str = "ID", seed: int = S.SPLIT_SEED,
                test_fraction: float = S.SPLIT_TEST_FRACTION) -> DataFrame:
    """Adds ``name``, true for exactly n - ceil(n * test_fraction) rows of the smallest hashes."""
    n = df.count()
    # a fraction such as 0.4 is meant in decimal: 0.4 * 5 must not become 3
    kept = n - math.ceil(round(n * test_fraction, 6))
    return with_rank(df, name, [], key, seed).withColumn(name, F.col(name) < kept)


def with_stratified_folds(df: DataFrame, k: int, label: str, key: str = "ID", seed: int = S.MODEL_SEED,
                          col: str = "fold") -> DataFrame:
    """Adds ``col``: folds whose sizes differ by at most one in every class."""
    return with_rank(df, col, [label], key, seed).withColumn(col, (F.col(col) % k).cast("int"))


def sample_one(df: DataFrame, key: str = "ID", seed: int = S.MODEL_SEED) -> DataFrame:
    """One reproducible pseudo-random row: smallest md5(seed:key), ties by key.

    ``orderBy().limit(1)`` plans as TakeOrderedAndProject: each task keeps its best
    row, the driver merges one row per task.
    """
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8),
                    16, 10).cast("long")
    return df.withColumn("__h", digest).orderBy("__h", key).limit(1).drop("__h")


def lookup_row(df: DataFrame, key_value, key: str = "ID") -> DataFrame:
    """Rows with the given key (pushed down to the scan when the key is a column)."""
    return df.filter(F.col(key) == F.lit(key_value))


def lookup_rows(df: DataFrame, keys: DataFrame, key: str = "ID") -> DataFrame:
    """Rows whose key appears in ``keys`` (a semi join; AQE broadcasts a small key set)."""
    return df.join(keys.select(key), key, "left_semi")


def head_tail(df: DataFrame, n: int = 5, key: str = "ID") -> DataFrame:
    """First and last ``n`` rows in key order, tagged 'head' / 'tail' (two top-k)."""
    head = df.orderBy(F.col(key).asc()).limit(n).withColumn("position", F.lit("head"))
    tail = df.orderBy(F.col(key).desc()).limit(n).withColumn("position", F.lit("tail"))
    return head.unionByName(tail)
