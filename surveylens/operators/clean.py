"""Cleaning operators: outlier limits and flags, mode / mean / median imputation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.operators import profile as P


# ---------------------------------------------------------------- outliers ----

def outlier_thresholds(df: DataFrame, columns: list[str], q1: float = 0.25, q3: float = 0.75,
                       exact: bool = True) -> DataFrame:
    """(column_name, q1, q3, iqr, low_limit, up_limit): Q1 - 1.5 IQR and Q3 + 1.5 IQR."""
    qs = P.quantiles(df, columns, [q1, q3], exact=exact)
    wide = (qs.groupBy("column_name")
            .agg(F.max(F.when(F.col("prob") == q1, F.col("value"))).alias("q1"),
                 F.max(F.when(F.col("prob") == q3, F.col("value"))).alias("q3")))
    iqr = F.col("q3") - F.col("q1")
    return (wide.withColumn("iqr", iqr)
            .withColumn("low_limit", F.col("q1") - 1.5 * iqr)
            .withColumn("up_limit", F.col("q3") + 1.5 * iqr))


def threshold_literals(df: DataFrame, columns: list[str], q1: float = 0.25, q3: float = 0.75,
                       exact: bool = True) -> dict[str, tuple[float, float]]:
    """Limits per column, brought to the driver (one row per column)."""
    rows = outlier_thresholds(df, columns, q1, q3, exact).collect()
    return {r["column_name"]: (r["low_limit"], r["up_limit"]) for r in rows}


def outlier_condition(col: str, low: float, up: float):
    """Strictly outside the limits; a value equal to a limit is no outlier."""
    if low is None or up is None:
        return F.lit(False)
    c = F.col(col)
    return (c > F.lit(up)) | (c < F.lit(low))


def outlier_flags(df: DataFrame, columns: list[str], q1: float = 0.25, q3: float = 0.75,
                  exact: bool = True) -> DataFrame:
    """(column_name, low_limit, up_limit, n_outliers, has_outlier) for all columns.

    Limits come from one quantile job; the counting is one more pass with one
    ``count_if`` per column.
    """
    limits = threshold_literals(df, columns, q1, q3, exact)
    limits = {c: limits.get(c, (None, None)) for c in columns}  # a column of nulls has none
    stats = {"n_outliers": None}
    row = df.agg(*[F.count_if(outlier_condition(c, *limits[c])).alias(f"{c}__n_outliers")
                   for c in columns])
    long = P.wide_to_long(row, columns, list(stats))
    low_of = P.literal_lookup(F.col("column_name"), {c: limits[c][0] for c in columns}).cast("double")
    up_of = P.literal_lookup(F.col("column_name"), {c: limits[c][1] for c in columns}).cast("double")
    return (long.withColumn("low_limit", low_of).withColumn("up_limit", up_of)
            .withColumn("has_outlier", F.col("n_outliers") > 0))


def check_outlier(df: DataFrame, columns: list[str], q1: float = 0.25, q3: float = 0.75) -> dict[str, bool]:
    return {r["column_name"]: bool(r["has_outlier"])
            for r in outlier_flags(df, columns, q1, q3).collect()}


def outlier_rows(df: DataFrame, col: str, q1: float = 0.25, q3: float = 0.75,
                 exact: bool = True) -> DataFrame:
    """Rows whose ``col`` lies strictly outside its limits (a pushed-down filter)."""
    low, up = threshold_literals(df, [col], q1, q3, exact).get(col, (None, None))
    return df.filter(outlier_condition(col, low, up))


# -------------------------------------------------------------- imputation ----

def mode_values(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """Most frequent value per column, smallest value on ties (nulls ignored)."""
    if not columns:
        return {}
    freq = P.frequency_table(df, columns, "string")
    best = freq.groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("mode"))
    return {r["column_name"]: r["mode"] for r in best.collect()}


def median_values(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, float]:
    if not columns:
        return {}
    rows = P.quantiles(df, columns, [0.5], exact=exact).collect()
    return {r["column_name"]: r["value"] for r in rows}


def mean_values(df: DataFrame, columns: list[str]) -> dict[str, float]:
    if not columns:
        return {}
    rows = P.per_column_agg(df, columns, {"mean": lambda c: F.avg(c.cast("double"))}).collect()
    return {r["column_name"]: r["mean"] for r in rows}


def fit_missing_fills(df: DataFrame, num_method: str = "median", cat_length: int = S.CAT_LENGTH,
                      target: str = S.TARGET, exact: bool = True) -> dict[str, Any]:
    """Fill value per column that has nulls (the target is never imputed).

    Strings whose distinct count -- counting null as a value -- is at most
    ``cat_length`` get their mode; numeric columns the median or mean.  Only columns
    with nulls are examined (filling the others is a no-op), so at most three small
    jobs run whatever the width of the table.
    """
    if num_method not in ("median", "mean"):
        raise ValueError("num_method must be 'median' or 'mean'")
    with_nulls = [c for c in P.null_columns(df) if c != target]
    strings = [c for c in with_nulls if P.is_string(df, c)]
    numbers = [c for c in with_nulls if P.is_numeric(df, c)]
    fills: dict[str, Any] = {}
    if strings:
        counts = {r["column_name"]: r["n_distinct"]
                  for r in P.distinct_counts(df, strings).collect()}
        eligible = [c for c in strings if counts[c] + 1 <= cat_length]
        fills.update(mode_values(df, eligible))
    if numbers:
        fills.update(median_values(df, numbers, exact) if num_method == "median"
                     else mean_values(df, numbers))
    return fills


def apply_fills(df: DataFrame, fills: dict[str, Any]) -> DataFrame:
    """coalesce(c, fill); numeric columns with a fill become double (fills can be x.5)."""
    out = {}
    for c, v in fills.items():
        if c not in df.columns or v is None:
            continue
        if P.is_numeric(df, c):
            out[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
        else:
            out[c] = F.coalesce(F.col(c), F.lit(v))
    return df.withColumns(out) if out else df


def quick_missing_imp(df: DataFrame, num_method: str = "median", cat_length: int = S.CAT_LENGTH,
                      target: str = S.TARGET) -> DataFrame:
    return apply_fills(df, fit_missing_fills(df, num_method, cat_length, target))
