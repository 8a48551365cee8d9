"""Preparation as fit / apply.

``fit_prep`` learns everything that depends on data -- column roles, fill values,
scaling statistics -- in a handful of aggregation jobs over the training rows, and
returns a small ``PrepModel`` (a few values per column).  ``apply_prep`` turns any
frame with the survey's columns (training rows, a holdout, a batch of requests or a
stream) into model inputs with one projection: no job, no join, nothing refitted.
That fixes the study's refit-on-whatever-is-scored behaviour and makes batch and
single-record scoring identical.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.functions import columns as C
from surveylens.operators import clean as CL
from surveylens.operators import profile as P


@dataclass
class PrepModel:
    upper_string_cols: list[str]             # string columns whose values are upper-cased
    fills: dict[str, Any]                    # column -> fill value (normalised names)
    scale_cols: list[str]                    # numeric role at cat_th=20, standardised
    means: dict[str, float]
    stds: dict[str, float]                   # population std (ddof 0)
    feature_cols: list[str] = field(default_factory=lambda: list(S.FEATURES))
    target: str = S.TARGET
    key: str = "ID"
    outliers: dict[str, bool] = field(default_factory=dict)  # report of the outlier check

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "PrepModel":
        return PrepModel(**json.loads(text))


def _names_upper_normalised(df: DataFrame) -> DataFrame:
    return C.normalise_names(C.upper_names(df))


def _stage_encoded_target(df: DataFrame, upper_cols: list[str], target: str, key: str) -> DataFrame:
    df = C.drop_ids(_names_upper_normalised(df), keep_key=key)  # the model's names are normalised
    df = C.upper_values(df, [c for c in upper_cols if c in df.columns])
    return C.encode_target(df, target) if target in df.columns else df


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, s, d, n): frequency of every value of every column, nulls included.

    ``s`` holds string values, ``d`` numeric ones (as double).  One scan; the partial
    aggregate collapses repeated values map-side, so the shuffle carries distinct
    values per task only.  Everything ``fit_prep`` needs is derived from this table.
    """
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"),
        (F.col(c) if P.is_string(df, c) else F.lit(None).cast("string")).alias("s"),
        (F.col(c).cast("double") if P.is_numeric(df, c) else F.lit(None).cast("double")).alias("d"))
        for c in columns])
    long = df.select(F.inline(rows))
    return long.groupBy("column_name", "s", "d").agg(F.count(F.lit(1)).alias("n"))


def fit_prep(raw: DataFrame, target: str = S.TARGET, key: str = "ID",
             num_method: str = "median", outlier_report: bool = False) -> PrepModel:
    """Learn roles, fills and scaling statistics from ``raw`` with one scan of it.

    The scan builds the value-frequency profile of every non-key column; roles,
    upper-casing, fill values (mode / exact median / mean) and the mean and population
    std of the log1p-transformed, imputed columns are then computed on that small
    table.  The interaction features need no pass: their code tables have at most 12
    values, so they can never reach the scaling threshold of 20 distinct values.
    """
    up = C.normalise_names(C.drop_ids(C.upper_names(raw), keep_key=None))
    cols = [c for c in up.columns if c != key]
    prof = column_profile(up, cols).persist()
    try:
        return _fit_from_profile(up, prof, target, key, num_method, outlier_report)
    finally:
        prof.unpersist()


def _fit_from_profile(up: DataFrame, prof: DataFrame, target: str, key: str,
                      num_method: str, outlier_report: bool) -> PrepModel:
    strings = [c for c in up.columns if c != key and P.is_string(up, c)]
    numbers = [c for c in up.columns if c not in (key, target) and P.is_numeric(up, c)]
    nonnull = F.col("s").isNotNull() | F.col("d").isNotNull()
    # 1. upper-case strings with at most car_th distinct values
    tally = prof.groupBy("column_name").agg(
        F.count_if(nonnull).alias("k"), F.sum(F.when(~nonnull, F.col("n"))).alias("nulls")).collect()
    raw_counts = {r["column_name"]: r["k"] for r in tally if r["k"]}
    nulls = {r["column_name"]: r["nulls"] for r in tally if r["nulls"]}
    upper_cols = [c for c in strings if raw_counts.get(c, 0) <= S.CAR_TH]
    sprof = (prof.filter(F.col("column_name").isin(strings))
             .withColumn("s", F.when(F.col("column_name").isin(upper_cols), F.upper("s")).otherwise(F.col("s")))
             .groupBy("column_name", "s").agg(F.sum("n").alias("n")))
    # 2. outlier report (optional): quartiles from the profile
    outliers: dict[str, bool] = {}
    if outlier_report:
        out_cols = [c for c in numbers if raw_counts.get(c, 0) >= S.CAT_TH_OUTLIER]
        outliers = _outliers_from_profile(prof, out_cols)
    # 3. a fill for every column (never the target): rows scored later may have nulls elsewhere
    fills: dict[str, Any] = {}
    fillable = [c for c in strings if c != target and raw_counts.get(c, 0) > 0]
    if fillable:
        best = (sprof.filter(F.col("column_name").isin(fillable) & F.col("s").isNotNull()).groupBy("column_name")
                .agg(F.min_by("s", F.struct((-F.col("n")).alias("nn"), F.col("s"))).alias("m"),
                     F.count(F.lit(1)).alias("k")))
        fills.update({r["column_name"]: r["m"] for r in best.collect()
                      if r["k"] + (nulls.get(r["column_name"], 0) > 0) <= S.CAT_LENGTH})
    if numbers:
        nprof = prof.filter(F.col("column_name").isin(numbers) & F.col("d").isNotNull())
        if num_method == "median":
            agg = (P.quantiles_from_freq(nprof, ["column_name"], [0.5], value="d")
                   .select("column_name", F.col("value").alias("f")))
        elif num_method == "mean":
            agg = nprof.groupBy("column_name").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("f"))
        else:
            raise ValueError("num_method must be 'median' or 'mean'")
        fills.update({r["column_name"]: r["f"] for r in agg.collect()})
    # 4. numeric role at cat_th=20 (distinct values after filling), log1p, moments
    filled = {c: float(fills[c]) for c in numbers if c in fills and nulls.get(c, 0) > 0}
    seen = _columns_with_value(prof, filled)
    dist_after = {c: raw_counts.get(c, 0) + (c in filled and c not in seen) for c in numbers}
    scale_cols = [c for c in numbers if dist_after[c] >= S.CAT_TH_SCALE and c in S.BASE_FEATURES]
    means, stds = _moments_from_profile(prof, scale_cols, fills)
    return PrepModel(upper_string_cols=upper_cols, fills=fills, scale_cols=scale_cols,
                     means=means, stds=stds, target=target, key=key, outliers=outliers)


def _columns_with_value(prof: DataFrame, values: dict[str, float]) -> set[str]:
    """The columns whose given value occurs among their rows (one job for all)."""
    if not values:
        return set()
    name = F.col("column_name")
    hits = prof.filter(name.isin(list(values)) & (F.col("d") == P.literal_lookup(name, values)))
    return {r["column_name"] for r in hits.select("column_name").distinct().collect()}


def _moments_from_profile(prof: DataFrame, cols: list[str], fills: dict[str, Any]):
    """Mean and population std of g(x), g = log1p for the listed columns, nulls filled."""
    if not cols:
        return {}, {}
    name = F.col("column_name")
    fill = P.literal_lookup(name, {c: float(fills[c]) for c in cols if c in fills}) if any(
        c in fills for c in cols) else F.lit(None).cast("double")
    x = F.coalesce(F.col("d"), fill)
    logged = name.isin([c for c in cols if c in S.LOG1P_COLUMNS])
    g = F.when(logged, F.log1p(x)).otherwise(x)
    vals = prof.filter(name.isin(cols)).withColumn("g", g).filter(F.col("g").isNotNull())
    m = {r["column_name"]: r["m"] for r in vals.groupBy("column_name")
         .agg((F.sum(F.col("g") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    centred = vals.withColumn("c", F.col("g") - P.literal_lookup(name, m))
    v = {r["column_name"]: r["v"] for r in centred.groupBy("column_name")
         .agg((F.sum(F.col("c") * F.col("c") * F.col("n")) / F.sum("n")).alias("v")).collect()}
    return m, {c: float(v[c]) ** 0.5 for c in cols}


def _outliers_from_profile(prof: DataFrame, cols: list[str]) -> dict[str, bool]:
    if not cols:
        return {}
    sub = prof.filter(F.col("column_name").isin(cols) & F.col("d").isNotNull())
    qs = {(r["column_name"], r["prob"]): r["value"]
          for r in P.quantiles_from_freq(sub, ["column_name"], [0.25, 0.75], value="d").collect()}
    q = sub.groupBy("column_name").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
    out = {}
    for r in q:
        q1, q3 = qs[(r["column_name"], 0.25)], qs[(r["column_name"], 0.75)]
        iqr = q3 - q1
        out[r["column_name"]] = bool(r["hi"] > q3 + 1.5 * iqr or r["lo"] < q1 - 1.5 * iqr)
    return out


def apply_prep(raw: DataFrame, model: PrepModel, keep_target: bool = True) -> DataFrame:
    """Model inputs (key, 31 features[, target]) from raw survey rows -- one projection."""
    df = _stage_encoded_target(raw, model.upper_string_cols, model.target, model.key)
    df = CL.apply_fills(df, model.fills)
    return features_from_encoded(C.encode_labels(df), model, keep_target)


def encoded_fills(model: PrepModel) -> dict[str, Any]:
    """Fill values expressed in encoded form (a string fill mapped through its encoder)."""
    out = {}
    for c, v in model.fills.items():
        out[c] = _encoded_value(c, v) if c in S.ENCODERS else v
    return out


def _encoded_value(col: str, value: Any) -> int:
    return S.ENCODERS[col].get(str(value).upper(), 0)


def features_from_encoded(df: DataFrame, model: PrepModel, keep_target: bool = True) -> DataFrame:
    """Encoded base answers -> model inputs: fills, derived features, log1p, scaling."""
    df = CL.apply_fills(df, {c: v for c, v in encoded_fills(model).items() if c in df.columns})
    df = C.add_derived_features(df)
    df = C.log1p_columns(df, [c for c in S.LOG1P_COLUMNS if c in df.columns])
    scaled = {}
    for c in model.scale_cols:
        std = model.stds.get(c) or 0.0
        scaled[c] = (F.col(c).cast("double") - F.lit(model.means[c])) / F.lit(std if std != 0 else 1.0)
    df = df.withColumns(scaled)
    cols = [model.key, *model.feature_cols]
    if keep_target and model.target in df.columns:
        cols.append(model.target)
    return df.select(*cols)


def prepare(raw: DataFrame, **kw) -> tuple[DataFrame, PrepModel]:
    """fit + apply on the same rows (the study's one-call preparation)."""
    model = fit_prep(raw, **kw)
    return apply_prep(raw, model), model
