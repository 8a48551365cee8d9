"""Column-level functions: names, label encoders and the interaction features.

All of these are plain ``Column`` expressions, so a whole chain of them compiles to
one projection inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveylens import schema as S

# --------------------------------------------------------------------------
# Code tables of the interaction features whose codes are not
# a simple arithmetic rule.  Keys are (first input, second input).
# --------------------------------------------------------------------------
BUSINESS_PERSON_CODES = {(0, 1): 3, (1, 1): 2, (1, 0): 1, (0, 0): 0}   # (GENDER, TYPE_OF_TRAVEL)
IN_LOYAL_GENDER_CODES = {(0, 1): 3, (1, 0): 2, (0, 0): 1, (1, 1): 0}   # (GENDER, CUSTOMER_TYPE)


# ---------------------------------------------------------------- names ----

def upper_names(df: DataFrame) -> DataFrame:
    """Upper-case every column name (a rename: no data moves)."""
    return df.toDF(*[c.upper() for c in df.columns])


def normalised_name(name: str) -> str:
    for sep in S.NAME_SEPARATORS:
        name = name.replace(sep, "_")
    return name


def normalise_names(df: DataFrame) -> DataFrame:
    """Replace space, '-' and '/' in column names by '_'."""
    return df.toDF(*[normalised_name(c) for c in df.columns])


def drop_ids(df: DataFrame, keep_key: str | None = None) -> DataFrame:
    """Drop the row-number and key columns (optionally keep the key aside)."""
    drop = [c for c in df.columns
            if normalised_name(c.upper()) in S.ID_COLUMNS and c != keep_key]
    return df.drop(*drop)


# ------------------------------------------------------------- encoders ----

def encode(col: str | Column, codes: dict[str, int]) -> Column:
    """Map fixed strings to codes; anything else (including null) becomes 0."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for value, code in codes.items():
        expr = F.when(c == value, code) if expr is None else expr.when(c == value, code)
    return expr.otherwise(0).cast("long")


def encode_target(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    return df.withColumn(target, encode(target, S.TARGET_CODES))


def encode_labels(df: DataFrame) -> DataFrame:
    """Encode GENDER, CUSTOMER_TYPE, TYPE_OF_TRAVEL and CLASS in one projection."""
    return df.withColumns({c: encode(c, codes) for c, codes in S.ENCODERS.items() if c in df.columns})


def upper_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.upper(F.col(c)) for c in columns})


# ------------------------------------------------------ derived features ----

def _pair_code(a: Column, b: Column, a_values, b_values, rule) -> Column:
    """Code for each (a, b) combination; combinations outside the domain stay null."""
    expr = None
    for x in a_values:
        for y in b_values:
            cond = (a == x) & (b == y)
            val = F.lit(rule(x, y))
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.cast("long")


def derived_feature_columns() -> dict[str, Column]:
    """The nine interaction features as expressions over encoded columns.

    A combination that is not listed leaves the value null, as a masked assignment
    would.  They are built in dependency order (WIFI_CLAS uses WIFI_AVAIBLE, which
    is inlined here so that everything stays one projection).
    """
    g, loyal = F.col("GENDER"), F.col("CUSTOMER_TYPE")
    travel, cls = F.col("TYPE_OF_TRAVEL"), F.col("CLASS")
    wifi_avaible = F.when(F.col("INFLIGHT_WIFI_SERVICE") == 0, 0).otherwise(1).cast("long")
    ratings = range(6)
    return {
        "WIFI_AVAIBLE": wifi_avaible,
        "RICH_POOR": _pair_code(travel, cls, (0, 1), (0, 1, 2), lambda t, c: 3 * t + c),
        "BUSINESS_PERSON": _pair_code(g, travel, (0, 1), (0, 1),
                                      lambda x, y: BUSINESS_PERSON_CODES[(x, y)]),
        "IN_LOYAL_GENDER": _pair_code(g, loyal, (0, 1), (0, 1),
                                      lambda x, y: IN_LOYAL_GENDER_CODES[(x, y)]),
        "TYPE_BOARDING": _pair_code(F.col("ONLINE_BOARDING"), travel, ratings, (0, 1),
                                    lambda r, t: 2 * r + t + 1),
        "WIFI_CLAS": _pair_code(wifi_avaible, cls, (0, 1), (0, 1, 2), lambda w, c: 3 * w + c + 1),
        "TYPE_COMFORT": _pair_code(F.col("SEAT_COMFORT"), travel, ratings, (0, 1),
                                   lambda r, t: 2 * r + t + 1),
        "LOY_CLASS": _pair_code(loyal, cls, (0, 1), (0, 1, 2), lambda l, c: 3 * l + c + 1),
        "LOY_TRAVEL": _pair_code(loyal, travel, (0, 1), (0, 1), lambda l, t: 2 * l + t + 1),
    }


def add_derived_features(df: DataFrame) -> DataFrame:
    return df.withColumns(derived_feature_columns())


def log1p_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in columns if c in df.columns})


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (stable value comparison across engines)."""
    return df.withColumns({f.name: F.round(F.col(f.name), places)
                           for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """Deterministic bucket in [0, buckets) from md5(seed:key).

    Stable under repartitioning and executor loss (unlike ``rand``), and reproducible
    in any SQL engine that has md5.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("long")
