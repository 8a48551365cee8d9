"""Oracle SQL (DuckDB dialect) for the registered queries.

Written independently of the Spark code: the encoders and interaction features are
spelled out case by case, the way the survey study assigns them, so a slip in the
Spark expressions shows up as a mismatch.
"""

from __future__ import annotations

import re

from surveylens import schema as S
from surveylens.sources.tables import SURVEY_VIEW_SQL

RATINGS = S.RATINGS
NUM_COLS = ["AGE", "FLIGHT_DISTANCE", "DEPARTURE_DELAY_IN_MINUTES", "ARRIVAL_DELAY_IN_MINUTES"]
CAT_STRINGS = ["GENDER", "CUSTOMER_TYPE", "TYPE_OF_TRAVEL", "CLASS"]
UPPER_COLS = (["ID", "GENDER", "CUSTOMER_TYPE", "AGE", "TYPE_OF_TRAVEL", "CLASS", "FLIGHT_DISTANCE"]
              + RATINGS + ["DEPARTURE_DELAY_IN_MINUTES", "ARRIVAL_DELAY_IN_MINUTES", "SATISFACTION"])
NUMERIC_UPPER = [c for c in UPPER_COLS if c not in CAT_STRINGS + ["SATISFACTION"]]
# numeric columns once ID is dropped and the label is encoded
NUMERIC_NO_ID = ["AGE", "FLIGHT_DISTANCE"] + RATINGS + [
    "DEPARTURE_DELAY_IN_MINUTES", "ARRIVAL_DELAY_IN_MINUTES", "SATISFACTION"]
# categorical role at cat_th=10 (strings + numerics with < 10 values), label excluded
CAT_COLS_10 = CAT_STRINGS + RATINGS


def _ctes(*names: str) -> str:
    """WITH clause holding the requested survey stages (each builds on the previous)."""
    upper = ", ".join(f"{c.lower()} AS {c}" for c in UPPER_COLS)
    t_cols = ", ".join(
        f"upper({c}) AS {c}" if c in CAT_STRINGS else c for c in UPPER_COLS if c != "SATISFACTION")
    e_cols = ", ".join(
        c if c not in CAT_STRINGS else {
            "GENDER": "CAST(CASE WHEN GENDER = 'FEMALE' THEN 1 ELSE 0 END AS BIGINT) AS GENDER",
            "CUSTOMER_TYPE": "CAST(CASE WHEN CUSTOMER_TYPE = 'LOYAL CUSTOMER' THEN 1 ELSE 0 END AS BIGINT) AS CUSTOMER_TYPE",
            "TYPE_OF_TRAVEL": "CAST(CASE WHEN TYPE_OF_TRAVEL = 'BUSINESS TRAVEL' THEN 1 ELSE 0 END AS BIGINT) AS TYPE_OF_TRAVEL",
            "CLASS": "CAST(CASE WHEN CLASS = 'BUSINESS' THEN 2 WHEN CLASS = 'ECO PLUS' THEN 1 ELSE 0 END AS BIGINT) AS CLASS",
        }[c] for c in UPPER_COLS)
    stages = {
        "v": SURVEY_VIEW_SQL,
        "u": f"SELECT {upper} FROM v",
        "t": f"SELECT {t_cols}, CAST(CASE WHEN upper(SATISFACTION) = 'SATISFIED' THEN 1 ELSE 0 END AS BIGINT) AS SATISFACTION FROM u",
        "e": f"SELECT {e_cols} FROM t",
        "d": f"SELECT *, {DERIVED_SQL} FROM e",
    }
    order = ["v", "u", "t", "e", "d"]
    need = max(order.index(n) for n in names)
    return "WITH " + ",\n".join(f"{n} AS ({stages[n]})" for n in order[: need + 1]) + "\n"


DERIVED_SQL = """
CAST(CASE WHEN INFLIGHT_WIFI_SERVICE = 0 THEN 0 ELSE 1 END AS BIGINT) AS WIFI_AVAIBLE,
CAST(CASE WHEN TYPE_OF_TRAVEL = 1 AND CLASS = 2 THEN 5 WHEN TYPE_OF_TRAVEL = 1 AND CLASS = 1 THEN 4
          WHEN TYPE_OF_TRAVEL = 1 AND CLASS = 0 THEN 3 WHEN TYPE_OF_TRAVEL = 0 AND CLASS = 2 THEN 2
          WHEN TYPE_OF_TRAVEL = 0 AND CLASS = 1 THEN 1 WHEN TYPE_OF_TRAVEL = 0 AND CLASS = 0 THEN 0 END AS BIGINT) AS RICH_POOR,
CAST(CASE WHEN GENDER = 0 AND TYPE_OF_TRAVEL = 1 THEN 3 WHEN GENDER = 1 AND TYPE_OF_TRAVEL = 1 THEN 2
          WHEN GENDER = 1 AND TYPE_OF_TRAVEL = 0 THEN 1 WHEN GENDER = 0 AND TYPE_OF_TRAVEL = 0 THEN 0 END AS BIGINT) AS BUSINESS_PERSON,
CAST(CASE WHEN GENDER = 0 AND CUSTOMER_TYPE = 1 THEN 3 WHEN GENDER = 1 AND CUSTOMER_TYPE = 0 THEN 2
          WHEN GENDER = 0 AND CUSTOMER_TYPE = 0 THEN 1 WHEN GENDER = 1 AND CUSTOMER_TYPE = 1 THEN 0 END AS BIGINT) AS IN_LOYAL_GENDER,
CAST(CASE WHEN TYPE_OF_TRAVEL = 1 AND ONLINE_BOARDING = 5 THEN 12 WHEN TYPE_OF_TRAVEL = 0 AND ONLINE_BOARDING = 5 THEN 11
          WHEN TYPE_OF_TRAVEL = 1 AND ONLINE_BOARDING = 4 THEN 10 WHEN TYPE_OF_TRAVEL = 0 AND ONLINE_BOARDING = 4 THEN 9
          WHEN TYPE_OF_TRAVEL = 1 AND ONLINE_BOARDING = 3 THEN 8 WHEN TYPE_OF_TRAVEL = 0 AND ONLINE_BOARDING = 3 THEN 7
          WHEN TYPE_OF_TRAVEL = 1 AND ONLINE_BOARDING = 2 THEN 6 WHEN TYPE_OF_TRAVEL = 0 AND ONLINE_BOARDING = 2 THEN 5
          WHEN TYPE_OF_TRAVEL = 1 AND ONLINE_BOARDING = 1 THEN 4 WHEN TYPE_OF_TRAVEL = 0 AND ONLINE_BOARDING = 1 THEN 3
          WHEN TYPE_OF_TRAVEL = 1 AND ONLINE_BOARDING = 0 THEN 2 WHEN TYPE_OF_TRAVEL = 0 AND ONLINE_BOARDING = 0 THEN 1 END AS BIGINT) AS TYPE_BOARDING,
CAST(CASE WHEN INFLIGHT_WIFI_SERVICE <> 0 AND CLASS = 2 THEN 6 WHEN INFLIGHT_WIFI_SERVICE <> 0 AND CLASS = 1 THEN 5
          WHEN INFLIGHT_WIFI_SERVICE <> 0 AND CLASS = 0 THEN 4 WHEN INFLIGHT_WIFI_SERVICE = 0 AND CLASS = 2 THEN 3
          WHEN INFLIGHT_WIFI_SERVICE = 0 AND CLASS = 1 THEN 2 WHEN INFLIGHT_WIFI_SERVICE = 0 AND CLASS = 0 THEN 1 END AS BIGINT) AS WIFI_CLAS,
CAST(CASE WHEN TYPE_OF_TRAVEL = 1 AND SEAT_COMFORT = 5 THEN 12 WHEN TYPE_OF_TRAVEL = 0 AND SEAT_COMFORT = 5 THEN 11
          WHEN TYPE_OF_TRAVEL = 1 AND SEAT_COMFORT = 4 THEN 10 WHEN TYPE_OF_TRAVEL = 0 AND SEAT_COMFORT = 4 THEN 9
          WHEN TYPE_OF_TRAVEL = 1 AND SEAT_COMFORT = 3 THEN 8 WHEN TYPE_OF_TRAVEL = 0 AND SEAT_COMFORT = 3 THEN 7
          WHEN TYPE_OF_TRAVEL = 1 AND SEAT_COMFORT = 2 THEN 6 WHEN TYPE_OF_TRAVEL = 0 AND SEAT_COMFORT = 2 THEN 5
          WHEN TYPE_OF_TRAVEL = 1 AND SEAT_COMFORT = 1 THEN 4 WHEN TYPE_OF_TRAVEL = 0 AND SEAT_COMFORT = 1 THEN 3
          WHEN TYPE_OF_TRAVEL = 1 AND SEAT_COMFORT = 0 THEN 2 WHEN TYPE_OF_TRAVEL = 0 AND SEAT_COMFORT = 0 THEN 1 END AS BIGINT) AS TYPE_COMFORT,
CAST(CASE WHEN CUSTOMER_TYPE = 1 AND CLASS = 2 THEN 6 WHEN CUSTOMER_TYPE = 1 AND CLASS = 1 THEN 5
          WHEN CUSTOMER_TYPE = 1 AND CLASS = 0 THEN 4 WHEN CUSTOMER_TYPE = 0 AND CLASS = 2 THEN 3
          WHEN CUSTOMER_TYPE = 0 AND CLASS = 1 THEN 2 WHEN CUSTOMER_TYPE = 0 AND CLASS = 0 THEN 1 END AS BIGINT) AS LOY_CLASS,
CAST(CASE WHEN CUSTOMER_TYPE = 1 AND TYPE_OF_TRAVEL = 1 THEN 4 WHEN CUSTOMER_TYPE = 1 AND TYPE_OF_TRAVEL = 0 THEN 3
          WHEN CUSTOMER_TYPE = 0 AND TYPE_OF_TRAVEL = 1 THEN 2 WHEN CUSTOMER_TYPE = 0 AND TYPE_OF_TRAVEL = 0 THEN 1 END AS BIGINT) AS LOY_TRAVEL
"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _num_no_id_select() -> str:
    return "SELECT * EXCLUDE (ID) FROM t"


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}

    q["satisfied_by_travel_class"] = _ctes("d") + """
SELECT TYPE_OF_TRAVEL, CLASS, RICH_POOR, count(*) AS n, round(avg(SATISFACTION), 6) AS satisfied_rate
FROM d GROUP BY TYPE_OF_TRAVEL, CLASS, RICH_POOR"""

    q["table_shape"] = _ctes("u") + f"SELECT count(*) AS n_rows, CAST({len(UPPER_COLS)} AS BIGINT) AS n_cols FROM u"

    q["null_counts"] = _ctes("u") + _union([
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM u"
        for c in UPPER_COLS])

    q["missing_table"] = _ctes("u") + "SELECT column_name, n_miss, round(n_miss * 100.0 / n, 2) AS ratio FROM (" + _union([
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_miss, count(*) AS n FROM u"
        for c in UPPER_COLS]) + ") WHERE n_miss > 0"

    dtype = {c: ("string" if c in CAT_STRINGS + ["SATISFACTION"] else "numeric") for c in UPPER_COLS}
    counts = _union([f"SELECT '{c}' AS column_name, '{dtype[c]}' AS dtype, count(DISTINCT {c}) AS n_distinct FROM u"
                     for c in UPPER_COLS])
    q["column_roles"] = _ctes("u") + f"""
, k AS ({counts}), th AS (SELECT CAST(unnest([4, 10, 20]) AS BIGINT) AS cat_th)
SELECT column_name, dtype, n_distinct, cat_th, CAST(20 AS BIGINT) AS car_th,
  CASE WHEN dtype = 'string' AND n_distinct > 20 THEN 'cat_but_car'
       WHEN dtype = 'string' THEN 'cat'
       WHEN n_distinct < cat_th THEN 'num_but_cat' ELSE 'num' END AS role
FROM k, th"""

    probs = S.CHECK_QUANTILES
    q["quantile_table"] = _ctes("u") + _union([
        f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, round(quantile_cont({c}, {p}), 6) AS value FROM u"
        for c in NUMERIC_UPPER for p in probs])

    dq = S.DESCRIBE_QUANTILES
    q["describe_numeric"] = _ctes("t") + _union([
        f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
        f"round(CAST(max({c}) AS DOUBLE), 6) AS max, "
        + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{int(round(p * 100)):02d}" for p in dq)
        + " FROM t" for c in NUM_COLS])

    vc_cols = CAT_COLS_10 + ["SATISFACTION"]
    q["value_counts_ratio"] = _ctes("t") + "SELECT column_name, value, n, round(n * 100.0 / total, 6) AS ratio FROM (" + _union([
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, "
        f"(SELECT count(*) FROM t) AS total FROM t WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in vc_cols]) + ")"

    q["num_mean_by_target"] = _ctes("t") + _union([
        f"SELECT SATISFACTION, '{c}' AS column_name, round(avg({c}), 6) AS mean FROM t "
        f"WHERE SATISFACTION IS NOT NULL GROUP BY SATISFACTION" for c in NUM_COLS])

    q["target_mean_by_cat"] = _ctes("t") + _union([
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, "
        f"round(avg(SATISFACTION), 6) AS target_mean FROM t WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in CAT_COLS_10])

    q["category_by_target"] = _ctes("t") + _union([
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, SATISFACTION, count(*) AS n "
        f"FROM t WHERE {c} IS NOT NULL GROUP BY {c}, SATISFACTION" for c in CAT_COLS_10])

    def hist(by: bool) -> str:
        parts = []
        for c in NUM_COLS:
            g = "SATISFACTION, " if by else ""
            parts.append(f"""
SELECT {g}'{c}' AS column_name, bin, count(*) AS n, min(lo) AS lo, min(hi) AS hi, min(cnt) AS cnt FROM (
  SELECT {g}CAST(CASE WHEN hi > lo THEN least(floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * 20) + 1, 20) ELSE 1 END AS BIGINT) AS bin,
         lo, hi, cnt
  FROM t, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS cnt FROM t) r
  WHERE {c} IS NOT NULL) GROUP BY {g}bin""")
        g = "SATISFACTION, " if by else ""
        dens = "" if by else ", round(CASE WHEN hi > lo THEN n / (cnt * ((hi - lo) / 20)) END, 6) AS density"
        return (_ctes("t") + f"SELECT {g}column_name, bin, n, round(lo + (bin - 1) * ((hi - lo) / 20), 6) AS lower, "
                f"round(lo + bin * ((hi - lo) / 20), 6) AS upper{dens} FROM (" + _union(parts) + ")")

    q["histogram_20"] = hist(False)
    q["histogram_by_target"] = hist(True)

    q["box_stats"] = _ctes("t") + _union([f"""
SELECT SATISFACTION, '{c}' AS column_name, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(q3 - q1, 6) AS iqr,
  round(CAST(min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS DOUBLE), 6) AS whisker_low,
  round(CAST(max(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS DOUBLE), 6) AS whisker_high,
  CAST(sum(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
  count(*) AS n
FROM (SELECT t.SATISFACTION, CAST({c} AS DOUBLE) AS x, q.q1, q.med, q.q3 FROM t JOIN (
        SELECT SATISFACTION, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
               quantile_cont({c}, 0.75) AS q3 FROM t WHERE {c} IS NOT NULL GROUP BY SATISFACTION) q
      USING (SATISFACTION) WHERE {c} IS NOT NULL)
GROUP BY SATISFACTION, q1, med, q3""" for c in NUM_COLS])

    pairs = [(a, b) for i, a in enumerate(NUMERIC_NO_ID) for b in NUMERIC_NO_ID[:i]]
    q["corr_lower"] = _ctes("t") + _union([
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr, "
        f"round(corr({a}, {b}), 2) AS corr_rounded FROM t" for a, b in pairs])

    def moments(c: str) -> str:
        return (f"(SELECT count(x) AS n, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS g1 "
                f"FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM u WHERE {c} IS NOT NULL))")

    q["skewness_table"] = _ctes("u") + _union([
        f"SELECT '{c}' AS column_name, n, round(g1, 6) AS skew FROM {moments(c)}" for c in S.LOG1P_COLUMNS])

    # two-sided p by Simpson's rule on the normal density, up to 40 standard deviations
    density = "exp(-0.5 * power(abs(z) + i * (40 - abs(z)) / 20000, 2))"
    p = (f"CASE WHEN abs(z) >= 40 THEN 0.0 ELSE 2 * (SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 "
         f"ELSE 2 END * {density}) FROM range(20001) t(i)) * (40 - abs(z)) / 60000 / sqrt(2 * pi()) END")
    q["skew_test"] = _ctes("u") + _union([f"""
SELECT column_name, n, skew, round(z, 6) AS z, round({p}, 6) AS p FROM (
SELECT '{c}' AS column_name, n, round(g1, 6) AS skew,
  CASE WHEN y = 0 THEN 0.0 ELSE delta * ln(y / a + sqrt((y / a) * (y / a) + 1)) END AS z
FROM (SELECT n, g1, y, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS a FROM (
  SELECT n, g1, y, sqrt(2.0 * (b2 - 1)) - 1 AS w2 FROM (
    SELECT n, g1, g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y,
      3.0 * (n * n + 27.0 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b2
    FROM {moments(c)}))))""" for c in S.LOG1P_COLUMNS])

    num_u = NUMERIC_UPPER
    types = {c: ("string" if c in CAT_STRINGS + ["SATISFACTION"] else "bigint") for c in UPPER_COLS}
    q["check_df"] = _ctes("u") + _union(
        [f"SELECT 'shape' AS section, CAST(NULL AS VARCHAR) AS column_name, 'rows' AS statistic, CAST(count(*) AS DOUBLE) AS value FROM u",
         f"SELECT 'shape', NULL, 'columns', CAST({len(UPPER_COLS)} AS DOUBLE)"]
        + [f"SELECT 'types', '{c}', '{types[c]}', CAST(NULL AS DOUBLE)" for c in UPPER_COLS]
        + [f"SELECT 'na', '{c}', 'n_null', CAST(count(*) - count({c}) AS DOUBLE) FROM u" for c in UPPER_COLS]
        + [f"SELECT 'quantiles', '{c}', 'q{p:.2f}', round(quantile_cont({c}, {p}), 6) FROM u"
           for c in num_u for p in probs]
        + [f"SELECT '{part}', '{c}', 'row' || k || ': ' || coalesce(CAST({c} AS VARCHAR), 'NULL'), CAST(NULL AS DOUBLE) "
           f"FROM (SELECT *, row_number() OVER (ORDER BY ID {way}) AS k FROM u ORDER BY ID {way} LIMIT 5)"
           for part, way in (("head", "ASC"), ("tail", "DESC")) for c in UPPER_COLS])

    q["upper_values"] = _ctes("u") + (
        "SELECT ID, upper(GENDER) AS GENDER, upper(CUSTOMER_TYPE) AS CUSTOMER_TYPE, "
        "upper(TYPE_OF_TRAVEL) AS TYPE_OF_TRAVEL, upper(CLASS) AS CLASS, upper(SATISFACTION) AS SATISFACTION FROM u")

    q["encode_labels"] = _ctes("e") + "SELECT ID, GENDER, CUSTOMER_TYPE, TYPE_OF_TRAVEL, CLASS, SATISFACTION FROM e"

    q["interaction_features"] = _ctes("d") + "SELECT ID, " + ", ".join(S.DERIVED_FEATURES) + " FROM d"
    q.update(cleaning_queries())
    q.update(model_queries())
    return q


# ------------------------------------------------------- cleaning and prep ----

ENCODE_SQL = """SELECT * REPLACE (
  CAST(CASE WHEN GENDER = 'FEMALE' THEN 1 ELSE 0 END AS BIGINT) AS GENDER,
  CAST(CASE WHEN CUSTOMER_TYPE = 'LOYAL CUSTOMER' THEN 1 ELSE 0 END AS BIGINT) AS CUSTOMER_TYPE,
  CAST(CASE WHEN TYPE_OF_TRAVEL = 'BUSINESS TRAVEL' THEN 1 ELSE 0 END AS BIGINT) AS TYPE_OF_TRAVEL,
  CAST(CASE WHEN CLASS = 'BUSINESS' THEN 2 WHEN CLASS = 'ECO PLUS' THEN 1 ELSE 0 END AS BIGINT) AS CLASS)
FROM {src}"""

# the same for requests, where an answer that was not given stays null
ENCODE_NULLS_SQL = re.sub(r"CASE WHEN (\w+) =", r"CASE WHEN \1 IS NULL THEN NULL WHEN \1 =", ENCODE_SQL)

SCALE_COLS = ["AGE", "FLIGHT_DISTANCE", "DEPARTURE_DELAY_IN_MINUTES", "ARRIVAL_DELAY_IN_MINUTES"]
FEATURE_ORDER = S.FEATURES


def md5_bucket_sql(key: str, seed: int, buckets: int) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % {buckets})"


def md5_hash_sql(key: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"


def _prep_ctes(fit_where: str = "TRUE", apply_where: str = "TRUE") -> str:
    """CTEs ending in ``p``: prepared rows of ``apply_where`` with statistics of ``fit_where``."""
    def chain(side: str, where: str) -> str:
        return f""",
{side}_r AS (SELECT * FROM t WHERE {where}),
{side}_i AS (SELECT * REPLACE (coalesce(CLASS, f.class_fill) AS CLASS,
                 coalesce(CAST(ARRIVAL_DELAY_IN_MINUTES AS DOUBLE), f.arr_fill) AS ARRIVAL_DELAY_IN_MINUTES)
             FROM {side}_r, f),
{side}_e AS ({ENCODE_SQL.format(src=side + '_i')}),
{side}_d AS (SELECT *, {DERIVED_SQL} FROM {side}_e),
{side}_l AS (SELECT * REPLACE (ln(1 + FLIGHT_DISTANCE) AS FLIGHT_DISTANCE,
                 ln(1 + DEPARTURE_DELAY_IN_MINUTES) AS DEPARTURE_DELAY_IN_MINUTES,
                 ln(1 + ARRIVAL_DELAY_IN_MINUTES) AS ARRIVAL_DELAY_IN_MINUTES) FROM {side}_d)"""
    fill = f""",
fr AS (SELECT * FROM t WHERE {fit_where}),
f AS (SELECT (SELECT CLASS FROM fr WHERE CLASS IS NOT NULL GROUP BY CLASS ORDER BY count(*) DESC, CLASS LIMIT 1) AS class_fill,
             (SELECT quantile_cont(ARRIVAL_DELAY_IN_MINUTES, 0.5) FROM fr) AS arr_fill)"""
    stats = ", ".join(f"avg({c}) AS m_{i}, stddev_pop({c}) AS s_{i}" for i, c in enumerate(SCALE_COLS))
    scaled = {c: f"({c} - m_{i}) / (CASE WHEN s_{i} = 0 THEN 1 ELSE s_{i} END)" for i, c in enumerate(SCALE_COLS)}
    cols = ", ".join(f"{scaled[c]} AS {c}" if c in scaled else c for c in FEATURE_ORDER)
    return (_ctes("t") + fill + chain("fit", fit_where) + chain("app", apply_where)
            + f""",
st AS (SELECT {stats} FROM fit_l),
p AS (SELECT ID, {cols}, SATISFACTION FROM app_l, st)
""")


def _round_all(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)


def cleaning_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["outlier_thresholds"] = _ctes("t") + _union([f"""
SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q1 - 1.5 * (q3 - q1), 6) AS low_limit, round(q3 + 1.5 * (q3 - q1), 6) AS up_limit
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t)""" for c in NUM_COLS])

    q["outlier_flags"] = _ctes("t") + _union([f"""
SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {c} > up OR {c} < lo THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
       round(min(lo), 6) AS low_limit, round(min(up), 6) AS up_limit,
       sum(CASE WHEN {c} > up OR {c} < lo THEN 1 ELSE 0 END) > 0 AS has_outlier
FROM t, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS up
         FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t))""" for c in NUM_COLS])

    q["outlier_rows"] = """
SELECT event_id, event_type, round(value, 6) AS value
FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q
WHERE value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1)"""

    def impute(method: str) -> str:
        fill = ("quantile_cont(ARRIVAL_DELAY_IN_MINUTES, 0.5)" if method == "median"
                else "avg(ARRIVAL_DELAY_IN_MINUTES)")
        cols = ", ".join(
            "coalesce(CLASS, (SELECT CLASS FROM u WHERE CLASS IS NOT NULL GROUP BY CLASS ORDER BY count(*) DESC, CLASS LIMIT 1)) AS CLASS"
            if c == "CLASS" else
            f"round(coalesce(CAST(ARRIVAL_DELAY_IN_MINUTES AS DOUBLE), (SELECT {fill} FROM u)), 6) AS ARRIVAL_DELAY_IN_MINUTES"
            if c == "ARRIVAL_DELAY_IN_MINUTES" else c for c in UPPER_COLS)
        return _ctes("u") + f"SELECT {cols} FROM u"

    q["impute_median"] = impute("median")
    q["impute_mean"] = impute("mean")

    q["log1p_transform"] = _ctes("u") + """
SELECT ID, round(ln(1 + FLIGHT_DISTANCE), 6) AS FLIGHT_DISTANCE,
       round(ln(1 + DEPARTURE_DELAY_IN_MINUTES), 6) AS DEPARTURE_DELAY_IN_MINUTES,
       round(ln(1 + coalesce(CAST(ARRIVAL_DELAY_IN_MINUTES AS DOUBLE),
                             (SELECT quantile_cont(ARRIVAL_DELAY_IN_MINUTES, 0.5) FROM u))), 6) AS ARRIVAL_DELAY_IN_MINUTES
FROM u"""

    out_cols = ["ID", *FEATURE_ORDER, "SATISFACTION"]
    q["prep_full"] = _prep_ctes() + f"SELECT {_round_all(out_cols, set(SCALE_COLS))} FROM p"
    q["standardize"] = _prep_ctes() + f"SELECT ID, {_round_all(SCALE_COLS, set(SCALE_COLS))} FROM p"
    train = f"{md5_bucket_sql('ID', S.SPLIT_SEED, 100)} < 60"
    q["prep_apply_holdout"] = (_prep_ctes(train, f"NOT ({train})")
                               + f"SELECT {_round_all(out_cols, set(SCALE_COLS))} FROM p")

    q["split_60_40"] = _ctes("t") + f"""
SELECT CASE WHEN {train} THEN 'train' ELSE 'test' END AS part, count(*) AS n_rows,
       CAST(sum(SATISFACTION) AS BIGINT) AS n_satisfied
FROM t GROUP BY 1"""
    q["fold_sizes"] = _ctes("t") + f"""
SELECT CAST({md5_bucket_sql('ID', S.MODEL_SEED, S.COMPARISON_FOLDS)} AS INTEGER) AS fold, count(*) AS n_rows,
       CAST(sum(SATISFACTION) AS BIGINT) AS n_satisfied
FROM t WHERE {train} GROUP BY 1"""
    def rank(seed: int, by: str = "") -> str:
        digest = f"CAST(('0x' || substr(md5('{seed}:' || CAST(ID AS VARCHAR)), 1, 15)) AS BIGINT)"
        return f"row_number() OVER ({by} ORDER BY {digest}, ID) - 1"

    q["exact_split"] = _ctes("t") + f"""
SELECT ID, CASE WHEN {rank(S.SPLIT_SEED)} < floor((SELECT count(*) FROM t) * 6 / 10) THEN 'train' ELSE 'test' END AS part
FROM t"""
    q["stratified_folds"] = _ctes("t") + f"""
SELECT ID, SATISFACTION, CAST({rank(S.MODEL_SEED, 'PARTITION BY SATISFACTION')} AS INTEGER) % {S.COMPARISON_FOLDS} AS fold
FROM t"""
    h = md5_hash_sql("ID", S.MODEL_SEED)
    q["sample_one"] = _ctes("u") + f"SELECT * FROM u ORDER BY {h}, ID LIMIT 1"
    q["lookup_row"] = _ctes("u") + f"SELECT * FROM u WHERE ID IN (SELECT ID FROM u ORDER BY {h}, ID LIMIT 1)"
    q["head_tail"] = _ctes("u") + """
(SELECT *, 'head' AS position FROM u ORDER BY ID LIMIT 5)
UNION ALL
(SELECT *, 'tail' AS position FROM u ORDER BY ID DESC LIMIT 5)"""
    q["read_csv_roundtrip"] = _ctes("u") + (
        "SELECT * REPLACE (CAST(ARRIVAL_DELAY_IN_MINUTES AS DOUBLE) AS ARRIVAL_DELAY_IN_MINUTES) FROM u")
    return q


# ----------------------------------------------------- metrics and scoring ----

def _closed_form_sql() -> str:
    s = ("(2 * ONLINE_BOARDING + INFLIGHT_WIFI_SERVICE + CASE WHEN CLASS = 2 THEN 3 ELSE 0 END "
         "+ 2 * TYPE_OF_TRAVEL)")
    return (_ctes("d") + f""", sc AS (
  SELECT CAST(SATISFACTION AS INTEGER) AS label, CASE WHEN {s} >= 10 THEN 1 ELSE 0 END AS prediction,
         {s} / 20.0 AS score FROM d),
cm AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
              count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
              count(*) AS n, CAST(sum(label) AS DOUBLE) AS sum_y,
              sum(CAST((label - prediction) * (label - prediction) AS DOUBLE)) AS sse FROM sc)
""")


# stump ensemble written out as SQL (same fixed values as the Spark constant)
FIXED_ENSEMBLE_SQL = """(CAST(1.2 AS DOUBLE) * CASE WHEN CLASS <= 1.5 THEN -1 ELSE 1 END
 + CAST(0.8 AS DOUBLE) * CASE WHEN TYPE_BOARDING <= 9.5 THEN -1 ELSE 1 END
 + CAST(0.5 AS DOUBLE) * CASE WHEN INFLIGHT_WIFI_SERVICE <= 3.5 THEN -1 ELSE 1 END
 + CAST(0.3 AS DOUBLE) * CASE WHEN FLIGHT_DISTANCE <= 0.25 THEN 1 ELSE -1 END)"""


def _violations_sql() -> str:
    parts = ", ".join(f"CASE WHEN {c} IS NULL OR {c} < {lo} OR {c} > {hi} THEN '{c}' END"
                      for c, (lo, hi) in S.REQUEST_RANGES.items())
    return f"concat_ws(',', {parts})"


def _scored_requests_sql() -> str:
    """Requests = encoded base answers; scaled with statistics fitted on the training part."""
    train = f"{md5_bucket_sql('ID', S.SPLIT_SEED, 100)} < 60"
    scaled = {c: f"(CAST({c} AS DOUBLE) - m_{i}) / (CASE WHEN s_{i} = 0 THEN 1 ELSE s_{i} END)"
              for i, c in enumerate(SCALE_COLS)}
    base = ", ".join(["ID", *S.BASE_FEATURES])
    return (_prep_ctes(train, "TRUE") + f""",
e AS ({ENCODE_NULLS_SQL.format(src="t")}),
rq AS (SELECT {base}, {_violations_sql()} AS violations FROM e),
rd AS (SELECT *, {DERIVED_SQL} FROM rq),
rl AS (SELECT * REPLACE (ln(1 + FLIGHT_DISTANCE) AS FLIGHT_DISTANCE,
          ln(1 + DEPARTURE_DELAY_IN_MINUTES) AS DEPARTURE_DELAY_IN_MINUTES,
          ln(1 + ARRIVAL_DELAY_IN_MINUTES) AS ARRIVAL_DELAY_IN_MINUTES) FROM rd),
rs AS (SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in scaled.items())}) FROM rl, st),
dec AS (SELECT ID, violations, CASE WHEN violations = '' THEN {FIXED_ENSEMBLE_SQL} END AS decision FROM rs)
SELECT ID, round(decision, 6) AS decision, CASE WHEN decision > 0 THEN 1 WHEN decision IS NOT NULL THEN 0 END AS prediction,
       CASE WHEN decision > 0 THEN 'satisfied customer' WHEN decision IS NOT NULL THEN 'unsatisfied customer' END AS outcome,
       violations
FROM dec""")


def _rounds_sql(rounds: int, real: bool = False) -> str:
    """CTEs ending in ``fitted``: the first boosting rounds on the training part, by brute force
    over every split of every feature; ``real``: leaves with half the log odds of class 1."""
    odds = [f"0.5 * (ln(greatest({a}, 0.0) / ({a} + {b})) - ln(greatest({b}, 0.0) / ({a} + {b})))"
            for a, b in (("l1", "l0"), ("x1", "x0"))]
    train = f"{md5_bucket_sql('ID', S.SPLIT_SEED, 100)} < 60"
    feats = S.FEATURES
    cast_cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in feats)
    fidx = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(feats))
    value = "CASE b.feature " + " ".join(f"WHEN '{c}' THEN r.{c}" for c in feats) + " END"
    out = _prep_ctes(train, train) + f""",
r1 AS (SELECT {cast_cols}, SATISFACTION, CAST(1 AS DOUBLE) AS w FROM p)"""
    for k in range(1, rounds + 1):
        out += f""",
u{k} AS (UNPIVOT (SELECT * FROM r{k}) ON {', '.join(feats)} INTO NAME feature VALUE value),
g{k} AS (SELECT feature, value, sum(w * SATISFACTION) AS c1, sum(w * (1 - SATISFACTION)) AS c0
         FROM u{k} GROUP BY feature, value),
c{k} AS (SELECT feature, value, lead(value) OVER o AS nxt,
           sum(c1) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l1,
           sum(c0) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l0,
           sum(c1) OVER (PARTITION BY feature) AS t1, sum(c0) OVER (PARTITION BY feature) AS t0
         FROM g{k} WINDOW o AS (PARTITION BY feature ORDER BY value)),
s{k} AS (SELECT feature, (value + nxt) / 2 AS threshold, l1, l0, t1 - l1 AS x1, t0 - l0 AS x0,
           round(((l1 * l1 + l0 * l0) / (l1 + l0) + ((t1 - l1) * (t1 - l1) + (t0 - l0) * (t0 - l0))
             / ((t1 - l1) + (t0 - l0))) / (t1 + t0), 12) AS score, CASE feature {fidx} END AS fi
         FROM c{k} WHERE nxt IS NOT NULL),
b{k} AS (SELECT *, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS lc, CASE WHEN x1 > x0 THEN 1 ELSE 0 END AS rc,
           (least(l1, l0) + least(x1, x0)) / (l1 + l0 + x1 + x0) AS err
         FROM s{k} ORDER BY score DESC, fi, threshold LIMIT 1),
a{k} AS (SELECT *, ln((1 - err) / err) AS alpha, {odds[0]} AS lo, {odds[1]} AS ro FROM b{k}),"""
        change = "(1 - 2 * r.SATISFACTION) * CASE WHEN {v} <= b.threshold THEN b.lo ELSE b.ro END" if real else \
            "CASE WHEN (CASE WHEN {v} <= b.threshold THEN b.lc ELSE b.rc END) <> r.SATISFACTION THEN b.alpha ELSE 0 END"
        out += f"""
r{k + 1} AS (SELECT r.* REPLACE (r.w * exp({change.format(v=value)}) AS w) FROM r{k} r, a{k} b)"""
    return out + ",\nfitted AS (" + " UNION ALL ".join(
        f"SELECT {k} AS round, feature, threshold, lc, rc, err, alpha, lo, ro FROM a{k}" for k in range(1, rounds + 1)) + ")"


def _tree_sql(depth: int) -> str:
    """The nodes of a Gini tree on the training part, by brute force over every split."""
    train = f"{md5_bucket_sql('ID', S.SPLIT_SEED, 100)} < 60"
    feats = S.FEATURES
    cast_cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in feats)
    fidx = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(feats))
    value = "CASE b.feature " + " ".join(f"WHEN '{c}' THEN r.{c}" for c in feats) + " END"
    out = _prep_ctes(train, train) + f""",
r1 AS (SELECT {cast_cols}, SATISFACTION, CAST(1 AS BIGINT) AS node FROM p)"""
    for k in range(1, depth + 1):
        out += f""",
n{k} AS (SELECT node, count(*) AS n, avg(SATISFACTION) AS share FROM r{k} GROUP BY node),
u{k} AS (UNPIVOT (SELECT * FROM r{k}) ON {', '.join(feats)} INTO NAME feature VALUE value),
g{k} AS (SELECT node, feature, value, CAST(sum(SATISFACTION) AS DOUBLE) AS c1,
           CAST(sum(1 - SATISFACTION) AS DOUBLE) AS c0 FROM u{k} GROUP BY node, feature, value),
c{k} AS (SELECT node, feature, value, lead(value) OVER o AS nxt,
           sum(c1) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l1,
           sum(c0) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l0,
           sum(c1) OVER (PARTITION BY node, feature) AS t1, sum(c0) OVER (PARTITION BY node, feature) AS t0
         FROM g{k} WINDOW o AS (PARTITION BY node, feature ORDER BY value)),
s{k} AS (SELECT node, feature, value AS cut, CASE feature {fidx} END AS fi,
           (l1 * l1 + l0 * l0) / (l1 + l0) + ((t1 - l1) * (t1 - l1) + (t0 - l0) * (t0 - l0))
             / ((t1 - l1) + (t0 - l0)) AS score
         FROM c{k} WHERE nxt IS NOT NULL AND t1 > 0 AND t0 > 0),
b{k} AS (SELECT * FROM s{k} QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, fi, cut) = 1),
r{k + 1} AS (SELECT r.* REPLACE (2 * r.node + CASE WHEN {value} <= b.cut THEN 0 ELSE 1 END AS node)
             FROM r{k} r JOIN b{k} b ON r.node = b.node)"""
    out += f""",
n{depth + 1} AS (SELECT node, count(*) AS n, avg(SATISFACTION) AS share FROM r{depth + 1} GROUP BY node)
"""
    levels = [f"SELECT n.node, b.feature, b.cut, n.n, n.share FROM n{k} n LEFT JOIN b{k} b ON n.node = b.node"
              for k in range(1, depth + 1)] + [f"SELECT node, NULL, NULL, n, share FROM n{depth + 1}"]
    return out + f"SELECT node, feature, round(cut, 6) AS cut, n, round(share, 6) AS share FROM ({' UNION ALL '.join(levels)})"


def model_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    cf = _closed_form_sql()
    q["confusion_matrix"] = cf + """
SELECT CAST(1 AS BIGINT) AS actual, CAST(1 AS BIGINT) AS predicted, tp AS n FROM cm UNION ALL
SELECT 0, 1, fp FROM cm UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 0, 0, tn FROM cm"""
    q["binary_metrics"] = cf + """
SELECT n, round((tp + tn) / n, 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(1 - sse / (sum_y - sum_y * sum_y / n), 6) AS r2
FROM cm"""
    q["r2_on_labels"] = cf + "SELECT n, round(sse, 6) AS sse, round(1 - sse / (sum_y - sum_y * sum_y / n), 6) AS r2 FROM cm"
    q["classification_report"] = cf + """, k AS (
  SELECT coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
         coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
         CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0, CAST(n AS DOUBLE) AS n,
         (tp + tn) / n AS acc FROM cm),
f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0 FROM k)
SELECT '0' AS row, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
                 round((f0 * s0 + f1 * s1) / n, 6), CAST(n AS BIGINT) FROM f"""
    q["roc_auc"] = cf + """, g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM sc GROUP BY score),
r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM r"""

    q["stump_ensemble_score"] = _prep_ctes() + f""", dec AS (SELECT ID, {FIXED_ENSEMBLE_SQL} AS decision FROM p)
SELECT ID, round(decision, 6) AS decision, CAST(CASE WHEN decision > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM dec"""

    train = f"{md5_bucket_sql('ID', S.SPLIT_SEED, 100)} < 60"
    feats = S.FEATURES
    cast_cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in feats)
    fidx = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(feats))
    q["adaboost_round1"] = _prep_ctes(train, train) + f""",
pl AS (UNPIVOT (SELECT {cast_cols}, SATISFACTION FROM p) ON {', '.join(feats)} INTO NAME feature VALUE value),
g AS (SELECT feature, value, CAST(sum(SATISFACTION) AS DOUBLE) AS c1,
             CAST(count(*) - sum(SATISFACTION) AS DOUBLE) AS c0 FROM pl GROUP BY feature, value),
c AS (SELECT feature, value, lead(value) OVER w AS nxt,
             sum(c1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l1,
             sum(c0) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l0,
             sum(c1) OVER (PARTITION BY feature) AS t1, sum(c0) OVER (PARTITION BY feature) AS t0
      FROM g WINDOW w AS (PARTITION BY feature ORDER BY value)),
s AS (SELECT feature, (value + nxt) / 2 AS threshold, l1, l0, t1 - l1 AS r1, t0 - l0 AS r0,
             round(((l1 * l1 + l0 * l0) / (l1 + l0) + ((t1 - l1) * (t1 - l1) + (t0 - l0) * (t0 - l0)) / ((t1 - l1) + (t0 - l0)))
                   / (t1 + t0), 12) AS score,
             CASE feature {fidx} END AS fi
      FROM c WHERE nxt IS NOT NULL),
b AS (SELECT *, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS lc, CASE WHEN r1 > r0 THEN 1 ELSE 0 END AS rc
      FROM s ORDER BY score DESC, fi, threshold LIMIT 1),
e2 AS (SELECT *, ((CASE WHEN lc = 1 THEN l0 ELSE l1 END) + (CASE WHEN rc = 1 THEN r0 ELSE r1 END)) / (l1 + l0 + r1 + r0) AS err FROM b)
SELECT feature, round(threshold, 6) AS threshold, CAST(lc AS INTEGER) AS left_class, CAST(rc AS INTEGER) AS right_class,
       round(err, 6) AS error, round(ln((1 - err) / err), 6) AS alpha FROM e2"""

    q["adaboost_round3"] = _rounds_sql(3) + """
SELECT round, feature, round(threshold, 6) AS threshold, CAST(lc AS INTEGER) AS left_class,
       CAST(rc AS INTEGER) AS right_class, round(err, 6) AS error, round(alpha, 6) AS alpha FROM fitted"""
    q["adaboost_real_round3"] = _rounds_sql(3, real=True) + """
SELECT round, feature, round(threshold, 6) AS threshold, round(lo, 6) AS left_odds, round(ro, 6) AS right_odds,
       round(err, 6) AS error FROM fitted"""
    q["cart_depth3"] = _tree_sql(3)
    value = "CASE f.feature " + " ".join(f"WHEN '{c}' THEN CAST(p.{c} AS DOUBLE)" for c in feats) + " END"
    q["pipeline_model_predict"] = _rounds_sql(3) + f""",
scored AS (SELECT ID, sum(alpha * (2 * CASE WHEN {value} <= threshold THEN lc ELSE rc END - 1)) AS decision
           FROM p, fitted f GROUP BY ID)
SELECT ID, round(decision, 6) AS decision, CAST(CASE WHEN decision > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM scored"""
    q["importance_round3"] = _rounds_sql(3) + """
SELECT feature, round(sum(alpha) / (SELECT sum(alpha) FROM fitted), 6) AS importance FROM fitted GROUP BY feature"""
    nv = " + ".join(f"(CASE WHEN {c} IS NULL OR {c} < {lo} OR {c} > {hi} THEN 1 ELSE 0 END)"
                    for c, (lo, hi) in S.REQUEST_RANGES.items())
    q["validate_ranges"] = _ctes("t") + f"""
SELECT ID, {_violations_sql()} AS violations, CAST({nv} AS BIGINT) AS n_violations
FROM ({ENCODE_NULLS_SQL.format(src="t")}) WHERE {nv} > 0"""
    q["batch_predict"] = q["stump_ensemble_score"]
    q["score_requests"] = _scored_requests_sql()
    q["score_stream"] = _scored_requests_sql()
    return q
