"""Driver tables and the survey view built from them.

The survey study reads one CSV of answers.  Our inputs are the TPC-H-like parquet
tables; the survey view derives one answer row per order (orders joined to its
customer) with deterministic arithmetic, so that it grows with the data and both
Spark and the SQL oracle produce identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; parquet scan with pushdown and column pruning."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# rating columns of the view: (name, divisor of the mixing value z)
_RATING_DIVISORS = [
    ("inflight_wifi_service", 1), ("departure_arrival_time_convenient", 13),
    ("ease_of_online_booking", 17), ("gate_location", 19), ("food_and_drink", 23),
    ("online_boarding", 7), ("seat_comfort", 53), ("inflight_entertainment", 29),
    ("on_board_service", 31), ("leg_room_service", 37), ("baggage_handling", 41),
    ("checkin_service", 43), ("inflight_service", 47), ("cleanliness", 59),
]

SURVEY_VIEW_COLUMNS = (
    ["id", "gender", "customer_type", "age", "type_of_travel", "class", "flight_distance"]
    + [n for n, _ in _RATING_DIVISORS]
    + ["departure_delay_in_minutes", "arrival_delay_in_minutes", "satisfaction"]
)


def _div_mod(z: Column, divisor: int, modulus: int) -> Column:
    base = z if divisor == 1 else F.floor(z / F.lit(float(divisor)))
    return (base % modulus).cast("long")


def survey_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey answers: one row per order, 24 columns, lower-case names.

    Only the join orders -> customer shuffles; AQE turns it into a broadcast join at
    runtime when the customer side is measured to be small, and splits skewed
    customer keys otherwise.
    """
    orders = load_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    customer = load_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    z = (F.col("o_custkey") * 7919 + F.col("o_orderkey") * 104729) % 1000003
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner").withColumn("z", z)

    cls = (F.when(F.col("z") % 409 == 0, F.lit(None).cast("string"))
           .when(F.col("o_orderpriority") < "3", "Business")
           .when(F.col("o_orderpriority") < "4", "Eco Plus")
           .otherwise("Eco"))
    base = joined.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(F.col("c_acctbal") >= 1000, "Loyal Customer").otherwise("disloyal Customer")
        .alias("customer_type"),
        (F.lit(7) + F.col("o_custkey") % 79).alias("age"),
        F.when(F.col("o_orderstatus") != "P", "Business travel").otherwise("Personal Travel")
        .alias("type_of_travel"),
        cls.alias("class"),
        (F.lit(31) + F.floor(F.col("o_totalprice") / 100.0)).cast("long").alias("flight_distance"),
        *[_div_mod(F.col("z"), d, 6).alias(n) for n, d in _RATING_DIVISORS],
        _div_mod(F.col("z"), 11, 100).alias("v"),
        F.col("z"),
    )
    dep = (F.when(F.col("v") < 57, F.lit(0).cast("long"))
           .otherwise(F.floor(F.pow((F.col("v") - 56) / 10.0, 4)).cast("long")))
    base = base.withColumn("departure_delay_in_minutes", dep)
    arr = (F.when(F.col("z") % 331 == 0, F.lit(None).cast("long"))
           .otherwise(F.greatest(F.col("departure_delay_in_minutes") + F.col("z") % 15 - 7, F.lit(0))))
    happy_points = (
        F.when(F.col("class") == "Business", 2).otherwise(0)
        + F.when(F.col("type_of_travel") == "Business travel", 1).otherwise(0)
        + F.when(F.col("online_boarding") >= 4, 1).otherwise(0)
        + F.when((F.col("inflight_wifi_service") == 0) | (F.col("inflight_wifi_service") >= 4), 1)
        .otherwise(0)
        + F.when(F.col("z") % 10 == 0, 2).otherwise(0)
    )
    sat = F.when(happy_points >= 3, "satisfied").otherwise("neutral or dissatisfied")
    return base.select(
        *SURVEY_VIEW_COLUMNS[:-2],
        arr.cast("long").alias("arrival_delay_in_minutes"),
        sat.alias("satisfaction"),
    )


# The same view as SQL, for the DuckDB oracle (and readable documentation).
SURVEY_VIEW_SQL = """
WITH z AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, c_acctbal,
         (o_custkey * 7919 + o_orderkey * 104729) % 1000003 AS z
  FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN c_acctbal >= 1000 THEN 'Loyal Customer' ELSE 'disloyal Customer' END AS customer_type,
    7 + o_custkey % 79 AS age,
    CASE WHEN o_orderstatus <> 'P' THEN 'Business travel' ELSE 'Personal Travel' END AS type_of_travel,
    CASE WHEN z % 409 = 0 THEN NULL WHEN o_orderpriority < '3' THEN 'Business'
         WHEN o_orderpriority < '4' THEN 'Eco Plus' ELSE 'Eco' END AS class,
    31 + CAST(floor(o_totalprice / 100.0) AS BIGINT) AS flight_distance,
    z % 6 AS inflight_wifi_service,
    CAST(floor(z / 13.0) AS BIGINT) % 6 AS departure_arrival_time_convenient,
    CAST(floor(z / 17.0) AS BIGINT) % 6 AS ease_of_online_booking,
    CAST(floor(z / 19.0) AS BIGINT) % 6 AS gate_location,
    CAST(floor(z / 23.0) AS BIGINT) % 6 AS food_and_drink,
    CAST(floor(z / 7.0) AS BIGINT) % 6 AS online_boarding,
    CAST(floor(z / 53.0) AS BIGINT) % 6 AS seat_comfort,
    CAST(floor(z / 29.0) AS BIGINT) % 6 AS inflight_entertainment,
    CAST(floor(z / 31.0) AS BIGINT) % 6 AS on_board_service,
    CAST(floor(z / 37.0) AS BIGINT) % 6 AS leg_room_service,
    CAST(floor(z / 41.0) AS BIGINT) % 6 AS baggage_handling,
    CAST(floor(z / 43.0) AS BIGINT) % 6 AS checkin_service,
    CAST(floor(z / 47.0) AS BIGINT) % 6 AS inflight_service,
    CAST(floor(z / 59.0) AS BIGINT) % 6 AS cleanliness,
    CAST(floor(z / 11.0) AS BIGINT) % 100 AS v, z
  FROM z),
d AS (
  SELECT *, CASE WHEN v < 57 THEN 0 ELSE CAST(floor(power((v - 56) / 10.0, 4)) AS BIGINT) END
            AS departure_delay_in_minutes
  FROM b)
SELECT id, gender, customer_type, age, type_of_travel, class, flight_distance,
  inflight_wifi_service, departure_arrival_time_convenient, ease_of_online_booking, gate_location,
  food_and_drink, online_boarding, seat_comfort, inflight_entertainment, on_board_service,
  leg_room_service, baggage_handling, checkin_service, inflight_service, cleanliness,
  departure_delay_in_minutes,
  CASE WHEN z % 331 = 0 THEN NULL
       ELSE greatest(departure_delay_in_minutes + z % 15 - 7, 0) END AS arrival_delay_in_minutes,
  CASE WHEN (CASE WHEN class = 'Business' THEN 2 ELSE 0 END)
          + (CASE WHEN type_of_travel = 'Business travel' THEN 1 ELSE 0 END)
          + (CASE WHEN online_boarding >= 4 THEN 1 ELSE 0 END)
          + (CASE WHEN inflight_wifi_service = 0 OR inflight_wifi_service >= 4 THEN 1 ELSE 0 END)
          + (CASE WHEN z % 10 = 0 THEN 2 ELSE 0 END) >= 3
       THEN 'satisfied' ELSE 'neutral or dissatisfied' END AS satisfaction
FROM d
"""
