"""Survey schema, feature lists, encoders and ranges.

Everything under "Fixed values" must equal the survey study's own choices for the
results to match; it is stated here once, plainly, in its natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

TARGET = "SATISFACTION"
ID_COLUMNS = ["UNNAMED:_0", "ID"]  # row number and key, dropped before modelling

# label encoders: value (after upper-casing) -> code; anything else -> 0
TARGET_CODES = {"SATISFIED": 1}
GENDER_CODES = {"FEMALE": 1}
CUSTOMER_TYPE_CODES = {"LOYAL CUSTOMER": 1}
TYPE_OF_TRAVEL_CODES = {"BUSINESS TRAVEL": 1}
CLASS_CODES = {"BUSINESS": 2, "ECO PLUS": 1}

ENCODERS = {
    "GENDER": GENDER_CODES,
    "CUSTOMER_TYPE": CUSTOMER_TYPE_CODES,
    "TYPE_OF_TRAVEL": TYPE_OF_TRAVEL_CODES,
    "CLASS": CLASS_CODES,
}

# characters replaced by "_" in column names
NAME_SEPARATORS = [" ", "-", "/"]

# role thresholds used by the preparation chain
CAT_TH_UPPER = 4      # roles used to pick the string columns to upper-case
CAT_TH_OUTLIER = 10   # roles used for the outlier report
CAT_TH_SCALE = 20     # roles used to pick the columns to standardise
CAR_TH = 20           # strings with more distinct values are cardinal
CAT_LENGTH = 20       # imputation guard for strings (distinct incl. null <= 20)

# columns log1p-transformed before scaling
LOG1P_COLUMNS = ["FLIGHT_DISTANCE", "DEPARTURE_DELAY_IN_MINUTES", "ARRIVAL_DELAY_IN_MINUTES"]

# quantiles of the check_df report and of describe()
CHECK_QUANTILES = [0.0, 0.05, 0.50, 0.95, 0.99, 1.0]
DESCRIBE_QUANTILES = [0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99]

# split, folds and model seeds
SPLIT_TEST_FRACTION = 0.4
SPLIT_SEED = 46
MODEL_SEED = 17

# AdaBoost grid of the training job
ADABOOST_GRID = {"n_estimators": [250, 300, 400], "learning_rate": [0.01, 0.1, 1.0]}
ADABOOST_DEFAULTS = {"n_estimators": 50, "learning_rate": 1.0}
ADABOOST_GRID_FOLDS = 10

# grids of the comparison before and after tuning, and of the single models with their folds
COMPARISON_GRIDS = {
    "KNN": {"n_neighbors": list(range(2, 50))},
    "CART": {"max_depth": list(range(1, 20)), "min_samples_split": list(range(2, 30))},
    "RF": {"max_depth": [8, 15, None], "max_features": [5, 7, "sqrt"], "min_samples_split": [15, 20],
           "n_estimators": [200, 300, 500, 700]},
    "XGBoost": {"learning_rate": [0.1, 0.01], "max_depth": [5, 8, 10], "n_estimators": [100, 200, 300, 400]},
    "LightGBM": {"learning_rate": [0.01, 0.1], "n_estimators": [300, 500, 700, 900]},
}
MODEL_GRIDS = {
    "Adaboost": (ADABOOST_GRID, 10),
    "XGBoost": ({"learning_rate": [0.1, 0.01], "max_depth": [2, 8], "n_estimators": [100, 200]}, 10),
    "LR": ({"max_iter": [200, 250, 300]}, 10),
    "CatBoost": ({"iterations": [400, 500, 600], "learning_rate": [0.1, 0.5, 1.0], "depth": [4, 6, 8]}, 10),
    "RF": ({"max_depth": [5, 8, None], "max_features": [3, 5, 7, "auto"], "min_samples_split": [2, 5, 8, 15, 20],
            "n_estimators": [100, 200, 400]}, 5),
    "LightGBM": ({"learning_rate": [0.01, 0.1], "n_estimators": [300, 500, 700, 900]}, 10),
}

# scores of the model comparison
COMPARISON_METRICS = ["roc_auc", "f1", "precision", "recall", "accuracy"]
COMPARISON_FOLDS = 5

# --------------------------------------------------------------------------
# Column lists
# --------------------------------------------------------------------------

RATINGS = [
    "INFLIGHT_WIFI_SERVICE", "DEPARTURE_ARRIVAL_TIME_CONVENIENT", "EASE_OF_ONLINE_BOOKING",
    "GATE_LOCATION", "FOOD_AND_DRINK", "ONLINE_BOARDING", "SEAT_COMFORT",
    "INFLIGHT_ENTERTAINMENT", "ON_BOARD_SERVICE", "LEG_ROOM_SERVICE", "BAGGAGE_HANDLING",
    "CHECKIN_SERVICE", "INFLIGHT_SERVICE", "CLEANLINESS",
]

BASE_FEATURES = (
    ["GENDER", "CUSTOMER_TYPE", "AGE", "TYPE_OF_TRAVEL", "CLASS", "FLIGHT_DISTANCE"]
    + RATINGS
    + ["DEPARTURE_DELAY_IN_MINUTES", "ARRIVAL_DELAY_IN_MINUTES"]
)

DERIVED_FEATURES = [
    "WIFI_AVAIBLE", "RICH_POOR", "BUSINESS_PERSON", "IN_LOYAL_GENDER", "TYPE_BOARDING",
    "WIFI_CLAS", "TYPE_COMFORT", "LOY_CLASS", "LOY_TRAVEL",
]

FEATURES = BASE_FEATURES + DERIVED_FEATURES  # the 31 model inputs, in order

# Ranges accepted for an incoming scoring request (base answers, already encoded).
# The delay minimum is 0 so that an on-time flight can be entered.
REQUEST_RANGES = {
    "GENDER": (0, 1), "CUSTOMER_TYPE": (0, 1), "AGE": (1, 90), "TYPE_OF_TRAVEL": (0, 1),
    "CLASS": (0, 2), "FLIGHT_DISTANCE": (1, 5000),
    **{r: (0, 5) for r in RATINGS},
    "DEPARTURE_DELAY_IN_MINUTES": (0, 2000), "ARRIVAL_DELAY_IN_MINUTES": (0, 2000),
}

REQUEST_SCHEMA = T.StructType(
    [T.StructField("ID", T.LongType(), False)]
    + [T.StructField(c, T.LongType(), True) for c in BASE_FEATURES]
)

# raw survey file as the study reads it (spaced names, strings not yet encoded)
RAW_SURVEY_COLUMNS = [
    ("Unnamed: 0", T.LongType()), ("id", T.LongType()), ("Gender", T.StringType()),
    ("Customer Type", T.StringType()), ("Age", T.LongType()), ("Type of Travel", T.StringType()),
    ("Class", T.StringType()), ("Flight Distance", T.LongType()),
    ("Inflight wifi service", T.LongType()), ("Departure/Arrival time convenient", T.LongType()),
    ("Ease of Online booking", T.LongType()), ("Gate location", T.LongType()),
    ("Food and drink", T.LongType()), ("Online boarding", T.LongType()),
    ("Seat comfort", T.LongType()), ("Inflight entertainment", T.LongType()),
    ("On-board service", T.LongType()), ("Leg room service", T.LongType()),
    ("Baggage handling", T.LongType()), ("Checkin service", T.LongType()),
    ("Inflight service", T.LongType()), ("Cleanliness", T.LongType()),
    ("Departure Delay in Minutes", T.LongType()), ("Arrival Delay in Minutes", T.DoubleType()),
    ("satisfaction", T.StringType()),
]
RAW_SURVEY_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in RAW_SURVEY_COLUMNS])
