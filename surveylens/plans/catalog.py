"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator group.

Every query reads the driver tables (through the survey view or directly) and runs
over whole tables; doubles are rounded to 6 places at the very end so the result
compares stably with the SQL oracle.
"""

from __future__ import annotations


from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.functions import columns as C
from surveylens.operators import boost as B
from surveylens.operators import clean as CL
from surveylens.operators import grids as GR
from surveylens.operators import metrics as M
from surveylens.operators import models as ML
from surveylens.operators import profile as P
from surveylens.operators import split as SP
from surveylens.operators import trees as T
from surveylens.plans import frames as FR
from surveylens.plans import pipeline as PL
from surveylens.plans import prep as PR
from surveylens.plans import scoring as SC
from surveylens.session import scratch_path
from surveylens.sources import model_store as MS
from surveylens.sources import survey_io as IO
from surveylens.sources.tables import load_table, survey_view


def _r(df: DataFrame) -> DataFrame:
    return C.round_doubles(df, 6)


def _roles(df: DataFrame, cat_th: int) -> dict[str, list[str]]:
    return P.grab_col_names(df, cat_th=cat_th, car_th=S.CAR_TH)


# ------------------------------------------------------------- flagship ----

def satisfied_by_travel_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satisfied share by travel type x class (and the RICH_POOR code they form)."""
    df = FR.survey_encoded(spark, sf_dir)
    return _r(df.groupBy("TYPE_OF_TRAVEL", "CLASS", "RICH_POOR")
              .agg(F.count(F.lit(1)).alias("n"), F.avg("SATISFACTION").alias("satisfied_rate")))


# -------------------------------------------------------------- profile ----

def table_shape(spark, sf_dir):
    return P.table_shape(FR.survey_upper(spark, sf_dir))


def null_counts(spark, sf_dir):
    return P.null_counts(FR.survey_upper(spark, sf_dir))


def missing_table(spark, sf_dir):
    return _r(P.missing_table(FR.survey_upper(spark, sf_dir)))


def column_roles(spark, sf_dir):
    df = FR.survey_upper(spark, sf_dir)
    counts = P.distinct_counts(df)
    counts = spark.createDataFrame(counts.collect(), counts.schema)  # a row a column, counted once
    out = None
    for th in (S.CAT_TH_UPPER, S.CAT_TH_OUTLIER, S.CAT_TH_SCALE):
        part = P.column_roles(df, cat_th=th, car_th=S.CAR_TH, counts=counts)
        out = part if out is None else out.unionByName(part)
    return out


def quantile_table(spark, sf_dir):
    df = FR.survey_upper(spark, sf_dir)
    return _r(P.quantile_table(df))


def describe_numeric(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(P.describe_numeric(df, _roles(df, S.CAT_TH_OUTLIER)["num_cols"]))


def _cat_cols(df):
    return [c for c in _roles(df, S.CAT_TH_OUTLIER)["cat_cols"] if c != S.TARGET]


def value_counts_ratio(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(P.value_counts(df, _roles(df, S.CAT_TH_OUTLIER)["cat_cols"]))


def num_mean_by_target(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(P.num_mean_by_target(df, S.TARGET, _roles(df, S.CAT_TH_OUTLIER)["num_cols"]))


def target_mean_by_cat(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(P.target_mean_by_cat(df, S.TARGET, _cat_cols(df)))


def category_by_target(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return P.category_by_target(df, S.TARGET, _cat_cols(df))


def histogram_20(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(P.histogram(df, _roles(df, S.CAT_TH_OUTLIER)["num_cols"], bins=20))


def histogram_by_target(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(P.histogram(df, _roles(df, S.CAT_TH_OUTLIER)["num_cols"], bins=20, by=[S.TARGET])
              .drop("density"))


def box_stats(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(P.box_stats(df, _roles(df, S.CAT_TH_OUTLIER)["num_cols"], by=[S.TARGET]))


def corr_lower(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(P.corr_lower(df, P.numeric_columns(df)))


def skewness_table(spark, sf_dir):
    df = FR.survey_upper(spark, sf_dir)
    return _r(P.skewness_table(df, S.LOG1P_COLUMNS))


def skew_test(spark, sf_dir):
    df = FR.survey_upper(spark, sf_dir)
    return _r(P.skew_test(df, S.LOG1P_COLUMNS))


def check_df(spark, sf_dir):
    """The check_df report in long form: (section, column_name, statistic, value)."""
    df = FR.survey_upper(spark, sf_dir)
    num = P.numeric_columns(df)
    shape = P.table_shape(df).selectExpr(
        "stack(2, 'rows', CAST(n_rows AS DOUBLE), 'columns', CAST(n_cols AS DOUBLE)) AS (statistic, value)"
    ).select(F.lit("shape").alias("section"), F.lit(None).cast("string").alias("column_name"),
             "statistic", "value")
    types = spark.createDataFrame(
        [("types", f.name, f.dataType.simpleString(), None) for f in df.schema.fields],
        "section string, column_name string, statistic string, value double")
    nulls = P.null_counts(df).select(F.lit("na").alias("section"), "column_name",
                                     F.lit("n_null").alias("statistic"),
                                     F.col("n_null").cast("double").alias("value"))
    qs = P.quantile_table(df, num).select(
        F.lit("quantiles").alias("section"), "column_name",
        F.format_string("q%.2f", F.col("prob")).alias("statistic"), "value")
    report = shape.unionByName(types).unionByName(nulls).unionByName(qs)
    for section, order in (("head", F.asc("ID")), ("tail", F.desc("ID"))):
        five = df.orderBy(order).limit(5).withColumn("k", F.row_number().over(Window.orderBy(order)))
        cells = ", ".join(f"'{c}', coalesce(CAST({c} AS STRING), 'NULL')" for c in df.columns)
        report = report.unionByName(
            five.selectExpr("k", f"stack({len(df.columns)}, {cells}) AS (column_name, cell)").select(
                F.lit(section).alias("section"), "column_name",
                F.concat(F.lit("row"), F.col("k").cast("string"), F.lit(": "), "cell").alias("statistic"),
                F.lit(None).cast("double").alias("value")))
    return _r(report)


# ------------------------------------------------------- scalar / features ----

def upper_values(spark, sf_dir):
    df = FR.survey_upper(spark, sf_dir)
    up = _roles(df, S.CAT_TH_UPPER)
    strings = [c for c in up["cat_cols"] if P.is_string(df, c)]
    return C.upper_values(df, strings).select("ID", *strings)


def encode_labels(spark, sf_dir):
    df = FR.survey_target_encoded(spark, sf_dir)
    return C.encode_labels(df).select("ID", *FR.CAT_STRING_COLS, S.TARGET)


def interaction_features(spark, sf_dir):
    df = FR.survey_encoded(spark, sf_dir)
    return df.select("ID", *S.DERIVED_FEATURES)


# ---------------------------------------------------------------- cleaning ----



def outlier_thresholds(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(CL.outlier_thresholds(df, _roles(df, S.CAT_TH_OUTLIER)["num_cols"]))


def outlier_flags(spark, sf_dir):
    df = FR.survey_features_no_id(spark, sf_dir)
    return _r(CL.outlier_flags(df, _roles(df, S.CAT_TH_OUTLIER)["num_cols"]))


def outlier_rows(spark, sf_dir):
    events = load_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return _r(CL.outlier_rows(events, "value"))


def impute_median(spark, sf_dir):
    df = FR.survey_upper(spark, sf_dir)
    return _r(CL.quick_missing_imp(df, num_method="median"))


def impute_mean(spark, sf_dir):
    df = FR.survey_upper(spark, sf_dir)
    return _r(CL.quick_missing_imp(df, num_method="mean"))


def log1p_transform(spark, sf_dir):
    df = CL.quick_missing_imp(FR.survey_upper(spark, sf_dir), num_method="median")
    return _r(C.log1p_columns(df, S.LOG1P_COLUMNS).select("ID", *S.LOG1P_COLUMNS))


def _prepared_full(spark, sf_dir):
    raw = survey_view(spark, sf_dir)
    model = PR.fit_prep(raw)
    return PR.apply_prep(raw, model), model


def prep_full(spark, sf_dir):
    out, _ = _prepared_full(spark, sf_dir)
    return _r(out)


def standardize(spark, sf_dir):
    out, model = _prepared_full(spark, sf_dir)
    return _r(out.select("ID", *model.scale_cols))


def prep_apply_holdout(spark, sf_dir):
    """Fit on the 60 % training part, apply the frozen model to the 40 % holdout."""
    raw = survey_view(spark, sf_dir)
    train, test = SP.train_test_split(raw, key="id")
    model = PR.fit_prep(train)
    return _r(PR.apply_prep(test, model))


def split_60_40(spark, sf_dir):
    df = FR.survey_target_encoded(spark, sf_dir)
    part = F.when(SP.split_column("ID"), "train").otherwise("test")
    return (df.withColumn("part", part).groupBy("part")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(S.TARGET).cast("long").alias("n_satisfied")))


def fold_sizes(spark, sf_dir):
    df = FR.survey_target_encoded(spark, sf_dir)
    train, _ = SP.train_test_split(df)
    return (SP.with_folds(train, S.COMPARISON_FOLDS).groupBy("fold")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(S.TARGET).cast("long").alias("n_satisfied")))


def exact_split(spark, sf_dir):
    """Part of every respondent in the exact 60/40 split."""
    train = SP.exact_train(FR.survey_target_encoded(spark, sf_dir), "in_train")
    return train.select("ID", F.when(F.col("in_train"), "train").otherwise("test").alias("part"))


def stratified_folds(spark, sf_dir):
    """Stratified fold of every respondent."""
    return SP.with_stratified_folds(FR.survey_target_encoded(spark, sf_dir), S.COMPARISON_FOLDS, S.TARGET) \
        .select("ID", S.TARGET, "fold")


def sample_one(spark, sf_dir):
    return SP.sample_one(FR.survey_upper(spark, sf_dir))


def lookup_row(spark, sf_dir):
    """The original answers of the sampled respondent (sample, then semi join by key)."""
    df = FR.survey_upper(spark, sf_dir)
    return SP.lookup_rows(df, SP.sample_one(df))


def head_tail(spark, sf_dir):
    return SP.head_tail(FR.survey_upper(spark, sf_dir))


def read_csv_roundtrip(spark, sf_dir):
    """Survey written as the study's CSV (spaced headers), read back and normalised."""
    path = scratch_path(spark, "survey-csv")
    IO.write_survey_csv(IO.to_raw_survey(survey_view(spark, sf_dir)), path)
    df = IO.read_survey(spark, path)
    df = C.normalise_names(C.upper_names(df))
    return C.drop_ids(df, keep_key="ID")


# ------------------------------------------------------ metrics and models ----



# A hand-written ensemble used to check scoring against SQL.
FIXED_STUMPS = [
    B.Stump("CLASS", 1.5, 0, 1, 1.2, 0.0),
    B.Stump("TYPE_BOARDING", 9.5, 0, 1, 0.8, 0.0),
    B.Stump("INFLIGHT_WIFI_SERVICE", 3.5, 0, 1, 0.5, 0.0),
    B.Stump("FLIGHT_DISTANCE", 0.25, 1, 0, 0.3, 0.0),
]
FIXED_ENSEMBLE = B.BoostedStumps(list(S.FEATURES), 1.0, len(FIXED_STUMPS), list(FIXED_STUMPS))

# Parameters of the registered (correctness-run) model queries; the library defaults
# in ``schema`` hold the study's full grid for production runs.
HOLDOUT_ROUNDS = S.ADABOOST_DEFAULTS["n_estimators"]
GRID_N_ESTIMATORS = S.ADABOOST_GRID["n_estimators"]
GRID_LEARNING_RATES = S.ADABOOST_GRID["learning_rate"]
GRID_FOLDS = S.ADABOOST_GRID_FOLDS


def _closed_form_scored(spark, sf_dir):
    """A fixed integer score 0..20 on the encoded survey: prediction = score >= 10."""
    d = FR.survey_encoded(spark, sf_dir)
    s = (2 * F.col("ONLINE_BOARDING") + F.col("INFLIGHT_WIFI_SERVICE")
         + F.when(F.col("CLASS") == 2, 3).otherwise(0) + 2 * F.col("TYPE_OF_TRAVEL"))
    return d.select(F.col(S.TARGET).cast("int").alias("label"),
                    F.when(s >= 10, 1).otherwise(0).alias("prediction"),
                    (s / 20.0).alias("score"))


def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_closed_form_scored(spark, sf_dir))


def classification_report(spark, sf_dir):
    return _r(M.classification_report(_closed_form_scored(spark, sf_dir)))


def binary_metrics(spark, sf_dir):
    return _r(M.binary_metrics(_closed_form_scored(spark, sf_dir)))


def r2_on_labels(spark, sf_dir):
    return _r(M.r2_on_labels(_closed_form_scored(spark, sf_dir)))


def roc_auc(spark, sf_dir):
    return _r(M.roc_auc(_closed_form_scored(spark, sf_dir)))


def _train_prep(spark, sf_dir):
    raw = survey_view(spark, sf_dir)
    train, test = SP.train_test_split(raw, key="id")
    return PR.fit_prep(train)


def _prepared_parts(spark, sf_dir, deal: bool = False):
    """``deal``: training rows are dealt over all cores before they are prepared, when they are
    fewer bytes; the view and the preparation in one step make code too long to be compiled."""
    model = _train_prep(spark, sf_dir)
    raw = survey_view(spark, sf_dir)
    train, test = SP.train_test_split(raw, key="id")
    train = ML.dealt(train) if deal else train
    return PR.apply_prep(train, model), PR.apply_prep(test, model), model


def stump_ensemble_score(spark, sf_dir):
    out, _ = _prepared_full(spark, sf_dir)
    return _r(FIXED_ENSEMBLE.transform(out).select("ID", "decision", "prediction"))


def adaboost_round1(spark, sf_dir):
    """First boosting round on the training part: the best weighted-Gini stump."""
    train, _, _ = _prepared_parts(spark, sf_dir)
    fit = B.fit_boosted_stumps(train, S.FEATURES, S.TARGET, [B.BoostSpec("r1", F.lit(True), 1.0, 1)])
    st = fit["r1"].stumps[0]
    return _r(spark.createDataFrame(
        [(st.feature, st.threshold, st.left, st.right, st.error, st.alpha)],
        "feature string, threshold double, left_class int, right_class int, error double, alpha double"))


def _three_rounds(spark, sf_dir) -> B.BoostedStumps:
    train, _, _ = _prepared_parts(spark, sf_dir)
    return B.fit_boosted_stumps(train, S.FEATURES, S.TARGET, [B.BoostSpec("r3", F.lit(True), 1.0, 3)])["r3"]


def adaboost_round3(spark, sf_dir):
    """The first three boosting rounds on the training part."""
    rows = [(k + 1, st.feature, st.threshold, st.left, st.right, st.error, st.alpha)
            for k, st in enumerate(_three_rounds(spark, sf_dir).stumps)]
    return _r(spark.createDataFrame(rows, "round int, feature string, threshold double, left_class int, "
                                          "right_class int, error double, alpha double"))


def adaboost_real_round3(spark, sf_dir):
    """The first three rounds of the real variant (leaves with class odds) on the training part."""
    train, _, _ = _prepared_parts(spark, sf_dir)
    model = B.fit_real_stumps(train, S.FEATURES, S.TARGET, [B.BoostSpec("r3", F.lit(True), 1.0, 3)])["r3"]
    rows = [(k + 1, st.feature, st.threshold, st.left_odds, st.right_odds, st.error)
            for k, st in enumerate(model.stumps)]
    return _r(spark.createDataFrame(rows, "round int, feature string, threshold double, left_odds double, "
                                          "right_odds double, error double"))


def adaboost_real_holdout(spark, sf_dir):
    """The study's default booster (real variant, 50 stumps, rate 1): scores on train and holdout."""
    train, test, _ = _prepared_parts(spark, sf_dir)
    model = B.fit_real_stumps(train, S.FEATURES, S.TARGET,
                              [B.BoostSpec("m", F.lit(True), 1.0, HOLDOUT_ROUNDS)])["m"]
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    scored = model.transform(both).select("part", F.col(S.TARGET).cast("int").alias("label"), "prediction",
                                          F.col("decision").alias("score"))
    return _r(M.grouped_binary_metrics(scored, ["part"]))


def cart_depth3(spark, sf_dir):
    """The nodes of a tree of depth 3 on the training part, grown level by level; the root is node
    1, a node's children are 2 node and 2 node + 1; ``cut`` is the largest value that goes left."""
    tables = _grid_tables(spark, sf_dir, 1)
    nodes = T.tree_nodes(tables.coded(), T.ForestSpec(None, max_depth=3))
    tables.drop()
    return _r(spark.createDataFrame(nodes, "node long, feature string, cut double, n long, share double"))


def importance_round3(spark, sf_dir):
    """Features that three rounds use, with their share of alpha."""
    imp = [(f, v) for f, v in _three_rounds(spark, sf_dir).feature_importances().items() if v > 0]
    return _r(spark.createDataFrame(imp, "feature string, importance double"))


def _holdout_model(train, rounds: int):
    return B.fit_boosted_stumps(train, S.FEATURES, S.TARGET, [B.BoostSpec("m", F.lit(True), 1.0, rounds)])["m"]


def adaboost_fit_holdout(spark, sf_dir):
    """Default booster (50 stumps, rate 1) fitted on 60 %; scores on train and holdout."""
    train, test, _ = _prepared_parts(spark, sf_dir, deal=True)
    model = _holdout_model(train, HOLDOUT_ROUNDS)
    rows = []
    for name, part in (("train", train), ("test", test)):
        scored = model.transform(part).select(F.col(S.TARGET).cast("int").alias("label"), "prediction",
                                              F.col("decision").alias("score")).persist()
        m = M.binary_metrics(scored).first()
        auc = M.roc_auc(scored).first()["roc_auc"]
        rows.append((name, m["n"], m["accuracy"], m["precision"], m["recall"], m["f1"], m["r2"], auc))
        scored.unpersist()
    return _r(spark.createDataFrame(rows, "part string, n long, accuracy double, precision double, "
                                          "recall double, f1 double, r2 double, roc_auc double"))


def importance_top10(spark, sf_dir):
    train, _, _ = _prepared_parts(spark, sf_dir, deal=True)
    imp = list(_holdout_model(train, HOLDOUT_ROUNDS).feature_importances().items())
    return _r(spark.createDataFrame(imp, "feature string, importance double")
              .orderBy(F.desc("importance"), "feature").limit(10))


def tree_importance(spark, sf_dir):
    """Feature importances of the fitted tree models (CART, random forest, boosted trees)."""
    train = _prepared_parts(spark, sf_dir, deal=True)[0].persist()  # read some times by every fit
    data = ML.assemble(train, S.FEATURES)
    rows = [(name, f, v) for name in ("CART", "RF", "gbt")
            for f, v in ML.tree_importances(ML.make_estimator(name).fit(data), S.FEATURES)]
    train.unpersist()
    return _r(spark.createDataFrame(rows, "model string, feature string, importance double"))


def adaboost_grid(spark, sf_dir):
    train, _, _ = _prepared_parts(spark, sf_dir)
    folded = SP.with_folds(train, GRID_FOLDS)
    scores, _ = B.grid_search(folded, S.FEATURES, S.TARGET, GRID_N_ESTIMATORS, GRID_LEARNING_RATES, GRID_FOLDS)
    return _r(scores)


def base_models_score(spark, sf_dir):
    """The training job's comparison: AdaBoost and the LightGBM settings, 5-fold CV."""
    tables = _grid_tables(spark, sf_dir, S.COMPARISON_FOLDS)
    out = GR.compare(tables, {m: (m, {}) for m in GR.TRAINING_JOB_MODELS})
    tables.drop()
    return _r(out)


def _grid_tables(spark, sf_dir, folds: int) -> GR.Tables:
    train, _, _ = _prepared_parts(spark, sf_dir)
    return GR.Tables(SP.with_folds(train, folds), S.FEATURES, S.TARGET)


def compare_models(spark, sf_dir):
    """The nine models of the study's comparison with their default parameters, 5-fold CV."""
    tables = _grid_tables(spark, sf_dir, S.COMPARISON_FOLDS)
    out = GR.compare(tables, {m: (m, {}) for m in GR.MODELS})
    tables.drop()  # the scores are in the store
    return _r(out)


def _tuned(spark, sf_dir, model: str, grid: dict, folds: int):
    """(model, params, mean_accuracy, std_accuracy) of every point of the grid."""
    tables = _grid_tables(spark, sf_dir, folds)
    out = GR.tune(tables, model, grid, folds)
    tables.drop()
    return _r(out.drop("place"))


def tune_cart(spark, sf_dir):
    """CART's published grid: 532 points from one tree a fold."""
    return _tuned(spark, sf_dir, "CART", S.COMPARISON_GRIDS["CART"], S.COMPARISON_FOLDS)


def tune_knn(spark, sf_dir):
    """The published numbers of neighbours: 48 points from one table of votes."""
    return _tuned(spark, sf_dir, "KNN", S.COMPARISON_GRIDS["KNN"], S.COMPARISON_FOLDS)


def tune_rf(spark, sf_dir):
    """The published grid of the random forest: 180 points from one forest a fold and feature count."""
    return _tuned(spark, sf_dir, "RF", *S.MODEL_GRIDS["RF"])


def tune_xgboost(spark, sf_dir):
    return _tuned(spark, sf_dir, "XGBoost", *S.MODEL_GRIDS["XGBoost"])


def tune_catboost(spark, sf_dir):
    return _tuned(spark, sf_dir, "CatBoost", *S.MODEL_GRIDS["CatBoost"])


def tune_lightgbm(spark, sf_dir):
    return _tuned(spark, sf_dir, "LightGBM", *S.MODEL_GRIDS["LightGBM"])


def tune_lr(spark, sf_dir):
    """The published iteration counts of logistic regression, ten folds in one scan an iteration."""
    return _tuned(spark, sf_dir, "LR", *S.MODEL_GRIDS["LR"])


def _before_after(spark, sf_dir, model: str):
    tables = _grid_tables(spark, sf_dir, S.COMPARISON_FOLDS)
    out = GR.before_after(tables, model, S.COMPARISON_GRIDS[model])
    tables.drop()
    return _r(out)


def before_after_knn(spark, sf_dir):
    """Cross-validated roc_auc and f1 before and after the comparison's grid; so the next four."""
    return _before_after(spark, sf_dir, "KNN")


def before_after_cart(spark, sf_dir):
    return _before_after(spark, sf_dir, "CART")


def before_after_rf(spark, sf_dir):
    return _before_after(spark, sf_dir, "RF")


def before_after_xgboost(spark, sf_dir):
    return _before_after(spark, sf_dir, "XGBoost")


def before_after_lightgbm(spark, sf_dir):
    return _before_after(spark, sf_dir, "LightGBM")


def model_params(spark, sf_dir):
    train = _prepared_parts(spark, sf_dir, deal=True)[0].persist()  # read some times by every fit
    data = ML.assemble(train, S.FEATURES)
    rows = []
    for name in ("LR", "CART"):
        model = ML.make_estimator(name).fit(data)
        rows += [(name, *r) for r in ML.model_params(model) + ML.fitted_facts(model, S.FEATURES)]
    train.unpersist()
    return spark.createDataFrame(rows, "model string, param string, value string")


def model_roundtrip(spark, sf_dir):
    """Fit, save to the shared folder, load, score the holdout; predictions must agree."""
    train, test, prep = _prepared_parts(spark, sf_dir, deal=True)
    model = _holdout_model(train, HOLDOUT_ROUNDS)
    path = scratch_path(spark, "model")
    MS.save_model(spark, path, prep, model)
    prep2, model2 = MS.load_model(spark, path)
    # both models score the same rows in one projection (no join needed)
    rows = PR.apply_prep(SP.train_test_split(survey_view(spark, sf_dir), key="id")[1], prep2)
    both = rows.select(model.prediction().alias("p1"), model2.prediction().alias("p2"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p1") == F.col("p2")).alias("n_equal"))


# ---------------------------------------------------------------- scoring ----

def _requests(spark, sf_dir):
    return SC.requests_from_survey(FR.survey_target_encoded(spark, sf_dir))


def validate_ranges(spark, sf_dir):
    return SC.validate_ranges(_requests(spark, sf_dir))


def score_requests(spark, sf_dir):
    prep = _train_prep(spark, sf_dir)
    return _r(SC.score_requests(_requests(spark, sf_dir), prep, FIXED_ENSEMBLE))


def score_stream(spark, sf_dir):
    """The same requests landing as parquet files, scored by a streaming query."""
    from surveylens.streaming.scoring_stream import score_available
    prep = _train_prep(spark, sf_dir)
    source = scratch_path(spark, "requests")
    _requests(spark, sf_dir).write.parquet(source)
    return _r(score_available(spark, source, prep, FIXED_ENSEMBLE))


def batch_predict(spark, sf_dir):
    """A raw survey file scored by a saved and reloaded model; predictions written and read."""
    _, prep = _prepared_full(spark, sf_dir)
    source, model, sink = (scratch_path(spark, n) for n in ("survey-file", "saved-model", "predictions"))
    IO.write_survey_csv(IO.to_raw_survey(survey_view(spark, sf_dir)), source)
    MS.save_model(spark, model, prep, FIXED_ENSEMBLE)
    return _r(SC.predict_file(spark, source, model, sink))


def pipeline_model_predict(spark, sf_dir):
    """One saved pipeline (preparation and three boosting rounds, fitted on the training part)
    scores the raw file of that part."""
    train, _ = SP.train_test_split(survey_view(spark, sf_dir), key="id")
    source, path = (scratch_path(spark, n) for n in ("survey-file", "pipeline-model"))
    Pipeline(stages=[PL.SurveyPrep(), PL.StumpBooster(nEstimators=3)]).fit(train).write().save(path)
    IO.write_survey_csv(IO.to_raw_survey(train), source)
    scored = PipelineModel.load(path).transform(IO.read_survey(spark, source))
    return _r(scored.select("ID", "decision", "prediction"))
