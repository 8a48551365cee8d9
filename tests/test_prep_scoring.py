"""Prep properties, one-row vs batch scoring, streaming vs batch, CSV source."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from surveylens import schema as S
from surveylens.plans import catalog
from surveylens.plans import prep as PR
from surveylens.plans import scoring as SC
from surveylens.plans import frames as FR
from surveylens.sources.tables import survey_view


@pytest.fixture(scope="module")
def fitted(spark):
    raw = survey_view(spark, SF_SMALL)
    model = PR.fit_prep(raw)
    return raw, model, PR.apply_prep(raw, model).cache()


def test_no_nulls_after_prep_and_scaled_moments(fitted):
    raw, model, out = fitted
    assert model.scale_cols == ["AGE", "FLIGHT_DISTANCE", "DEPARTURE_DELAY_IN_MINUTES", "ARRIVAL_DELAY_IN_MINUTES"]
    nulls = out.select([F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first()
    assert all(v == 0 for v in nulls)
    for c in model.scale_cols:
        r = out.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).first()
        assert r.m == pytest.approx(0.0, abs=1e-9) and r.s == pytest.approx(1.0, abs=1e-9)


def test_apply_is_pure_and_model_roundtrips(fitted):
    raw, model, out = fitted
    again = PR.apply_prep(raw, PR.PrepModel.from_json(model.to_json()))
    assert again.exceptAll(out).count() == 0
    assert PR.apply_prep(raw.repartition(5), model).exceptAll(out).count() == 0


def test_one_row_scoring_equals_batch(spark):
    reqs = SC.requests_from_survey(FR.survey_target_encoded(spark, SF_SMALL))
    prep = PR.fit_prep(survey_view(spark, SF_SMALL))
    batch = {r.ID: r.prediction for r in SC.score_requests(reqs, prep, catalog.FIXED_ENSEMBLE).collect()}
    one = reqs.orderBy("ID").limit(1).collect()[0]
    single = spark.createDataFrame([one], S.REQUEST_SCHEMA)
    got = SC.score_requests(single, prep, catalog.FIXED_ENSEMBLE).collect()
    if one.ID in batch:
        assert got[0].prediction == batch[one.ID]
    else:
        assert got == []


def test_validation_lists_every_violated_field(spark):
    row = {c: 1 for c in S.BASE_FEATURES}
    row.update({"ID": 1, "AGE": 120, "INFLIGHT_WIFI_SERVICE": 9})
    df = spark.createDataFrame([row], S.REQUEST_SCHEMA)
    r = SC.validate_ranges(df).first()
    assert r.violations == "AGE,INFLIGHT_WIFI_SERVICE" and r.n_violations == 2


def test_stream_equals_batch(spark):
    a = {tuple(r) for r in catalog.score_requests(spark, SF_SMALL).collect()}
    b = {tuple(r) for r in catalog.score_stream(spark, SF_SMALL).collect()}
    assert a == b and len(a) > 0


def test_csv_roundtrip_equals_view(spark):
    back = catalog.read_csv_roundtrip(spark, SF_SMALL)
    view = FR.survey_upper(spark, SF_SMALL).withColumn(
        "ARRIVAL_DELAY_IN_MINUTES", F.col("ARRIVAL_DELAY_IN_MINUTES").cast("double"))
    assert back.columns == view.columns
    assert back.exceptAll(view).count() == 0 and view.exceptAll(back).count() == 0


def test_run_training_end_to_end(spark):
    from surveylens.operators.split import train_test_split
    from surveylens.plans.training import run_training
    from surveylens.session import scratch_path
    from surveylens.sources.model_store import load_model
    raw = survey_view(spark, SF_SMALL)
    path = scratch_path(spark, "test-model")
    res = run_training(spark, raw, path, n_estimators=[2, 4], learning_rates=[0.5, 1.0], folds=2,
                       compare=["LightGBM"])
    assert {r["metric"] for r in res.comparison} == set(S.COMPARISON_METRICS)
    assert res.best_params["n_estimators"] in (2, 4) and len(res.grid) == 4
    assert len(res.model.stumps) <= res.best_params["n_estimators"]
    assert 0.5 < res.scores["test"]["accuracy"] <= 1.0
    prep2, model2 = load_model(spark, path)
    test = PR.apply_prep(train_test_split(raw, key="id")[1], prep2)
    a = res.model.transform(test).select("ID", "prediction")
    b = model2.transform(test).select("ID", "prediction")
    assert a.exceptAll(b).count() == 0


def test_requests_json_and_prediction_sink(spark):
    from surveylens.session import scratch_path
    from surveylens.sources.survey_io import read_requests, write_predictions
    reqs = SC.requests_from_survey(FR.survey_target_encoded(spark, SF_SMALL))
    src, out = scratch_path(spark, "req-json"), scratch_path(spark, "pred")
    reqs.write.json(src)
    prep = PR.fit_prep(survey_view(spark, SF_SMALL))
    scored = SC.score_requests(read_requests(spark, src), prep, catalog.FIXED_ENSEMBLE)
    write_predictions(scored, out)
    back = spark.read.parquet(out)
    direct = SC.score_requests(reqs, prep, catalog.FIXED_ENSEMBLE)
    assert back.count() == direct.count() > 0
    assert back.select("ID", "prediction").exceptAll(direct.select("ID", "prediction")).count() == 0


def test_fit_is_partition_invariant_and_handles_a_hot_value(spark):
    import numpy as np
    raw = survey_view(spark, SF_SMALL)
    a = PR.fit_prep(raw)
    b = PR.fit_prep(raw.repartition(13, "gender"))
    assert a.fills == b.fills and a.scale_cols == b.scale_cols
    for c in a.scale_cols:
        assert a.means[c] == pytest.approx(b.means[c], abs=1e-12)
        assert a.stds[c] == pytest.approx(b.stds[c], abs=1e-12)
    # one respondent pattern repeated until it holds a third of all rows
    one = raw.orderBy("id").limit(1)
    copies = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(750))).alias("k")).drop("k")
    skewed = raw.unionByName(copies)
    m = PR.fit_prep(skewed)
    pdf = skewed.select("age", "arrival_delay_in_minutes").toPandas()
    assert m.means["AGE"] == pytest.approx(pdf["age"].mean(), abs=1e-9)
    assert m.fills["ARRIVAL_DELAY_IN_MINUTES"] == pytest.approx(float(np.nanmedian(pdf["arrival_delay_in_minutes"])))


def test_request_scoring_equals_batch_preparation_row_for_row(spark):
    raw = survey_view(spark, SF_SMALL)
    prep = PR.fit_prep(raw)
    batch = {r.ID: r for r in catalog.FIXED_ENSEMBLE.transform(PR.apply_prep(raw, prep)).collect()}
    reqs = SC.requests_from_survey(FR.survey_target_encoded(spark, SF_SMALL))
    scored = SC.score_requests(reqs, prep, catalog.FIXED_ENSEMBLE).collect()
    assert len(scored) == len(batch)  # rejected requests are emitted too
    flips = [r.ID for r in scored if r.violations == "" and
             (r.prediction != batch[r.ID].prediction or abs(r.decision - batch[r.ID].decision) > 1e-9)]
    assert flips == []
    assert all(r.prediction is None and r.outcome is None for r in scored if r.violations)


def test_every_column_has_a_fill_for_rows_scored_later(spark):
    raw = survey_view(spark, SF_SMALL)
    prep = PR.fit_prep(raw)
    one = raw.limit(1).withColumns({c: F.lit(None).cast(raw.schema[c].dataType) for c in
                                    ("age", "seat_comfort", "gender", "class", "type_of_travel")})
    row = PR.apply_prep(one, prep).first()
    assert all(row[c] is not None for c in ("AGE", "SEAT_COMFORT", "GENDER", "CLASS", "TYPE_COMFORT"))


def test_raw_file_headers_give_the_same_features(spark):
    from surveylens.session import scratch_path
    from surveylens.sources.survey_io import read_survey, to_raw_survey, write_survey_csv
    view = survey_view(spark, SF_SMALL)
    prep = PR.fit_prep(view)
    path = scratch_path(spark, "raw-file")
    write_survey_csv(to_raw_survey(view), path)
    a, b = PR.apply_prep(read_survey(spark, path), prep), PR.apply_prep(view, prep)
    score = lambda d: {(r.ID, round(r.decision, 9)) for r in catalog.FIXED_ENSEMBLE.transform(d).collect()}
    assert score(a) == score(b)


def test_edge_cases_of_the_first_review(spark):
    from surveylens.operators import clean as CL
    from surveylens.operators import models as ML
    from surveylens.operators import profile as P
    from surveylens.operators import split as SP
    rows = spark.range(10_000).withColumnRenamed("id", "ID")
    for fraction in (0.005, 0.001):
        train, test = SP.train_test_split(rows, test_fraction=fraction)
        assert 0 < test.count() < 200 and train.count() + test.count() == 10_000
    small = spark.createDataFrame([(1.0, None, None), (2.0, None, "x"), (9.0, None, "x")],
                                  "a double, b double, g string")
    assert {r.column_name: r.z for r in P.skew_test(small, ["a"]).collect()} == {"a": None}
    flags = {r.column_name: r for r in CL.outlier_flags(small, ["a", "b"]).collect()}
    assert flags["b"].n_outliers == 0 and flags["b"].low_limit is None and not flags["b"].has_outlier
    assert CL.outlier_rows(small, "b").count() == 0
    assert {r.g for r in P.histogram(small, ["a"], 2, by=["g"]).collect()} == {"x"}
    roles = {r.column_name: r.role for r in P.column_roles(spark.createDataFrame([(True,)], "f boolean")).collect()}
    assert roles == {"f": "num_but_cat"}
    assert ML.make_estimator("LR", regParam=0.5).getRegParam() == 0.5
    with pytest.raises(ValueError):
        ML.make_estimator("CART", bins=64)
