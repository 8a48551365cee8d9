"""Hand-made edge cases for profiling and cleaning (FIXTURES.md D)."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surveylens.operators import clean as CL
from surveylens.operators import profile as P


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert CL.mode_values(df, ["c"]) == {"c": "a"}


def test_string_guard_counts_null_as_a_value(spark):
    # 20 distinct strings plus a null: 21 values > cat_length 20 -> not imputed
    rows = [(f"v{i}",) for i in range(20)] + [(None,)]
    df = spark.createDataFrame(rows, "c string")
    assert CL.fit_missing_fills(df, target="none") == {}
    rows19 = [(f"v{i}",) for i in range(19)] + [("v0",), (None,)]
    df19 = spark.createDataFrame(rows19, "c string")
    assert CL.fit_missing_fills(df19, target="none") == {"c": "v0"}


def test_even_median_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert CL.fit_missing_fills(df, target="none") == {"x": 2.5}
    out = CL.quick_missing_imp(df, target="none").collect()
    assert sorted(r.x for r in out) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_target_is_never_imputed(spark):
    df = spark.createDataFrame([(1.0, None), (None, "A"), (3.0, "A")], "x double, SATISFACTION string")
    fills = CL.fit_missing_fills(df)
    assert "SATISFACTION" not in fills and fills["x"] == 2.0


def test_value_on_threshold_is_no_outlier(spark):
    # q1 = 1.5, q3 = 3.5 -> limits -1.5 and 6.5 ; values exactly 6.5 are not outliers
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (4.0,), (6.5,), (6.5,), (100.0,), (1.0,)], "x double")
    lo, up = CL.threshold_literals(df, ["x"])["x"]
    rows = CL.outlier_rows(df, "x").collect()
    assert all(r.x > up or r.x < lo for r in rows)
    assert 6.5 <= up or any(r.x == 6.5 for r in rows)
    flags = CL.outlier_flags(df, ["x"]).first()
    assert flags.n_outliers == len(rows) and flags.has_outlier == (len(rows) > 0)


def test_nan_and_null_are_both_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    clean = P.nan_to_null(df)
    assert P.null_counts(clean).first().n_null == 2
    assert P.missing_table(clean).first().ratio == pytest.approx(66.67)


def test_histogram_max_in_last_bin_and_single_value(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (5.0, 5.0)], "x double, c double")
    h = {(r.column_name, r.bin): r.n for r in P.histogram(df, ["x", "c"], bins=20).collect()}
    assert h[("x", 20)] == 1 and h[("x", 1)] == 1 and h[("x", 11)] == 1
    assert h[("c", 1)] == 3


def test_value_counts_ratio_over_all_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    vc = {r.value: (r.n, r.ratio) for r in P.value_counts(df, ["c"]).collect()}
    assert vc == {"a": (2, 50.0), "b": (1, 25.0)}


def test_null_group_key_dropped(spark):
    df = spark.createDataFrame([(None, 1.0), (1, 2.0), (1, 4.0)], "t long, x double")
    out = P.num_mean_by_target(df, "t", ["x"]).collect()
    assert [(r.t, r.mean) for r in out] == [(1, 3.0)]


def test_skew_test_worked_example(spark):
    df = spark.createDataFrame([(float(v),) for v in (2, 8, 0, 4, 1, 9, 9, 0)], "x double")
    r = P.skew_test(df, ["x"]).first()
    assert r.z == pytest.approx(0.446264, abs=1e-5)
    assert r.p == pytest.approx(0.655407, abs=1e-5)


def test_roles_thresholds_are_strict(spark):
    # numeric with exactly cat_th values is num; string with exactly car_th values is cat
    rows = [(i % 10, f"s{i % 20}") for i in range(40)]
    df = spark.createDataFrame(rows, "n long, s string")
    roles = P.grab_col_names(df, cat_th=10, car_th=20)
    assert roles["num_cols"] == ["n"] and roles["cat_cols"] == ["s"]
    roles11 = P.grab_col_names(df, cat_th=11, car_th=19)
    assert roles11["num_but_cat"] == ["n"] and roles11["cat_but_car"] == ["s"]


def test_distinct_counts_exact_and_all_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None)], "a long, b string")
    assert {r.column_name: r.n_distinct for r in P.distinct_counts(df).collect()} == {"a": 2, "b": 0}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=2, max_size=40))
def test_quantiles_match_linear_interpolation(spark, xs):
    import numpy as np
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = {r.prob: r.value for r in P.quantiles(df, ["x"], [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for p, v in got.items():
        assert math.isclose(v, float(np.quantile(xs, p)), abs_tol=1e-9)


def test_exact_quantiles_many_values_and_a_hot_value(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.normal(size=2000).round(6), np.full(1000, 0.25)])
    g = np.arange(len(xs)) % 2
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, xs)], "g long, x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.g, r.prob): r.value for r in P.quantiles(df, ["x"], probs, by=["g"]).collect()}
    for k in (0, 1):
        for p in probs:
            assert got[(k, p)] == pytest.approx(float(np.quantile(xs[g == k], p)), abs=1e-9)


def test_corr_pairwise_complete_matches_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(11)
    a = rng.normal(size=400)
    b = a * 0.5 + rng.normal(size=400)
    c = rng.integers(0, 6, 400).astype(float)
    b[::7] = np.nan
    c[::5] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = P.nan_to_null(spark.createDataFrame(pdf))
    got = {(r.column_a, r.column_b): r.corr for r in P.corr_lower(df, ["a", "b", "c"]).collect()}
    want = pdf.corr()
    for (x, y), v in got.items():
        assert v == pytest.approx(want.loc[x, y], abs=1e-12)


def test_count_below_equals_bisect(spark):
    from bisect import bisect_left

    from pyspark.sql import functions as F
    cuts = [[], [1.0], [1.0, 1.0, 2.0], [float(i // 2) for i in range(17)], None]
    rows = [(c, v) for c in cuts for v in (-1.0, 0.0, 1.0, 1.5, 2.0, 8.0, 99.0)]
    got = spark.createDataFrame(rows, "cuts array<double>, v double").select(
        "cuts", "v", P.count_below(F.col("cuts"), F.col("v"), 17).alias("b")).collect()
    assert [r.b for r in got] == [bisect_left(r.cuts or [], r.v) for r in got]


@pytest.mark.parametrize("buckets", [2, 16, 300])
def test_quantiles_equal_numpy_in_any_number_of_buckets(spark, buckets):
    import numpy as np
    rng = np.random.default_rng(buckets)
    values = {"a": np.r_[rng.normal(size=200), np.full(100, 0.25)], "b": rng.integers(0, 5, 77) * 1.0,
              "c": np.array([3.5])}
    rows = [(k, int(i % 2), float(x)) for k, v in values.items() for i, x in enumerate(v)]
    freq = spark.createDataFrame(rows, "column_name string, g int, value double").groupBy(
        "column_name", "g", "value").count().withColumnRenamed("count", "n")
    probs = [0.0, 0.05, 0.5, 0.5, 0.99, 1.0]
    out = P.quantiles_from_freq(freq, ["g", "column_name"], probs, buckets=buckets).collect()
    want = [(g, k, p, np.quantile(v[g::2], p)) for k, v in values.items() for g in (0, 1)
            if len(v[g::2]) for p in probs]
    key = lambda r: (r[1], r[0], r[2])
    assert [tuple(r)[:3] for r in sorted(out, key=key)] == [r[:3] for r in sorted(want, key=key)]
    assert [r[3] for r in sorted(out, key=key)] == pytest.approx([r[3] for r in sorted(want, key=key)])


def test_bounded_counts_are_exact_for_few_values_and_large_for_many(spark):
    rows = [(i, f"s{i % 20}", float(i % 3) if i % 2 else None, None, i % 2 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "`ID` long, `it's` string, `x.y` double, none int, flag boolean")
    assert P.bounded_counts(df) == {"ID": 3000, "it's": 20, "x.y": 3, "none": 0, "flag": 2}
    assert P.bounded_counts(df.filter("flag IS NULL")) == dict.fromkeys(df.columns, 0)
    assert P.bounded_counts(df.select("ID"), buckets=64)["ID"] == 128  # two a bucket, of 3000
