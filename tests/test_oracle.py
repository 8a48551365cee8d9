"""Every query that has oracle SQL gives the same rows in Spark and DuckDB (sf0.001)."""

import math
from collections import Counter

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

SLOW = {"score_stream"}  # equals score_requests: test_prep_scoring.test_stream_equals_batch


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if n not in SLOW])
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _bag(sdf.columns, srows) == _bag(dcols, drows)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["TYPE_OF_TRAVEL", "CLASS", "RICH_POOR", "n", "satisfied_rate"]


def test_every_query_has_a_callable():
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q)
    assert all(callable(f) for f in q.values())
