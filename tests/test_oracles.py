"""Every registered query with an oracle matches DuckDB on the small tables (rounded, order-insensitive)."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _key(r):
    return tuple((0, str(x)) if not isinstance(x, (int, float)) or isinstance(x, bool) else (1, float(x)) for x in r)


def test_every_query_has_a_callable():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["entity", "n", "mse", "rmse", "mae", "r2"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sdf.columns
    srows = [_norm(tuple(r)) for r in sdf.collect()]
    rel = duck.execute(SQL[name])
    dcols = [d[0] for d in rel.description]
    drows = [_norm(tuple(r)) for r in rel.fetchall()]
    assert sorted(cols) == sorted(dcols)
    so = sorted(range(len(cols)), key=lambda i: cols[i])
    do = sorted(range(len(dcols)), key=lambda i: dcols[i])
    sr = sorted((tuple(r[i] for i in so) for r in srows), key=_key)
    dr = sorted((tuple(r[i] for i in do) for r in drows), key=_key)
    assert len(sr) == len(dr)
    assert sr == dr
