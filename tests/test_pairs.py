"""Correlations of many columns: masked Gram matrices, rank exchange and batched Kendall, NaN missing in all."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vitalis.operators import kendall, ml, stats
from vitalis.operators.gram import gram
from vitalis.operators.rankcorr import rank_gram


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(2)
    n = 700
    a = r.normal(size=n)
    t = pd.DataFrame({"a": a, "b": a + r.normal(size=n), "ties": np.floor(a * 2), "far": 1e6 + a * 1e-3, "same": 3.3, "none": np.nan, "last": r.normal(size=n)})
    for c in ("b", "ties", "last"):
        t.loc[r.random(n) < 0.2, c] = np.nan
    t.loc[t["last"].notna(), "sided"] = 0.1  # constant wherever "last" is there
    t.loc[t["last"].isna(), "sided"] = a[t["last"].isna()]
    return t


def matrix(df, cols) -> np.ndarray:
    cell = {(r.col_a, r.col_b): r[2] for r in df.collect()}
    assert len(cell) == len(cols) ** 2
    return np.array([[np.nan if cell[x, y] is None else cell[x, y] for y in cols] for x in cols])


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_matrices_are_pairwise_complete(spark, data, method):
    cols = list(data.columns)
    half = spark.createDataFrame(data)  # NaN
    null = half.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    run = {"pearson": stats.corr_pearson, "spearman": stats.corr_spearman, "kendall": kendall.kendall_matrix}[method]
    got, same = (matrix(run(d, cols), cols) for d in (half, null))
    np.testing.assert_array_equal(got, same)
    if method == "kendall":
        for i, x in enumerate(cols):
            for j, y in enumerate(cols):
                u, v = (data[[x, y]].dropna().to_numpy()[:, k] for k in (0, 1)) if x != y else (np.zeros(0), np.zeros(0))
                if len(u):
                    s, t = (np.sign(w[:, None] - w[None, :]) for w in (u, v))
                    den = np.sqrt((s != 0).sum() * (t != 0).sum())
                    assert got[i, j] == pytest.approx((s * t).sum() / den) if den else np.isnan(got[i, j])
        return
    want = np.full(got.shape, np.nan)
    for i, x in enumerate(cols):
        for j, y in enumerate(cols):
            d = data[[x, y]].dropna() if x != y else data[[x]].dropna()
            d = d.rank() if method == "spearman" else d
            u, v = d[x].to_numpy(), d[y].to_numpy()
            if len(u) and np.ptp(u) and np.ptp(v):
                want[i, j] = np.corrcoef(u, v)[0, 1]
    np.testing.assert_allclose(got, want, atol=1e-7)


def test_gram_against_some_columns(spark, data):
    df = spark.createDataFrame(data)
    whole, part = gram(df, ["a", "b", "last"]), gram(df, ["a", "b"], ["last"])
    np.testing.assert_allclose(part.correlation()[:, 0], whole.correlation()[:2, 2], atol=1e-12)
    np.testing.assert_array_equal(part.n[:, 0], whole.n[:2, 2])
    r = {x.feature: x.r for x in stats.corr_with_target(df, ["a", "b", "none"], "last").collect()}
    assert r["none"] is None and r["a"] == pytest.approx(data[["a", "last"]].dropna().corr().iloc[0, 1])


def test_covariance_of_complete_rows(spark, data):
    cols = ["a", "b", "far"]
    np.testing.assert_allclose(ml.covariance_matrix(spark.createDataFrame(data), cols), data[cols].dropna().cov().to_numpy(), rtol=1e-6)


def test_two_hundred_features_of_lineitem(spark):
    """No row is exploded into pairs, and the result is that of numpy."""
    parts = ["l_quantity * {0}", "l_extendedprice % (100.0 + {0})", "CASE WHEN l_linenumber % 2 = 1 THEN l_discount * l_quantity + {0} END", "l_tax * (l_partkey % ({0} + 2))"]
    cols = [f"f{i}" for i in range(200)]
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    df = li.selectExpr(*[f"cast({parts[i % 4].format(i + 1)} as double) AS {c}" for i, c in enumerate(cols)])
    got = gram(df, cols).correlation()
    x = df.toPandas()
    want = x.corr().to_numpy()
    ok = ~np.isnan(want)
    np.testing.assert_allclose(got[ok], want[ok], atol=1e-8)


def test_no_row_gives_no_correlation(spark):
    df = spark.createDataFrame([], "a double, b double")
    for run in (stats.corr_pearson, stats.corr_spearman):
        assert [r.r for r in run(df, ["a", "b"]).collect()] == [None] * 4
    assert kendall.kendall_pairs(df, [("a", "b")]) == [(None, 0)]


def jobs(spark, run) -> int:
    tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    run()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext._jsc.clearJobGroup()
    return n


@pytest.mark.parametrize("run", [lambda d, c: kendall.kendall_matrix(d, c), lambda d, c: rank_gram(d, c), lambda d, c: gram(d, c)])
def test_jobs_do_not_grow_with_the_columns(spark, data, run):
    df = spark.createDataFrame(data[["a", "b", "ties", "last", "far", "sided"]].head(200))
    few, many = (jobs(spark, lambda c=c: run(df, c)) for c in (["a", "b", "ties"], ["a", "b", "ties", "last", "far", "sided"]))
    assert 0 < many <= few + 2
