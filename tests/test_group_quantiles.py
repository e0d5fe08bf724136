"""Quantiles per group by brackets: exact for hot groups, ties, nulls and NaN, and no value map of a large group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalis.operators import features, metrics, signal_ops, stats
from vitalis.operators.quantiles import grouped_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.5, 1 / 3, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(1)
    n = 12000
    g = r.integers(0, 5, n)
    g[: n // 2] = 7
    x = r.normal(size=n)
    x[r.random(n) < 0.3] = 0.25  # a value that holds many ranks
    y = np.where(g == 7, np.floor(x * 2), x)  # few values in the hot group
    y[r.random(n) < 0.05] = np.nan
    y[g == 3] = np.nan
    return pd.DataFrame({"g": g, "x": x, "y": y})


@pytest.mark.parametrize("small, grid", [(10**9, 64), (3000, 1024), (60, 32)])
def test_grouped_quantiles_are_exact(spark, data, small, grid):
    df = spark.createDataFrame(data).withColumn("g", F.when(F.col("g") != 4, F.col("g")))  # a null key is a group
    got = grouped_quantiles(df, ["g"], {"qx": "x", "qy": "y"}, PROBS, small=small, grid=grid).collect()
    assert sorted((r.g is not None, r.g) for r in got) == [(False, None), *((True, k) for k in (0, 1, 2, 3, 7))]
    for r in got:
        own = data[data.g == (4 if r.g is None else r.g)]
        for q, v in ((r.qx, own.x), (r.qy, own.y.dropna())):
            if len(v):
                assert q == pytest.approx(list(np.quantile(v, PROBS)), abs=1e-12)
            else:
                assert q is None


def test_grouped_quantiles_of_no_row(spark):
    df = spark.createDataFrame([], "g int, x double")
    assert grouped_quantiles(df, ["g"], {"q": "x"}, [0.5]).count() == 0
    assert grouped_quantiles(spark.createDataFrame([(1, None)], "g int, x double"), ["g"], {"q": "x"}, [0.5]).first().q is None


def test_large_groups_are_not_counted_by_value(spark, data):
    """The one aggregate that maps values to counts is fed by the groups of at most ``small`` values."""
    df = spark.createDataFrame(data)
    plan = grouped_quantiles(df, ["g"], {"q": "x"}, [0.5], small=3000)._jdf.queryExecution().optimizedPlan().toString()
    union = plan.split("Union")[1]
    small = union.split("percentile(")[1]
    assert plan.count("percentile(") == 1 and "isnull(_g" in small.split("\n\n")[0]


def test_callers_take_the_grouped_quantiles(spark, data, monkeypatch):
    """Box statistics, entity statistics, baselines, quality summaries and error medians agree with numpy for selected groups."""
    import vitalis.operators.quantiles as Q

    defaults = Q.grouped_quantiles.__defaults__
    monkeypatch.setattr(Q.grouped_quantiles, "__defaults__", (100, 64))
    try:
        df = spark.createDataFrame(data)
        by = data.groupby("g")
        box = {r.g: r for r in stats.box_stats(df, "g", "x").collect()}
        ent = {r.g: r for r in stats.entity_stats(df, "g", "x").collect()}
        qual = {r.g: r for r in signal_ops.quality_summary(df, "g", "x").collect()}
        err = {r.g: r for r in metrics.regression_metrics(df.withColumn("p", F.lit(0.0)), "x", "p", by=["g"]).collect()}
        base = features.group_baseline(df.withColumn("d", F.lit(1.0)), "g", {"x": "x_resp"}, ("x", "d", "ratio", "norm")).select("g", "ratio", "norm")
        norm = {r.g: r for r in base.dropDuplicates(["g"]).collect()}
        for g, own in by:
            q = np.quantile(own.x, [0.25, 0.5, 0.75])
            assert (box[g].q1, box[g].median, box[g].q3) == pytest.approx(tuple(q))
            assert ent[g].median == qual[g].median == pytest.approx(q[1])
            assert err[g].median_ae == pytest.approx(np.median(np.abs(own.x)))
            med = np.median(own.x / (1 + 1e-6))
            assert norm[g].norm == pytest.approx(norm[g].ratio / (med + 1e-6))
    finally:
        Q.grouped_quantiles.__defaults__ = defaults
