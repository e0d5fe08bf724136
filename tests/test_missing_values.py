"""NaN is missing, like NULL, in every operator that takes numbers; empty sequences and windows have results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.operators import clean, features, stats

X = [float(i) for i in range(1, 20)]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, "e" if i % 2 else "f", x, 2 * x) for i, x in enumerate(X)]
    nan, null = ([*rows, (99, "e", v, 1.0)] for v in (math.nan, None))
    return [spark.createDataFrame(r, "id long, g string, x double, y double") for r in (nan, null)]


def same(frames, run, key="id"):
    got = [sorted((tuple(r) for r in run(d).collect()), key=repr) for d in frames]
    assert repr(got[0]) == repr(got[1])
    return got[0]


def test_profile_counts_nan_as_missing(frames):
    got = {r[0]: r for r in same(frames, lambda d: stats.profile_table(d, ["x", "y"]))}
    assert got["x"][2] == 1 and got["x"][4:8] == pytest.approx((1.0, 19.0, 10.0, 10.0))
    assert same(frames, stats.profile_totals)[0][2] == 1


def test_anomalies_of_a_column_with_nan(spark):
    rows = [(i, float(i % 3)) for i in range(30)] + [(30, 1000.0), (31, math.nan)]
    got = stats.zscore_anomalies(spark.createDataFrame(rows, "id long, x double"), ["x"], "id").collect()
    assert [r.row_id for r in got] == [30]


@pytest.mark.parametrize("method", ["zscore", "iqr"])
def test_outlier_removal_keeps_the_other_rows(frames, method):
    for d in frames:
        assert clean.remove_outliers(d, ["x"], method).count() == len(X)


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_scaling_passes_over_nan(frames, method):
    got = same(frames, lambda d: clean.Scaler(["x"], method).fit(d).transform(d).select("id", "x"))
    v = [r[1] for r in got if r[0] != 99]
    assert not any(math.isnan(a) for a in v) and dict(got)[99] is None


def test_distribution_and_histogram(frames):
    (got,) = same(frames, lambda d: stats.distribution_summary(d, ["x"]))
    assert got[1:4] == pytest.approx((10.0, 10.0, np.std(X, ddof=1)))
    bins = same(frames, lambda d: stats.histogram(d, "x", 4).select("bin", "n"))
    assert bins == [(0, 5), (1, 4), (2, 5), (3, 5)]


def test_entity_scores_and_baselines(frames):
    got = {r[0]: r[1] for r in same(frames, lambda d: features.entity_zscore(d, "g", ["x"]).select("id", "x_pilot_norm"))}
    assert got[99] is None and sum(v is not None for v in got.values()) == len(X)
    base = {r[0]: r[1] for r in same(frames, lambda d: features.group_baseline(d, "g", {"x": "d"}).select("id", F.when(F.col("id") != 99, F.col("d"))))}
    assert sum(v for k, v in base.items() if k != 99) == pytest.approx(0)


def test_entity_statistics(frames):
    got = {r[0]: r for r in same(frames, lambda d: stats.entity_stats(d, "g", "x"))}
    assert got["e"][1] == 9 and got["f"][1] == 10
