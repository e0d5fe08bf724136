"""Faults that were found by hand, each with the input that showed it; filters, batches, power transforms and linkage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.functions import signal as S
from vitalis.operators import clean, isoforest, ml, sequence, signal_ops, split

SEQ = "k int, seq array<array<double>>, seq_len int"


def test_empty_sequences_are_padded_and_pooled(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], 2), (2, [], 0), (3, [[5.0, 6.0]], 1)], SEQ)
    got = {r.k: r for r in sequence.masked_mean_pool(sequence.pad_sequences(df)).collect()}
    assert got[2].padded == [[0.0, 0.0]] * 2 and got[2].pooled is None
    assert got[1].pooled == [2.0, 3.0] and got[3].padded == [[5.0, 6.0], [0.0, 0.0]]
    none = spark.createDataFrame([(1, [], 0)], SEQ)
    assert sequence.pad_sequences(none).first().padded == []
    assert sequence.pad_sequences(none.limit(0)).count() == 0


def test_batches_of_like_length_pad_little(spark):
    r = np.random.default_rng(3)
    n = np.concatenate([r.integers(1, 12, 300), r.integers(100, 400, 6), [0, 0]])
    df = spark.createDataFrame([(i, [[1.0, 1.0]] * int(m), int(m)) for i, m in enumerate(n)], SEQ)
    rows = sequence.pad_batches(df, ["k"], 16).collect()
    assert len(rows) == len(n) and max(r.batch for r in rows) == -(-len(n) // 16) - 1
    for b in {r.batch for r in rows}:
        own = [r for r in rows if r.batch == b]
        assert len({len(r.padded) for r in own}) == 1 and len(own[0].padded) == max(r.seq_len for r in own)
    assert sum(len(r.padded) for r in rows if len(r.padded) < 100) <= 1.2 * sum(r.seq_len for r in rows if len(r.padded) < 100)
    whole = sequence.pad_sequences(df).select(F.sum(F.size("padded"))).first()[0]
    assert sum(len(r.padded) for r in rows) < 0.2 * whole


def test_time_series_folds_need_rows(spark):
    with pytest.raises(ValueError):
        split.timeseries_split(spark.range(5), ["id"], 5)
    assert split.timeseries_split(spark.range(6), ["id"], 5).where("role = 'test'").count() == 5


def test_windows_with_missing_samples_have_no_quality(spark):
    v = [float(i % 5) for i in range(64)]
    rows = [(1, v), (2, [*v[:-1], math.nan]), (3, [*v[:-1], None]), (4, [math.nan] * 64), (5, [1.0])]
    for kind in ("ppg", "eda", "temp"):
        got = {r.i: r.q.quality_score for r in signal_ops.signal_quality(spark.createDataFrame(rows, "i int, v array<double>"), "v", 64.0, kind, "q").collect()}
        assert got[1] is not None and [got[i] for i in (2, 3, 4, 5)] == [None] * 4


def test_labels_keep_their_type(spark, tmp_path):
    rows = [(i, float(i % 3), float(i), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    m = ml.TabularModel("rf", "classification", {"n_estimators": 5}).fit(df, ["a", "b"], "y")
    got = m.transform(df)
    assert dict(got.dtypes)["y"] == dict(got.dtypes)["y_pred"] == "int"
    assert m.evaluate(df).first()["accuracy"] == 1.0
    m.save(str(tmp_path / "m"))
    again = ml.TabularModel.load(str(tmp_path / "m")).transform(df)
    assert again.select("id", "y_pred").collect() == got.select("id", "y_pred").collect()


def test_isolation_forest_removes_the_far_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, *map(float, x)) for i, x in enumerate(r.normal(size=(200, 2)))] + [(200, 40.0, 40.0), (201, None, 0.0), (202, math.nan, 0.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    kept = {r.id for r in clean.remove_outliers(df, ["a", "b"], "isolation_forest", row_id="id", contamination=0.02).collect()}
    assert not kept & {200, 201, 202} and len(kept) == 201 - 4
    scored = isoforest.isolation_forest(df, ["a", "b"], "id", 0.02).collect()
    assert {r.id for r in scored if r.is_outlier} >= {200} and [r.anomaly_score for r in scored if r.id > 200] == [None, None]
    cut = np.quantile([r.anomaly_score for r in scored if r.anomaly_score is not None], 0.98)
    assert all(r.is_outlier == (r.anomaly_score > cut + 1e-15) for r in scored if r.anomaly_score is not None and abs(r.anomaly_score - cut) > 1e-9)
    with pytest.raises(ValueError):
        clean.remove_outliers(df, ["a"], "isolation_forest")


@pytest.mark.parametrize("lam", [5.0, -4.0, 9.5, 0.5])
def test_box_cox_finds_lambdas_beyond_two(spark, lam):
    z = np.random.default_rng(4).normal(size=3000) * 0.05 * abs(lam) + lam * 1.0
    x = (np.maximum(1 + lam * (z / lam), 1e-3)) ** (1 / lam) if lam > 0 else (1 + np.abs(lam) * np.exp(z * 0.1)) ** (1 / lam)
    got = clean.PowerTransformer(["x"], "box-cox").fit(spark.createDataFrame([(float(a),) for a in [*x, math.nan]], "x double")).lambdas_["x"]

    def ll(v):
        t = np.log(x) if abs(v) < 1e-12 else (x ** v - 1) / v
        return -len(x) / 2 * np.log(t.var()) + (v - 1) * np.log(x).sum()

    grid = np.round(np.arange(-30, 30, 0.01), 2)
    assert got == pytest.approx(grid[np.argmax([ll(v) for v in grid])], abs=0.0101)


@pytest.mark.parametrize("btype, cutoff, quiet, passed", [("lowpass", 5.0, 31.9, 0.0), ("highpass", 5.0, 0.0, 31.99), ("bandpass", (2.0, 8.0), 0.0, None), ("bandstop", (2.0, 8.0), None, 0.0)])
def test_butterworth_gains(btype, cutoff, quiet, passed):
    b, a = S.butter(4, cutoff, btype, 64.0)

    def gain(f):
        z = np.exp(2j * np.pi * f / 64.0)
        return abs(np.polyval(b, z) / np.polyval(a, z))

    assert all(gain(f) == pytest.approx(1 / math.sqrt(2)) for f in np.atleast_1d(cutoff))
    assert np.all(np.abs(np.roots(a)) < 1)
    assert quiet is None or gain(quiet) < 1e-4
    assert passed is None or gain(passed) == pytest.approx(1.0, abs=1e-6)


def test_filter_state_at_rest_stays():
    b, a = S.butter(3, (0.5, 3.5), "bandpass", 64.0)
    b, a = b + 0.1, a
    y = S.lfilter(b, a, np.ones((1, 50)), S.lfilter_zi(b, a)[None, :])
    np.testing.assert_allclose(y, b.sum() / a.sum(), rtol=1e-6)


def test_linkage_by_chains_equals_a_plain_version():
    r = np.random.default_rng(5)
    for p in (1, 2, 3, 12, 40):
        x = r.normal(size=(p, 4))
        D = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        clusters, heights, groups = {i: [i] for i in range(p)}, [], []
        while len(clusters) > 1:
            h, a, b = min((D[np.ix_(clusters[a], clusters[b])].mean(), a, b) for a in clusters for b in clusters if a < b)
            new = p + len(heights)
            clusters[new] = clusters.pop(a) + clusters.pop(b)
            heights.append(h)
            groups.append(frozenset(clusters[new]))
        got, members = ml.linkage(D), {i: [i] for i in range(p)}
        for n, (a, b, _) in enumerate(got):
            members[p + n] = members[a] + members[b]
        assert [m[2] for m in got] == pytest.approx(heights) and [frozenset(members[p + n]) for n in range(p - 1)] == groups
    big = r.normal(size=(500, 3))
    assert len(ml.linkage(np.sqrt(((big[:, None] - big[None]) ** 2).sum(-1)))) == 499
