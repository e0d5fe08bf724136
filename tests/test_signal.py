"""Signal kernels and their Spark wrappers: invariants and numpy cross-checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalis.functions import signal as S
from vitalis.operators import sequence, signal_ops


def _frame(spark, arrays):
    return spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(arrays)], "id int, v array<double>")


def test_butter_reference_values():
    b, a = S.butter(2, 16.0, "lowpass", 64.0)   # wn = 0.5
    assert np.allclose(b, [0.29289322, 0.58578644, 0.29289322], atol=1e-7)
    assert np.allclose(a, [1.0, 0.0, 0.17157288], atol=1e-7)


@pytest.mark.parametrize("btype,cut", [("lowpass", 5.0), ("highpass", 5.0), ("bandpass", (0.5, 3.5)), ("bandstop", (5, 10))])
def test_butter_gains(btype, cut):
    b, a = S.butter(4, cut, btype, 64.0)
    def gain(f):
        z = np.exp(-1j * np.pi * f / 32.0)
        return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))
    if btype == "lowpass":
        assert gain(0.0) == pytest.approx(1.0) and gain(5.0) == pytest.approx(2 ** -0.5, rel=1e-6)
    elif btype == "highpass":
        assert gain(31.99) == pytest.approx(1.0, rel=1e-3) and gain(5.0) == pytest.approx(2 ** -0.5, rel=1e-6)
    elif btype == "bandpass":
        assert gain(0.5) == pytest.approx(2 ** -0.5, rel=1e-6) and gain(3.5) == pytest.approx(2 ** -0.5, rel=1e-6)
    else:
        assert gain(0.0) == pytest.approx(1.0) and gain(7.07) < 1e-2


def test_filtfilt_invariants():
    b, a = S.butter(4, 5.0, "lowpass", 64.0)
    const = np.full((1, 300), 3.0)
    assert np.abs(S.filtfilt(b, a, const) - 3.0).max() < 1e-12
    t = np.arange(640) / 64.0
    slow, fast = np.sin(2 * np.pi * 1.0 * t), np.sin(2 * np.pi * 20.0 * t)
    y = S.filtfilt(b, a, np.vstack([slow, fast]))
    assert np.abs(y[0] - slow)[64:-64].max() < 1e-4      # passes with zero phase (no lag)
    assert np.abs(y[1])[64:-64].max() < 1e-4             # stop band removed
    assert S.filtfilt(b, a, np.ones((1, 15))) is None     # not longer than the padding (3 * 5 taps)


def test_dwt_matches_direct_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=37)
    ca, cd = S.dwt(x[None, :])
    L = len(S.DB4_DEC_LO)
    ext = np.pad(x, (L - 1, L - 1), mode="symmetric")
    out_len = (len(x) + L - 1) // 2
    direct_a = [sum(S.DB4_DEC_LO[j] * ext[2 * k + 1 - j + L - 1] for j in range(L)) for k in range(out_len)]
    direct_d = [sum(S.DB4_DEC_HI[j] * ext[2 * k + 1 - j + L - 1] for j in range(L)) for k in range(out_len)]
    assert np.allclose(ca[0], direct_a) and np.allclose(cd[0], direct_d)
    # low-pass taps sum to sqrt(2), squares to 1; a constant signal has no detail
    assert S.DB4_DEC_LO.sum() == pytest.approx(np.sqrt(2)) and (S.DB4_DEC_LO ** 2).sum() == pytest.approx(1.0)
    _, d_const = S.dwt(np.full((1, 40), 2.0))
    assert np.abs(d_const).max() < 1e-12


def test_quality_metrics_edge_cases():
    q = S.quality_metrics(np.full((1, 64), 5.0), 64.0, "ppg")
    assert q["snr"][0] == 0.0 and q["flatline_ratio"][0] == 1.0
    t = np.arange(64) / 64.0
    q = S.quality_metrics(np.sin(2 * np.pi * 2 * t)[None, :], 64.0, "ppg")
    assert q["band_power_ratio"][0] == pytest.approx(1.0) and q["quality_score"][0] == pytest.approx(1.0)
    q = S.quality_metrics(np.sin(2 * np.pi * 2 * t)[None, :], 64.0, "temp")
    assert q["quality_score"][0] == pytest.approx(1 - np.std(np.sin(2 * np.pi * 2 * t)))


def test_spark_wrappers_handle_mixed_lengths_and_nulls(spark):
    t = np.arange(128) / 64.0
    arrays = [np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 2 * t[:64]), [1.0], []]
    df = _frame(spark, arrays).union(spark.createDataFrame([(9, None)], "id int, v array<double>"))
    bp = signal_ops.band_power(df, "v", 64.0, 0.5, 3.5).select("id", "bp.*").toPandas().set_index("id")
    assert bp.loc[0, "band_power"] == pytest.approx(bp.loc[0, "total_power"])
    assert np.isnan(bp.loc[9, "band_power"]) or bp.loc[9, "band_power"] is None
    f = signal_ops.butterworth(df, "v", 64.0, 5.0, "lowpass", 4, "f").toPandas().set_index("id")
    assert f.loc[0, "f"] is not None and f.loc[2, "f"] is None and f.loc[9, "f"] is None
    w = signal_ops.wavelet_features(df.where("id = 0"), "v").select("wavelet.*").first()
    assert len(w) == 20


def test_spectrogram_peak_frequency(spark):
    t = np.arange(512) / 64.0
    df = _frame(spark, [np.sin(2 * np.pi * 8.0 * t)])
    sp = signal_ops.spectrogram(df, ["id"], "v", 64.0, 64, 32).toPandas()
    peak = sp.loc[sp.groupby("seg")["db"].idxmax(), "freq"].unique()
    assert list(peak) == [8.0]
    assert sorted(sp["seg"].unique()) == list(range((512 - 64) // 32 + 1))


def test_array_smoothers_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=40)
    df = _frame(spark, [x])
    r = df.select(signal_ops.moving_average(F.col("v"), 16).alias("ma"), signal_ops.median_filter(F.col("v"), 5).alias("md"),
                  signal_ops.detrend(F.col("v")).alias("dt")).first()
    assert np.allclose(r["ma"], np.convolve(x, np.ones(16) / 16, mode="same"))
    pad = np.concatenate([[0, 0], x, [0, 0]])
    assert np.allclose(r["md"], [np.median(pad[i:i + 5]) for i in range(len(x))])
    i = np.arange(len(x))
    slope, icpt = np.polyfit(i, x, 1)
    assert np.allclose(r["dt"], x - (slope * i + icpt))


def test_median_filter_even_kernel_widens(spark):
    df = _frame(spark, [[1.0, 9.0, 2.0, 8.0, 3.0]])
    r = df.select(signal_ops.median_filter(F.col("v"), 4).alias("m")).first()["m"]
    pad = np.array([0, 0, 1, 9, 2, 8, 3, 0, 0.0])
    assert r == [float(np.median(pad[i:i + 5])) for i in range(5)]


def test_sliding_frames_counts(spark):
    df = _frame(spark, [np.arange(10.0), np.arange(3.0)])
    fr = signal_ops.sliding_frames(df, ["id"], "v", 4, 3).toPandas()
    assert list(fr["start"]) == [0, 3, 6] and list(fr["end"]) == [4, 7, 10]


def test_sequences_pad_and_pool(spark):
    rows = [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("a", 2, []), ("b", 0, [5.0, 6.0])]
    w = spark.createDataFrame(rows, "t string, idx int, vec array<double>")
    s = sequence.build_sequences(w, ["t"], "idx", "vec", max_len=5, drop_empty=True)
    p = sequence.pad_sequences(s)
    got = {r["t"]: r for r in sequence.masked_mean_pool(p, "padded", "seq_len", 2).collect()}
    assert got["a"]["seq_len"] == 2 and got["b"]["padded"] == [[5.0, 6.0], [0.0, 0.0]]
    assert got["a"]["pooled"] == [2.0, 3.0] and got["b"]["pooled"] == [5.0, 6.0]
    long = sequence.to_long(w.where(F.size("vec") > 0), ["t"], "idx", "vec")
    a1 = sequence.augment_noise(long, ["t"]).orderBy("t", "idx", "dim").collect()
    a2 = sequence.augment_noise(long, ["t"]).orderBy("t", "idx", "dim").collect()
    assert a1 == a2 and any(r1["value"] != r0["value"] for r1, r0 in zip(a1, long.orderBy("t", "idx", "dim").collect()))
    mm = sequence.sequence_minmax(w.where(F.size("vec") > 0), ["t"], "idx", "vec").where("t = 'b'").collect()
    assert all(r["value"] == 0.0 for r in mm)   # range 0 -> divisor 1


def test_adaptive_filter_routes_by_quality(spark):
    t = np.arange(256) / 64.0
    clean = np.sin(2 * np.pi * 1.5 * t)
    noisy = np.random.default_rng(0).normal(size=256)
    out = signal_ops.adaptive_filter(_frame(spark, [clean, noisy]), "v", 64.0, "ppg", 0.7).toPandas().set_index("id")
    assert len(out.loc[0, "filtered"]) == 256 and len(out.loc[1, "filtered"]) == 256
    assert np.corrcoef(out.loc[0, "filtered"][32:-32], clean[32:-32])[0, 1] > 0.99
    assert sorted(out.index) == [0, 1]
