"""Signal operators as jobs over a window table (one row per window, samples in an array).

Two layouts, converted with ``explode`` / ``collect``:
* array layout ``(window keys..., v array<double>)`` for spectra, filters and
  wavelets (Arrow UDFs: equal-length windows of a batch are stacked and
  processed by one numpy call) and for row-local smoothing expressions;
* long layout ``(window keys..., i, x)`` for SQL aggregates.

Parallelism is the number of windows; a single long recording should be cut
into windows first (``sliding_frames``), never handled as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vitalis import ship_package
from vitalis.functions import signal as S
from vitalis.functions.columns import entity_category
from vitalis.operators.gram import value
from vitalis.operators.ordering import join_null_safe
from vitalis.operators.quantiles import grouped_quantiles
from vitalis.operators.stats import quantile

# Default sampling rates (Hz) per signal type.
SAMPLING_RATES = {"ppg": 64.0, "eda": 4.0, "tonic": 4.0, "accel": 32.0, "temp": 4.0}


def _by_length(s: pd.Series, fn, n_out: int | None = None):
    """Apply ``fn(matrix) -> matrix|vector`` to groups of equal-length arrays of a batch."""
    lengths = s.map(lambda a: -1 if a is None else len(a))
    results: list = [None] * len(s)
    for L in lengths.unique():
        if L < 0:
            continue
        idx = np.nonzero((lengths == L).to_numpy())[0]
        mat = np.vstack([np.asarray(s.iloc[i], dtype=np.float64) for i in idx]) if L > 0 else np.zeros((len(idx), 0))
        res = fn(mat)
        for j, i in enumerate(idx):
            results[i] = None if res is None else res[j]
    return results


# ------------------------------------------------------------------ I1 / I2

def band_power(df: DataFrame, v: str, fs: float, lo: float, hi: float, out: str = "bp") -> DataFrame:
    """Struct ``out``: band_power (|rfft|^2/n summed over lo <= f <= hi) and total_power."""
    ship_package(df.sparkSession)
    schema = StructType([StructField("band_power", DoubleType()), StructField("total_power", DoubleType())])

    @F.pandas_udf(schema)
    def udf(s: pd.Series) -> pd.DataFrame:
        def fn(m):
            if m.shape[1] == 0:
                return None
            bp, tot = S.band_power(m, fs, lo, hi)
            return np.stack([bp, tot], axis=1)
        r = _by_length(s, fn)
        return pd.DataFrame([(None, None) if x is None else tuple(x) for x in r],
                            columns=["band_power", "total_power"])

    return df.withColumn(out, udf(F.col(v)))


QUALITY_FIELDS = {
    "ppg": ["snr", "band_snr", "band_power_ratio", "flatline_ratio", "extreme_ratio", "quality_score"],
    "eda": ["snr", "band_snr", "band_power_ratio", "flatline_ratio", "quality_score"],
    "other": ["snr", "quality_score"],
}


def signal_quality(df: DataFrame, v: str, fs: float, kind: str = "ppg", out: str = "quality") -> DataFrame:
    """Struct of quality metrics per window (see ``functions.signal.quality_metrics``); all NULL for a window
    with a NULL, NaN or infinite sample, or fewer than two."""
    ship_package(df.sparkSession)
    fields = QUALITY_FIELDS.get(kind, QUALITY_FIELDS["other"])
    schema = StructType([StructField(f, DoubleType()) for f in fields])

    @F.pandas_udf(schema)
    def udf(s: pd.Series) -> pd.DataFrame:
        def fn(m):
            if m.shape[1] < 2:
                return None
            q = S.quality_metrics(m, fs, kind)
            whole = np.isfinite(m).all(axis=1)
            return [x if ok else None for x, ok in zip(np.stack([q[f] for f in fields], axis=1), whole, strict=True)]
        r = _by_length(s, fn)
        return pd.DataFrame([(None,) * len(fields) if x is None else tuple(x) for x in r], columns=fields)

    return df.withColumn(out, udf(F.col(v)))


# ------------------------------------------------------------------ I3 / I4

def butterworth(df: DataFrame, v: str, fs: float, cutoff, btype: str = "lowpass", order: int = 4,
                out: str | None = None) -> DataFrame:
    """Zero-phase Butterworth filter of each window; windows not longer than the padding give NULL.

    The coefficients are designed once on the driver (a handful of numbers) and
    shipped in the UDF closure.
    """
    ship_package(df.sparkSession)
    b, a = S.butter(order, cutoff, btype, fs)

    @F.pandas_udf(ArrayType(DoubleType()))
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series(_by_length(s, lambda m: S.filtfilt(b, a, m) if m.shape[1] else None), dtype=object)

    return df.withColumn(out or v, udf(F.col(v)))


def filter_report(df: DataFrame, v: str, fs: float, cutoff, btype: str = "lowpass", order: int = 4) -> DataFrame:
    """One row: windows, those missing, and those not longer than the padding, which ``butterworth`` leaves NULL."""
    b, a = S.butter(order, cutoff, btype, fs)
    pad = 3 * max(len(a), len(b))
    n = F.size(v)
    return df.agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col(v).isNull()).alias("n_missing"),
                  F.count_if(F.col(v).isNotNull() & (n <= pad)).alias("n_short"), F.lit(pad).cast("bigint").alias("padding"))


# Adaptive filter settings per signal type, (btype, cutoff, order) for the light and strong branch.
ADAPTIVE_LIGHT = {"ppg": ("bandpass", (0.5, 3.5), 3), "eda": ("lowpass", 1.0, 2), "temp": ("lowpass", 0.1, 2)}
ADAPTIVE_STRONG = {"ppg": ("bandpass", (0.7, 2.5), 4), "eda": ("lowpass", 0.5, 3), "temp": ("lowpass", 0.05, 3)}


def adaptive_filter(df: DataFrame, v: str, fs: float, kind: str = "ppg", threshold: float = 0.7,
                    out: str = "filtered") -> DataFrame:
    """Light filtering for windows with quality >= threshold, strong filtering (+ smoothing,
    detrending or median filtering by type) otherwise, also for windows without a quality; other types pass through."""
    q = signal_quality(df, v, fs, kind, "_q")
    if kind not in ADAPTIVE_LIGHT:
        return q.withColumn(out, F.col(v)).drop("_q")
    lb, lc, lo = ADAPTIVE_LIGHT[kind]
    sb, sc, so = ADAPTIVE_STRONG[kind]
    light = butterworth(q, v, fs, lc, lb, lo, "_light")
    strong = butterworth(light, v, fs, sc, sb, so, "_strong")
    if kind == "ppg":
        post = moving_average(F.col("_strong"), max(1, int(fs * 0.25)))
    elif kind == "eda":
        post = detrend(F.col("_strong"))
    else:
        post = median_filter(F.col("_strong"), int(fs * 1.0))
    good = F.col("_q.quality_score") >= threshold
    return strong.withColumn(out, F.when(good, F.col("_light")).otherwise(post)).drop("_q", "_light", "_strong")


# ------------------------------------------------------------------ I5 / I6

WAVELET_NAMES = [f"{band}_{stat}" for band in ("cA3", "cD3", "cD2", "cD1")
                 for stat in ("mean", "std", "max", "min", "median")]


def wavelet_features(df: DataFrame, v: str, level: int = 3, out: str = "wavelet") -> DataFrame:
    """db4 level-3 decomposition (symmetric extension) -> 20 statistics as a struct."""
    ship_package(df.sparkSession)
    names = WAVELET_NAMES if level == 3 else [f"f{i}" for i in range(5 * (level + 1))]
    schema = StructType([StructField(n, DoubleType()) for n in names])

    @F.pandas_udf(schema)
    def udf(s: pd.Series) -> pd.DataFrame:
        r = _by_length(s, lambda m: S.wavelet_features(m, level) if m.shape[1] else None)
        return pd.DataFrame([(None,) * len(names) if x is None else tuple(x) for x in r], columns=names)

    return df.withColumn(out, udf(F.col(v)))


def spectrogram(df: DataFrame, keys: Sequence[str], v: str, fs: float, nperseg: int = 256,
                noverlap: int = 128, alpha: float = 0.25) -> DataFrame:
    """Rows (keys, seg, seg_time, freq, db): Tukey-windowed, mean-removed segments, 'spectrum' scaling.

    Segments come from ``sliding_frames``; each segment's spectrum is one Arrow
    UDF call per batch; bins are exploded to rows.  Zero power gives NULL dB.
    """
    ship_package(df.sparkSession)
    step = nperseg - noverlap
    frames = sliding_frames(df, keys, v, nperseg, step)
    win = S.tukey(nperseg, alpha)

    @F.pandas_udf(ArrayType(DoubleType()))
    def spec(s: pd.Series) -> pd.Series:
        return pd.Series(_by_length(s, lambda m: S.segment_spectrum(m, win) if m.shape[1] == nperseg else None),
                         dtype=object)

    sp = frames.withColumn("_p", spec(F.col("frame")))
    e = sp.select(*keys, F.col("frame_idx").alias("seg"), F.posexplode("_p").alias("bin", "power"))
    seg_time = (F.col("seg") * step + nperseg / 2.0) / F.lit(fs)
    db = F.when(F.col("power") > 0, 10 * F.log10(F.col("power")))
    return e.select(*keys, "seg", seg_time.alias("seg_time"), (F.col("bin") * F.lit(fs / nperseg)).alias("freq"),
                    db.alias("db"))


# ------------------------------------------------------------------ E4 / E17

def sliding_frames(df: DataFrame, keys: Sequence[str], v: str, w: int, step: int) -> DataFrame:
    """Frames of ``w`` samples every ``step`` samples: count (n - w)//step + 1, end = min(start + w, n)."""
    n = F.size(v)
    starts = F.sequence(F.lit(0), n - w, F.lit(step))
    e = df.where(n >= w).select(*keys, F.col(v), F.posexplode(starts).alias("frame_idx", "start"))
    end = F.least(F.col("start") + w, F.size(v))
    return e.select(*keys, "frame_idx", "start", end.alias("end"),
                    F.slice(F.col(v), F.col("start") + 1, end - F.col("start")).alias("frame"))


def time_windows(df: DataFrame, ts: str, size: str, step: str, keys: Sequence[str] = (),
                 value: str | None = None, watermark: str | None = None) -> DataFrame:
    """Time-stamped hopping windows (``F.window``); with ``watermark`` it runs on a stream."""
    if watermark:
        # watermarks need a zone-aware event time; naive timestamps are read in the session time zone
        if df.schema[ts].dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(ts, F.col(ts).cast("timestamp"))
        df = df.withWatermark(ts, watermark)
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.avg(value).alias("mean"))
    g = df.groupBy(*keys, F.window(F.col(ts), size, step).alias("w")).agg(*aggs)
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[a for a in ["n", "mean"]
                                                                                           if a in g.columns])


def sample_times(df: DataFrame, keys: Sequence[str], v: str, fs: float) -> DataFrame:
    """Long layout with the time axis i / fs."""
    e = df.select(*keys, F.posexplode(v).alias("i", "x"))
    return e.withColumn("t", F.col("i") / F.lit(fs))


# ------------------------------------------------------------------ E5 / E6 / E7 (row-local array expressions)

def moving_average(arr: Column, w: int) -> Column:
    """Centred moving average with zero padding, output length n (``convolve(..., 'same')`` for w <= n)."""
    left = w // 2
    pad = F.concat(F.array_repeat(F.lit(0.0), left), arr, F.array_repeat(F.lit(0.0), w - 1 - left))
    return F.transform(arr, lambda x, i: F.aggregate(F.slice(pad, i + 1, w), F.lit(0.0), lambda a, y: a + y) / w)


def median_filter(arr: Column, k: int) -> Column:
    """Zero-padded running median; an even kernel is widened to the next odd size."""
    if k % 2 == 0:
        k += 1
    h = k // 2
    pad = F.concat(F.array_repeat(F.lit(0.0), h), arr, F.array_repeat(F.lit(0.0), h))
    return F.transform(arr, lambda x, i: F.get(F.sort_array(F.slice(pad, i + 1, k)), h))


def detrend(arr: Column) -> Column:
    """Remove the least-squares line over the sample index (closed form over array sums)."""
    n = F.size(arr).cast("double")
    sx = F.aggregate(arr, F.lit(0.0), lambda a, y: a + y)
    six = F.aggregate(F.transform(arr, lambda y, i: y * i), F.lit(0.0), lambda a, y: a + y)
    si = n * (n - 1) / 2
    sii = (n - 1) * n * (2 * n - 1) / 6
    den = n * sii - si * si
    slope = F.when(den != 0, (n * six - si * sx) / den).otherwise(F.lit(0.0))
    icpt = (sx - slope * si) / n
    return F.transform(arr, lambda y, i: y - (slope * i + icpt))


# ------------------------------------------------------------------ D16 / D17 / D18 / D37 / C2

def segment_stats(long: DataFrame, keys: Sequence[str], x: str = "x", exact: bool = True) -> DataFrame:
    """Per window: mean, population std, max, min, median, population skew, p25, p75."""
    xv = F.col(x).cast("double")
    q = quantile(xv, [0.25, 0.5, 0.75], exact)
    g = long.groupBy(*keys).agg(F.avg(xv).alias("mean"), F.stddev_pop(xv).alias("std"), F.max(xv).alias("max"),
                                F.min(xv).alias("min"), q.alias("_q"), F.skewness(xv).alias("skew"))
    return g.select(*keys, "mean", "std", "max", "min", F.col("_q")[1].alias("median"), "skew",
                    F.col("_q")[0].alias("p25"), F.col("_q")[2].alias("p75"))


def entity_signal_stats(long: DataFrame, entity: str, x: str = "x") -> DataFrame:
    xv = F.col(x).cast("double")
    return long.groupBy(entity).agg(F.avg(xv).alias("e_mean"), F.stddev_pop(xv).alias("e_std"))


def quality_summary(q: DataFrame, signal: str = "signal", score: str = "quality_score") -> DataFrame:
    s = value(score)
    g = q.groupBy(signal).agg(F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.count(s).alias("n"))
    median = grouped_quantiles(q, [signal], {"_q": s}, [0.5])
    return join_null_safe(g, median, [signal]).select(signal, "mean", F.col("_q")[0].alias("median"), "min", "max", "n")


def quality_by_condition(q: DataFrame, signal: str, condition: str, category: str,
                         score: str = "quality_score") -> DataFrame:
    """Mean and population std of the score by (signal, condition) and by (signal, category) in one pass."""
    s = F.col(score)
    g = q.groupingSets([[signal, condition], [signal, category]], signal, condition, category)
    out = g.agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.count(s).alias("n"),
                F.grouping(condition).alias("_no_condition"))
    by_condition = F.col("_no_condition") == 0
    dim = F.when(by_condition, F.lit("condition")).otherwise(F.lit("category"))
    val = F.when(by_condition, F.col(condition).cast("string")).otherwise(F.col(category).cast("string"))
    return out.select(signal, dim.alias("dim"), val.alias("value"), "mean", "std", "n")


def series_summary(long: DataFrame, signal: str, fs: float | dict, x: str = "x") -> DataFrame:
    """Per signal: mean, population std, min, max, samples, duration n/fs, and the common max duration."""
    xv = F.col(x).cast("double")
    g = long.groupBy(signal).agg(F.avg(xv).alias("mean"), F.stddev_pop(xv).alias("std"), F.min(xv).alias("min"),
                                 F.max(xv).alias("max"), F.count(xv).alias("n"))
    if isinstance(fs, dict):
        rate = F.create_map(*[y for kv in fs.items() for y in (F.lit(kv[0]), F.lit(float(kv[1])))])[F.col(signal)]
    else:
        rate = F.lit(float(fs))
    g = g.withColumn("duration", F.col("n") / rate)
    mx = g.agg(F.max("duration").alias("max_duration")).first()["max_duration"]  # one value per call
    return g.withColumn("max_duration", F.lit(mx).cast("double"))


def with_category(df: DataFrame, key: str, out: str = "category") -> DataFrame:
    return df.withColumn(out, entity_category(key))
