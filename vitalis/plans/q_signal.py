"""Signal, window-feature and sequence queries over the ``signals`` and ``trials`` views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.functions import signal as S
from vitalis.functions.columns import entity_category, md5_unit_sql
from vitalis.operators import features, sequence, signal_ops
from vitalis.operators.ordering import rank_in_group
from vitalis.plans import roles
from vitalis.plans.registry import out, register
from vitalis.plans.roles import with_ctes
from vitalis.plans.sqlhelp import rounded

FS = 64.0
_CAT_W = ("CASE WHEN CAST(window_id AS VARCHAR) LIKE '8%' THEN 'minimal_exp' "
          "WHEN CAST(window_id AS VARCHAR) LIKE '9%' THEN 'commercial' ELSE 'air_force' END")

# DFT oracle: power |X_k|^2 / n of every window, bins 0..n/2, frequency k * fs / n.
_DFT = f"""sl AS (SELECT window_id, condition, i, x, len(v) AS n FROM signals_long
              JOIN (SELECT window_id AS w2, v FROM signals) s ON s.w2 = window_id),
dft AS (SELECT sl.window_id, b.k, max(sl.n) AS n,
               sum(sl.x * cos(2 * pi() * sl.i * b.k / sl.n)) AS re, sum(sl.x * sin(2 * pi() * sl.i * b.k / sl.n)) AS im
        FROM sl, (SELECT unnest(range(0, 33)) AS k) b WHERE b.k <= sl.n // 2 GROUP BY sl.window_id, b.k),
pw AS (SELECT window_id, k, k * {FS} / n AS f, (re * re + im * im) / n AS p FROM dft)"""


@register("band_power", with_ctes(rounded(f"""WITH {_DFT}
SELECT window_id, sum(CASE WHEN f >= 0.5 AND f <= 3.5 THEN p ELSE 0.0 END) AS band_power, sum(p) AS total_power
FROM pw GROUP BY window_id""", ["band_power", "total_power"]), "signals_long", "signals"))
def q_band_power(spark, d):
    s = roles.signals_view(spark, d)
    bp = signal_ops.band_power(s, "v", FS, 0.5, 3.5)
    return out(bp.select("window_id", "bp.band_power", "bp.total_power"))


def _quality_sql(kind: str) -> str:
    band = "f >= 0.5 AND f <= 3.5" if kind == "ppg" else "f <= 0.5"
    score = ("(1 - flat) * 0.3 + (1 - ext) * 0.3 + least(ratio * 2, 1) * 0.4" if kind == "ppg"
             else "(1 - flat) * 0.4 + least(ratio * 2, 1) * 0.6")
    return f"""q_{kind} AS (
  SELECT '{kind}' AS signal, b.window_id, b.condition, {score} AS quality_score, m.snr, b.band_snr, b.ratio AS band_power_ratio,
         m.flat AS flatline_ratio, m.ext AS extreme_ratio
  FROM (SELECT window_id, any_value(condition) AS condition,
               CASE WHEN sum(CASE WHEN NOT ({band}) THEN p END) > 0
                    THEN sum(CASE WHEN {band} THEN p ELSE 0 END) / sum(CASE WHEN NOT ({band}) THEN p END) ELSE 0 END AS band_snr,
               CASE WHEN sum(p) > 0 THEN sum(CASE WHEN {band} THEN p ELSE 0 END) / sum(p) ELSE 0 END AS ratio
        FROM pw JOIN (SELECT window_id AS w3, condition FROM signals) c ON c.w3 = window_id GROUP BY window_id) b
  JOIN (SELECT window_id, CASE WHEN sd > 0 THEN mu / sd ELSE 0 END AS snr, flat, ext FROM (
          SELECT window_id, avg(x) AS mu, stddev_pop(x) AS sd,
                 count_if(dx = 0) / (count(*) - 1.0) AS flat,
                 count_if(abs(x - avg_x) > 3 * sd_x) / count(*) AS ext
          FROM (SELECT window_id, x, x - lag(x) OVER (PARTITION BY window_id ORDER BY i) AS dx,
                       avg(x) OVER (PARTITION BY window_id) AS avg_x, stddev_pop(x) OVER (PARTITION BY window_id) AS sd_x
                FROM signals_long) z GROUP BY window_id) y) m USING (window_id))"""


def _quality_frame(spark: SparkSession, d: str, kind: str) -> DataFrame:
    s = roles.signals_view(spark, d)
    q = signal_ops.signal_quality(s, "v", FS, kind)
    return q.select(F.lit(kind).alias("signal"), "window_id", "condition", "quality.*")


@register("signal_quality", with_ctes(rounded(f"""WITH {_DFT}, {_quality_sql('ppg')}
SELECT window_id, snr, band_snr, band_power_ratio, flatline_ratio, extreme_ratio, quality_score FROM q_ppg""",
    ["snr", "band_snr", "band_power_ratio", "flatline_ratio", "extreme_ratio", "quality_score"]),
    "signals_long", "signals"))
def q_signal_quality(spark, d):
    q = _quality_frame(spark, d, "ppg")
    return out(q.select("window_id", "snr", "band_snr", "band_power_ratio", "flatline_ratio", "extreme_ratio",
                        "quality_score"))


_QUAL_BOTH = f"""WITH {_DFT}, {_quality_sql('ppg')}, {_quality_sql('eda')},
qa AS (SELECT signal, window_id, condition, quality_score FROM q_ppg
       UNION ALL SELECT signal, window_id, condition, quality_score FROM q_eda)"""


def _both_quality(spark, d):
    p = _quality_frame(spark, d, "ppg").select("signal", "window_id", "condition", "quality_score")
    e = _quality_frame(spark, d, "eda").select("signal", "window_id", "condition", "quality_score")
    return p.unionByName(e)


@register("quality_summary", with_ctes(rounded(f"""{_QUAL_BOTH}
SELECT signal, avg(quality_score) AS mean, quantile_cont(quality_score, 0.5) AS median, min(quality_score) AS min,
       max(quality_score) AS max, count(quality_score) AS n FROM qa GROUP BY signal""",
    ["mean", "median", "min", "max"]), "signals_long", "signals"))
def q_quality_summary(spark, d):
    return out(signal_ops.quality_summary(_both_quality(spark, d)))


@register("quality_by_condition", with_ctes(rounded(f"""{_QUAL_BOTH}
SELECT signal, CASE WHEN condition IS NOT NULL THEN 'condition' ELSE 'category' END AS dim,
       coalesce(CAST(condition AS VARCHAR), category) AS value, avg(quality_score) AS mean,
       stddev_pop(quality_score) AS std, count(quality_score) AS n
FROM (SELECT *, {_CAT_W} AS category FROM qa) t
GROUP BY GROUPING SETS ((signal, condition), (signal, category))""", ["mean", "std"]), "signals_long", "signals"))
def q_quality_by_condition(spark, d):
    q = _both_quality(spark, d).withColumn("category", entity_category("window_id"))
    return out(signal_ops.quality_by_condition(q, "signal", "condition", "category"))


def _filtfilt_sql(src: str, arr: str, b, a, out: str) -> str:
    """Zero-phase IIR filter in SQL: odd extension, two recursive passes of the transposed direct form II
    with steady-state initial conditions, same operation order as the numpy kernel."""
    import numpy as np

    b = [float(x) / float(a[0]) for x in b]
    a = [float(x) / float(a[0]) for x in a]
    zi = [float(x) for x in S.lfilter_zi(np.array(b), np.array(a))]
    m = len(b) - 1
    pad = 3 * len(b)
    zs = ", ".join(f"z{i}" for i in range(m))
    def step(xe):
        y = f"({b[0]!r} * {xe} + f.z0)"
        upd = [f"{b[i + 1]!r} * {xe} + f.z{i + 1} - {a[i + 1]!r} * {y}" for i in range(m - 1)]
        upd.append(f"{b[m]!r} * {xe} - {a[m]!r} * {y}")
        return y, upd
    def rec(name, seq_col, srcname):
        y, upd = step(f"{srcname}.{seq_col}[f.t + 1]")
        init = ", ".join(f"{zi[i]!r} * {seq_col}[1]" for i in range(m))
        return f"""{name}(window_id, t, {zs}, ys) AS (
  SELECT window_id, 0, {init}, []::DOUBLE[] FROM {srcname}
  UNION ALL
  SELECT f.window_id, f.t + 1, {", ".join(upd)}, f.ys || [{y}]
  FROM {name} f JOIN {srcname} USING (window_id) WHERE f.t < len({srcname}.{seq_col}))"""
    ext = (f"list_transform(range({pad}, 0, -1), lambda j: 2 * {arr}[1] - {arr}[j + 1]) || {arr} || "
           f"list_transform(range(1, {pad} + 1), lambda j: 2 * {arr}[len({arr})] - {arr}[len({arr}) - j])")
    return f"""WITH RECURSIVE src AS (SELECT window_id, {ext} AS xe FROM {src} WHERE len({arr}) > {pad}),
{rec('fwd', 'xe', 'src')},
bsrc AS (SELECT window_id, list_reverse(ys) AS yr FROM fwd WHERE t = (SELECT max(t) FROM fwd g WHERE g.window_id = fwd.window_id)),
{rec('bwd', 'yr', 'bsrc')}
SELECT window_id, list_reverse(ys)[{pad + 1}:len(ys) - {pad}] AS {out}
FROM bwd WHERE t = (SELECT max(t) FROM bwd g WHERE g.window_id = bwd.window_id)"""


_BW_B, _BW_A = S.butter(4, 5.0, "lowpass", FS)


@register("butterworth", with_ctes(rounded(_filtfilt_sql("signals", "v", _BW_B, _BW_A, "filtered"), [],
                                           arrays=["filtered"]), "signals"))
def q_butterworth(spark, d):
    """Zero-phase low-pass (5 Hz, order 4) of every window; the oracle filters recursively in SQL."""
    s = roles.signals_view(spark, d)
    return out(signal_ops.butterworth(s, "v", FS, 5.0, "lowpass", 4, "filtered").select("window_id", "filtered"))


_LB, _LA = S.butter(3, (0.5, 3.5), "bandpass", FS)
_SB, _SA = S.butter(4, (0.7, 2.5), "bandpass", FS)


@register("adaptive_filter", with_ctes(rounded(f"""WITH {_DFT}, {_quality_sql('ppg')},
light AS ({_filtfilt_sql('signals', 'v', _LB, _LA, 'lf')}),
strong AS ({_filtfilt_sql('signals', 'v', _SB, _SA, 'sf')}),
sm AS (SELECT window_id, list_transform(range(len(sf)), lambda i: list_sum(list_slice(
         [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] || sf || [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], i + 1, i + 16)) / 16) AS smoothed
       FROM strong)
SELECT q.window_id, CASE WHEN q.quality_score >= 0.7 THEN light.lf ELSE sm.smoothed END AS filtered
FROM q_ppg q LEFT JOIN light USING (window_id) LEFT JOIN sm USING (window_id)""", [], arrays=["filtered"]),
    "signals_long", "signals"))
def q_adaptive_filter(spark, d):
    """Quality-routed filtering: light band-pass for good windows, tighter band-pass + smoothing otherwise."""
    s = roles.signals_view(spark, d)
    return out(signal_ops.adaptive_filter(s, "v", FS, "ppg", 0.7).select("window_id", "filtered"))


def _adaptive_sql(kind: str, quality: str, post: str) -> str:
    """Light and strong branch of one signal type; ``post`` maps the strong one (sf) to the result."""
    lt, lc, lo = signal_ops.ADAPTIVE_LIGHT[kind]
    st, sc, so = signal_ops.ADAPTIVE_STRONG[kind]
    return with_ctes(rounded(f"""WITH {quality},
light AS ({_filtfilt_sql('signals', 'v', *S.butter(lo, lc, lt, FS), 'lf')}),
strong AS ({_filtfilt_sql('signals', 'v', *S.butter(so, sc, st, FS), 'sf')}),
post AS ({post})
SELECT q.window_id, CASE WHEN q.quality_score >= 0.7 THEN light.lf ELSE post.done END AS filtered
FROM q_{kind} q LEFT JOIN light USING (window_id) LEFT JOIN post USING (window_id)""", [], arrays=["filtered"], digits=4), "signals_long", "signals")


_OTHER_SQL = """q_temp AS (SELECT window_id, 1 - CASE WHEN max(abs(x)) > 0 THEN stddev_pop(x) / max(abs(x)) ELSE 0 END AS quality_score
  FROM signals_long GROUP BY window_id)"""
_DETREND_SQL = """SELECT window_id, list(x - (b * i + a) ORDER BY i) AS done FROM (SELECT window_id, unnest(sf) AS x, unnest(range(len(sf))) AS i FROM strong)
  JOIN (SELECT window_id, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM (SELECT window_id, unnest(sf) AS x, unnest(range(len(sf))) AS i FROM strong) GROUP BY window_id) USING (window_id)
  GROUP BY window_id"""
_MEDIAN65_SQL = """SELECT window_id, list_transform(range(len(sf)), lambda i: list_sort(list_slice(z || sf || z, i + 1, i + 65))[33]) AS done
  FROM (SELECT window_id, sf, list_transform(range(32), lambda j: 0.0::DOUBLE) AS z FROM strong)"""


@register("adaptive_filter_eda", _adaptive_sql("eda", f"{_DFT}, {_quality_sql('eda')}", _DETREND_SQL))
def q_adaptive_filter_eda(spark, d):
    """Skin conductance: low-pass by quality, the strong branch detrended."""
    return out(signal_ops.adaptive_filter(roles.signals_view(spark, d), "v", FS, "eda", 0.7).select("window_id", "filtered"), 4)


@register("adaptive_filter_temp", _adaptive_sql("temp", _OTHER_SQL, _MEDIAN65_SQL))
def q_adaptive_filter_temp(spark, d):
    """Temperature: low-pass by quality, a one-second median after the strong branch."""
    return out(signal_ops.adaptive_filter(roles.signals_view(spark, d), "v", FS, "temp", 0.7).select("window_id", "filtered"), 4)


@register("filter_report", """SELECT count(*) AS n_windows, count_if(v IS NULL) AS n_missing,
  count_if(v IS NOT NULL AND len(v) <= 27) AS n_short, CAST(27 AS BIGINT) AS padding
FROM (SELECT CASE WHEN vec_id % 9 = 0 THEN NULL ELSE embedding[1:vec_id % 64 + 1] END AS v FROM embeddings) t""")
def q_filter_report(spark, d):
    """Windows of many lengths: how many the band-pass of order 4 can't take."""
    e = roles.table(spark, d, "embeddings")
    v = F.when(F.col("vec_id") % 9 != 0, F.slice(F.col("embedding").cast("array<double>"), 1, (F.col("vec_id") % 64 + 1).cast("int")))
    return signal_ops.filter_report(e.select(v.alias("v")), "v", FS, (0.7, 2.5), "bandpass", 4)


def _wavelet_sql() -> str:
    lo = "[" + ", ".join(repr(float(x)) for x in S.DB4_DEC_LO) + "]"
    hi = "[" + ", ".join(repr(float(x)) for x in S.DB4_DEC_HI) + "]"
    # half-sample symmetric extension by 7 on both sides; e[i + 8] holds x~[i] for i in [-7, n + 6]
    ext = ("list_transform(range(-7, len({x}) + 7), lambda i: {x}[CASE WHEN i < 0 THEN -i - 1 "
           "WHEN i >= len({x}) THEN 2 * len({x}) - i - 1 ELSE i END + 1])")
    band = ("list_transform(range((len({x}) + 7) // 2), lambda k: list_sum(list_transform(range(8), "
            "lambda j: {f}[j + 1] * {e}[2 * k + 1 - j + 8])))")

    def level(src: str, x: str, keep: str) -> str:
        return (f"SELECT window_id{keep}, {band.format(x='t.x', f=lo, e='t.e')} AS a, "
                f"{band.format(x='t.x', f=hi, e='t.e')} AS d FROM (SELECT *, {ext.format(x='x')} AS e "
                f"FROM (SELECT *, {x} AS x FROM {src}) s) t")

    stats = lambda b: (f"list_avg({b}) AS {b}_mean, list_aggregate({b}, 'stddev_pop') AS {b}_std, "  # noqa: E731
                       f"list_max({b}) AS {b}_max, list_min({b}) AS {b}_min, list_aggregate({b}, 'median') AS {b}_median")
    names = [f"{b}_{st}" for b in ("cA3", "cD3", "cD2", "cD1") for st in ("mean", "std", "max", "min", "median")]
    body = f"""WITH w1 AS ({level('signals', 'v', '')}),
w2 AS ({level('(SELECT window_id, a, d AS d1 FROM w1)', 'a', ', d1')}),
w3 AS ({level('(SELECT window_id, a, d AS d2, d1 FROM w2)', 'a', ', d2, d1')}),
b AS (SELECT window_id, a AS cA3, d AS cD3, d2 AS cD2, d1 AS cD1 FROM w3)
SELECT window_id, {stats('cA3')}, {stats('cD3')}, {stats('cD2')}, {stats('cD1')} FROM b"""
    return with_ctes(rounded(body, names), "signals")


@register("wavelet_features", _wavelet_sql())
def q_wavelet_features(spark, d):
    """db4 level-3 statistics per window; the oracle runs the Mallat cascade in SQL list functions."""
    s = roles.signals_view(spark, d)
    return out(signal_ops.wavelet_features(s, "v").select("window_id", "wavelet.*"))


_TUKEY32 = "[" + ", ".join(repr(float(x)) for x in S.tukey(32)) + "]"


@register("spectrogram", with_ctes(rounded(f"""WITH seg AS (
  SELECT window_id, sg, list_slice(v, sg * 16 + 1, sg * 16 + 32) AS fr
  FROM signals, (SELECT unnest(range(0, 3)) AS sg) g WHERE len(v) >= 32 AND sg <= (len(v) - 32) // 16),
tap AS (SELECT window_id, sg, j, (fr[j + 1] - list_avg(fr)) * {_TUKEY32}[j + 1] AS y
        FROM seg, (SELECT unnest(range(0, 32)) AS j) jj),
dft AS (SELECT window_id, sg, k, sum(y * cos(2 * pi() * j * k / 32)) AS re, sum(y * sin(2 * pi() * j * k / 32)) AS im
        FROM tap, (SELECT unnest(range(0, 17)) AS k) kk GROUP BY window_id, sg, k),
pw AS (SELECT window_id, sg, k, (re * re + im * im) / power(list_sum({_TUKEY32}), 2)
                              * CASE WHEN k = 0 OR k = 16 THEN 1 ELSE 2 END AS p FROM dft)
SELECT window_id, CAST(sg AS INTEGER) AS seg, (sg * 16 + 16) / 64.0 AS seg_time, k * 2.0 AS freq,
       CASE WHEN p > 0 THEN 10 * log10(p) END AS db FROM pw""", ["seg_time", "freq", "db"], digits=4),
    "signals"))
def q_spectrogram(spark, d):
    s = roles.signals_view(spark, d)
    return out(signal_ops.spectrogram(s, ["window_id"], "v", FS, 32, 16), 4)


# ------------------------------------------------------------------ D18 / C2 / D37 / E4 / E17

@register("segment_stats", with_ctes(rounded("""SELECT window_id, avg(x) AS mean, stddev_pop(x) AS std, max(x) AS max,
  min(x) AS min, quantile_cont(x, 0.5) AS median,
  avg(power(x - mu, 3)) / power(var_pop(x), 1.5) AS skew,
  quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75
FROM (SELECT *, avg(x) OVER (PARTITION BY window_id) AS mu FROM signals_long) t GROUP BY window_id""",
    ["mean", "std", "max", "min", "median", "skew", "p25", "p75"]), "signals_long"))
def q_segment_stats(spark, d):
    return out(signal_ops.segment_stats(roles.signals_long_view(spark, d), ["window_id"]))


@register("entity_normalized_features", with_ctes(rounded("""WITH st AS (
  SELECT window_id, any_value(condition) AS condition, avg(x) AS mean, stddev_pop(x) AS std, max(x) AS max, min(x) AS min,
         quantile_cont(x, 0.5) AS median FROM signals_long GROUP BY window_id),
es AS (SELECT condition, avg(x) AS e_mean, stddev_pop(x) AS e_std FROM signals_long GROUP BY condition)
SELECT window_id, (mean - e_mean) / e_std AS mean, std / e_std AS std, (max - e_mean) / e_std AS max,
       (min - e_mean) / e_std AS min, (median - e_mean) / e_std AS median
FROM st JOIN es USING (condition)""", ["mean", "std", "max", "min", "median"]), "signals_long"))
def q_entity_normalized_features(spark, d):
    long = roles.signals_long_view(spark, d)
    st = signal_ops.segment_stats(long, ["window_id", "condition"])
    es = signal_ops.entity_signal_stats(long, "condition")
    n = features.entity_normalized_features(st, es, "condition")
    return out(n.select("window_id", "mean", "std", "max", "min", "median"))


@register("series_summary", with_ctes(rounded("""WITH g AS (SELECT condition AS signal, avg(x) AS mean, stddev_pop(x) AS std,
  min(x) AS min, max(x) AS max, count(x) AS n, count(x) / 64.0 AS duration FROM signals_long GROUP BY condition)
SELECT *, max(duration) OVER () AS max_duration FROM g""", ["mean", "std", "min", "max", "duration", "max_duration"]),
    "signals_long"))
def q_series_summary(spark, d):
    long = roles.signals_long_view(spark, d).withColumnRenamed("condition", "signal")
    return out(signal_ops.series_summary(long, "signal", FS))


@register("sliding_frames", with_ctes(rounded("""SELECT window_id, CAST(fi AS INTEGER) AS frame_idx, CAST(fi * 8 AS INTEGER) AS start,
  CAST(least(fi * 8 + 16, len(v)) AS INTEGER) AS "end", fi * 8 / 64.0 AS start_time,
  list_slice(v, fi * 8 + 1, least(fi * 8 + 16, len(v))) AS frame,
  list_avg(list_slice(v, fi * 8 + 1, least(fi * 8 + 16, len(v)))) AS frame_mean
FROM signals, (SELECT unnest(range(0, 64)) AS fi) f WHERE len(v) >= 16 AND fi <= (len(v) - 16) // 8""",
    ["start_time", "frame_mean"], arrays=["frame"]), "signals"))
def q_sliding_frames(spark, d):
    s = roles.signals_view(spark, d)
    fr = signal_ops.sliding_frames(s, ["window_id"], "v", 16, 8)
    mean = F.aggregate("frame", F.lit(0.0), lambda a, x: a + x) / F.size("frame")
    return out(fr.select("window_id", "frame_idx", "start", "end", (F.col("start") / FS).alias("start_time"),
                         "frame", mean.alias("frame_mean")))


@register("time_windows", with_ctes(rounded("""WITH e AS (SELECT condition, label, epoch_ms(ts) AS ms FROM trials),
w AS (SELECT condition, label, (ms // 1800000) * 1800000 - o * 1800000 AS st
      FROM e, (SELECT unnest([0, 1]) AS o) oo)
SELECT condition, epoch_ms(st) AS start, epoch_ms(st + 3600000) AS "end", count(*) AS n, avg(label) AS mean
FROM w GROUP BY condition, st""", ["mean"]), "trials"))
def q_time_windows(spark, d):
    t = roles.trials_view(spark, d)
    return out(signal_ops.time_windows(t, "ts", "1 hour", "30 minutes", ["condition"], "label"))


# ------------------------------------------------------------------ E5 / E6 / E7 / H8 arrays

@register("moving_average", with_ctes(rounded("""SELECT window_id, list_transform(range(len(v)),
  lambda i: list_sum(list_slice([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] || v || [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
                                i + 1, i + 16)) / 16) AS smoothed FROM signals""", [], arrays=["smoothed"]), "signals"))
def q_moving_average(spark, d):
    s = roles.signals_view(spark, d)
    return out(s.select("window_id", signal_ops.moving_average(F.col("v"), int(FS * 0.25)).alias("smoothed")))


@register("median_filter", with_ctes(rounded("""SELECT window_id, list_transform(range(len(v)),
  lambda i: list_sort(list_slice([0.0, 0.0] || v || [0.0, 0.0], i + 1, i + 5))[3]) AS filtered FROM signals""",
    [], arrays=["filtered"]), "signals"))
def q_median_filter(spark, d):
    s = roles.signals_view(spark, d)
    return out(s.select("window_id", signal_ops.median_filter(F.col("v"), 4).alias("filtered")))


@register("detrend", with_ctes(rounded("""WITH fit AS (SELECT window_id, regr_slope(x, i) AS b, regr_intercept(x, i) AS a
                  FROM signals_long GROUP BY window_id)
SELECT window_id, list(x - (b * i + a) ORDER BY i) AS detrended
FROM signals_long JOIN fit USING (window_id) GROUP BY window_id""", [], arrays=["detrended"]), "signals_long"))
def q_detrend(spark, d):
    s = roles.signals_view(spark, d)
    return out(s.select("window_id", signal_ops.detrend(F.col("v")).alias("detrended")))


# ------------------------------------------------------------------ E11-E16 sequences

_WIN_SQL = """win AS (SELECT entity, condition, row_number() OVER (PARTITION BY entity, condition ORDER BY ts, row_id) - 1 AS idx,
                [label, CAST(k AS DOUBLE)] AS vec,
                CASE WHEN condition = 'error' THEN NULL ELSE CAST(length(condition) AS DOUBLE) END AS trial_label
         FROM trials)"""


def windows_view(spark: SparkSession, d: str) -> DataFrame:
    """Trials as windowed sequences: trial = (entity, condition), windows ordered by time."""
    t = roles.trials_view(spark, d)
    r = rank_in_group(t, ["entity", "condition"], [F.col("ts").asc(), F.col("row_id").asc()], "idx")
    lab = F.when(F.col("condition") == "error", F.lit(None)).otherwise(F.length("condition").cast("double"))
    return r.select("entity", "condition", "idx", F.array("label", F.col("k").cast("double")).alias("vec"),
                    lab.alias("trial_label"))


@register("build_sequences", with_ctes(f"""WITH {_WIN_SQL}
SELECT entity, condition, list(vec ORDER BY idx) AS seq, CAST(count(*) AS INTEGER) AS seq_len,
       coalesce(max(trial_label), 0.0) AS label
FROM win WHERE idx < 10 GROUP BY entity, condition""", "trials"))
def q_build_sequences(spark, d):
    w = windows_view(spark, d)
    return sequence.build_sequences(w, ["entity", "condition"], "idx", "vec", "trial_label", max_len=10)


@register("segment_overview", with_ctes(rounded(f"""WITH {_WIN_SQL},
tr AS (SELECT entity, condition, count(*) AS nw, max(trial_label) AS label FROM win GROUP BY entity, condition)
SELECT count(DISTINCT entity) AS n_entities, count(*) AS n_trials, CAST(sum(nw) AS BIGINT) AS n_windows,
       avg(nw) AS mean_windows, min(label) AS label_min, max(label) AS label_max, avg(label) AS label_mean FROM tr""",
    ["mean_windows", "label_min", "label_max", "label_mean"]), "trials"))
def q_segment_overview(spark, d):
    from vitalis.operators import stats

    w = windows_view(spark, d)
    trials = w.groupBy("entity", "condition").agg(F.count(F.lit(1)).alias("n"), F.max("trial_label").alias("label"))
    return out(stats.segment_overview(trials, "entity", "n", "label"))


@register("sequence_minmax", with_ctes(rounded(f"""WITH {_WIN_SQL},
l AS (SELECT entity, condition, idx, CAST(d.dim AS INTEGER) AS dim, vec[d.dim + 1] AS value
      FROM win, (SELECT unnest([0, 1]) AS dim) d)
SELECT entity, condition, idx, dim,
  (value - min(value) OVER g) / CASE WHEN max(value) OVER g - min(value) OVER g <= 1e-08 THEN 1.0
                                      ELSE max(value) OVER g - min(value) OVER g END AS value
FROM l WINDOW g AS (PARTITION BY entity, condition, dim)""", ["value"]), "trials"))
def q_sequence_minmax(spark, d):
    w = windows_view(spark, d)
    return out(sequence.sequence_minmax(w, ["entity", "condition"], "idx", "vec"))


@register("pad_sequences", with_ctes(f"""WITH {_WIN_SQL},
s AS (SELECT entity, condition, list(vec ORDER BY idx) AS seq, CAST(count(*) AS INTEGER) AS seq_len
      FROM win GROUP BY entity, condition)
SELECT entity, condition, seq_len, seq || list_transform(range((SELECT max(seq_len) FROM s) - seq_len), lambda j: [0.0, 0.0])
       AS padded FROM s""", "trials"))
def q_pad_sequences(spark, d):
    w = windows_view(spark, d)
    s = sequence.build_sequences(w, ["entity", "condition"], "idx", "vec")
    return sequence.pad_sequences(s).select("entity", "condition", "seq_len", "padded")


@register("pad_batches", with_ctes(f"""WITH {_WIN_SQL},
s AS (SELECT entity, condition, list(vec ORDER BY idx) AS seq, CAST(count(*) AS INTEGER) AS seq_len
      FROM win GROUP BY entity, condition),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY seq_len DESC, entity, condition) - 1) // 8 AS BIGINT) AS batch FROM s)
SELECT entity, condition, seq_len, batch,
       seq || list_transform(range(max(seq_len) OVER (PARTITION BY batch) - seq_len), lambda j: [0.0, 0.0]) AS padded FROM r""", "trials"))
def q_pad_batches(spark, d):
    """Batches of eight sequences of like length, each padded to its own longest."""
    s = sequence.build_sequences(windows_view(spark, d), ["entity", "condition"], "idx", "vec")
    return sequence.pad_batches(s, ["entity", "condition"], 8).select("entity", "condition", "seq_len", "batch", "padded")


_NOISE = ("sqrt(-2 * ln(1 - {a})) * cos(2 * pi() * {b})")


@register("augment_noise", with_ctes(rounded(f"""WITH {_WIN_SQL},
l AS (SELECT entity, condition, idx, CAST(d.dim AS INTEGER) AS dim, vec[d.dim + 1] AS value
      FROM win, (SELECT unnest([0, 1]) AS dim) d)
SELECT entity, condition, idx, dim,
  value + 0.1 * {_NOISE.format(a=md5_unit_sql(42, 'entity', 'condition', 'idx', 'dim', "'a'"),
                               b=md5_unit_sql(42, 'entity', 'condition', 'idx', 'dim', "'b'"))} AS value FROM l""",
    ["value"]), "trials"))
def q_augment_noise(spark, d):
    w = windows_view(spark, d)
    long = sequence.to_long(w, ["entity", "condition"], "idx", "vec")
    return out(sequence.augment_noise(long, ["entity", "condition"], "idx", "dim", "value", 0.1, 42))


@register("masked_mean_pool", with_ctes(rounded(f"""WITH {_WIN_SQL}
SELECT entity, condition, [avg(vec[1]), avg(vec[2])] AS pooled FROM win GROUP BY entity, condition""",
    [], arrays=["pooled"]), "trials"))
def q_masked_mean_pool(spark, d):
    w = windows_view(spark, d)
    s = sequence.pad_sequences(sequence.build_sequences(w, ["entity", "condition"], "idx", "vec"))
    return out(sequence.masked_mean_pool(s, "padded", "seq_len", 2).select("entity", "condition", "pooled"))
