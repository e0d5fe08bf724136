"""Group- and entity-relative features (lookups expressed as aggregate + equi-join).

Per-group statistics are computed with ``groupBy().agg()`` (map-side partial
aggregation) and joined back on the group key.  No explicit broadcast hint:
AQE measures the statistics side at runtime and turns the join into a
broadcast hash join when it is small, otherwise it stays a sort-merge join and
``spark.sql.adaptive.skewJoin`` splits a hot key.  A window partitioned by the
group would instead put a whole hot group into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import eps_ratio, safe_div
from vitalis.operators.ordering import join_null_safe, prefix_sums
from vitalis.operators.gram import value
from vitalis.operators.quantiles import grouped_quantiles
from vitalis.operators.stats import quantile


# ------------------------------------------------------------------ C1

def group_baseline(df: DataFrame, condition: str, diffs: Mapping[str, str] | None = None,
                   ratio: tuple[str, str, str, str] | None = None, eps: float = 1e-6,
                   exact: bool = True) -> DataFrame:
    """Condition-relative features.

    ``diffs`` maps a column to an output name: ``out = x - mean(x) by condition``.
    ``ratio = (num, den, ratio_name, norm_name)`` adds ``num / (den + eps)`` and that
    ratio divided by (its median by condition + eps).  Columns that are missing
    are skipped, and without the condition column the frame is returned as is.
    """
    if condition not in df.columns:
        return df
    diffs = {c: o for c, o in (diffs or {}).items() if c in df.columns}
    use_ratio = ratio is not None and all(c in df.columns for c in ratio[:2])
    if not diffs and not use_ratio:
        return df
    out = df
    if use_ratio:
        num, den, rname, _ = ratio
        out = out.withColumn(rname, eps_ratio(num, den, eps))
    aggs = [F.avg(value(c)).alias(f"_mean_{i}") for i, c in enumerate(diffs)]
    if use_ratio and not exact:
        aggs.append(quantile(F.col(ratio[2]), 0.5, False).alias("_ratio_med"))
    if use_ratio and exact:
        stats = grouped_quantiles(out, [condition], {"_ratio_med": F.col(ratio[2])}, [0.5]).withColumn("_ratio_med", F.col("_ratio_med")[0])
        stats = join_null_safe(out.groupBy(condition).agg(*aggs), stats, [condition]) if aggs else stats
    else:
        stats = out.groupBy(condition).agg(*aggs)
    j = out.join(stats, condition, "left")
    for i, (c, o) in enumerate(diffs.items()):
        j = j.withColumn(o, F.col(c) - F.col(f"_mean_{i}"))
    if use_ratio:
        j = j.withColumn(ratio[3], F.col(ratio[2]) / (F.col("_ratio_med") + F.lit(eps)))
    return j.drop(*[c for c in j.columns if c.startswith("_mean_") or c == "_ratio_med"])


# ------------------------------------------------------------------ E1

def entity_zscore(df: DataFrame, entity: str, columns: Sequence[str], min_rows: int = 3,
                  suffix: str = "_pilot_norm") -> DataFrame:
    """Per-entity z-score (sample std) of each column as ``<col><suffix>``.

    Entities with fewer than ``min_rows`` rows get NULL; std 0 (or undefined)
    gives 0.  NaN is missing, like NULL.  Statistics come from one grouped aggregate joined back.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        aggs += [F.avg(value(c)).alias(f"_m{i}"), F.stddev_samp(value(c)).alias(f"_s{i}")]
    stats = df.groupBy(entity).agg(*aggs)
    j = join_null_safe(df, stats, [entity], "left")
    for i, c in enumerate(columns):
        z = F.when(F.col(f"_s{i}") > 0, (value(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(F.lit(0.0))
        j = j.withColumn(f"{c}{suffix}", F.when(F.col("_n") >= min_rows, z))
    return j.drop("_n", *[f"_m{i}" for i in range(len(columns))], *[f"_s{i}" for i in range(len(columns))])


# ------------------------------------------------------------------ E2/E3

def grouped_prefix(df: DataFrame, keys: Sequence[str], order: Column, sum_cols: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums that restart for every key group (keys + order unique)."""
    keys = list(keys)
    pref = prefix_sums(df, [*[F.col(k).asc() for k in keys], order], sum_cols)
    starts = pref.groupBy(*keys).agg(*[F.min(f"{c}_before").alias(f"_start_{c}") for c in sum_cols])
    j = join_null_safe(pref, starts, keys)
    for c in sum_cols:
        j = j.withColumn(f"{c}_before", F.col(f"{c}_before") - F.col(f"_start_{c}")).drop(f"_start_{c}")
    return j


def percentile_of_score(df: DataFrame, entity: str, label: str, out: str = "label_pct") -> DataFrame:
    """Percentile (0-1, 'rank' kind) of each row's label among its entity's labels.

    For a member x: ``(#< x + #<= x + 1) / (2 n)``.  Counts are taken per distinct
    (entity, label) first, so equal labels and hot entities collapse before the
    distributed prefix sum.
    """
    base = df.where(F.col(label).isNotNull())
    cnt = base.groupBy(entity, label).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    pref = grouped_prefix(cnt, [entity], F.col(label).asc(), ["_c"])
    tot = cnt.groupBy(entity).agg(F.sum("_c").alias("_n"))
    scored = join_null_safe(pref, tot, [entity]).select(
        entity, label, ((2 * F.col("_c_before") + F.col("_c") + 1) / (2 * F.col("_n"))).alias(out))
    return join_null_safe(df, scored, [entity, label], "left")


def normalize_label(df: DataFrame, entity: str, label: str, method: str = "zscore",
                    out: str | None = None) -> DataFrame:
    """Per-entity label normalisation: zscore (population std; std 0 -> NULL), minmax (range 0 -> 0.5), quantile.

    Rows whose entity has no statistics keep the raw label (reference semantics).
    """
    out = out or f"{label}_norm"
    if method == "quantile":
        p = percentile_of_score(df, entity, label, "_pct")
        return p.withColumn(out, F.coalesce(F.col("_pct"), F.col(label).cast("double"))).drop("_pct")
    if method not in ("zscore", "minmax"):
        raise ValueError(f"Unknown normalization method: {method}")
    x = F.col(label).cast("double")
    st = df.where(x.isNotNull()).groupBy(entity).agg(
        F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_std"), F.min(x).alias("_min"), F.max(x).alias("_max"))
    j = df.join(st, entity, "left")
    if method == "zscore":
        v = F.when(F.col("_mean").isNull(), x).otherwise(safe_div(x - F.col("_mean"), F.col("_std")))
    else:
        rng = F.col("_max") - F.col("_min")
        v = F.when(F.col("_min").isNull(), x).when(rng == 0, F.lit(0.5)).otherwise((x - F.col("_min")) / rng)
    return j.withColumn(out, v).drop("_mean", "_std", "_min", "_max")


# ------------------------------------------------------------------ C2

def entity_normalized_features(stats: DataFrame, entity_stats: DataFrame, entity: str,
                               prefix: str = "") -> DataFrame:
    """Shift+scale window statistics by the entity's (mean, std) when std > 0.

    ``stats`` has mean/std/max/min/median/skew/p25/p75 per window; mean, max,
    min and median are z-scored, std is only scaled, skew and quartiles are left
    untouched.  ``entity_stats`` has (entity, e_mean, e_std).
    """
    j = stats.join(entity_stats, entity, "left")
    ok = F.col("e_std") > 0
    for c in ("mean", "max", "min", "median"):
        j = j.withColumn(prefix + c, F.when(ok, (F.col(prefix + c) - F.col("e_mean")) / F.col("e_std"))
                         .otherwise(F.col(prefix + c)))
    j = j.withColumn(prefix + "std", F.when(ok, F.col(prefix + "std") / F.col("e_std")).otherwise(F.col(prefix + "std")))
    return j.drop("e_mean", "e_std")


# ------------------------------------------------------------------ C3

def attach_metadata(preds: DataFrame, meta: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Inner equi-join of separately produced predictions with metadata on the row id."""
    return preds.join(meta, row_id, "inner")


# ------------------------------------------------------------------ C4

def clip_regions(regions: DataFrame, ends: DataFrame, entity: str, start: str = "start", end: str = "end",
                 t_end: str = "t_end") -> DataFrame:
    """Keep regions starting at or before the signal end; clip their end to it."""
    j = regions.join(ends, entity)
    return j.where(F.col(start) <= F.col(t_end)).withColumn(end, F.least(F.col(end), F.col(t_end))).drop(t_end)


def keep_events(events: DataFrame, ends: DataFrame, entity: str, time: str = "time", t_end: str = "t_end") -> DataFrame:
    return events.join(ends, entity).where(F.col(time) <= F.col(t_end)).drop(t_end)


def annotate_samples(samples: DataFrame, regions: DataFrame, entity: str, t: str = "t",
                     start: str = "start", end: str = "end", bucket: float = 8.0) -> DataFrame:
    """Number of regions covering each sample (start <= t <= end): interval join.

    Each region is exploded into the time buckets it overlaps and joined with
    the samples on (entity, bucket), then filtered exactly; this avoids a
    nested-loop join.  Work is proportional to region length / bucket width.
    """
    b = F.lit(float(bucket))
    r = regions.select(entity, F.col(start).alias("_s"), F.col(end).alias("_e"))
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / b).cast("bigint"),
                                                F.floor(F.col("_e") / b).cast("bigint"))))
    s = samples.withColumn("_b", F.floor(F.col(t) / b).cast("bigint"))
    # equal samples are counted once and come back as often as they were
    keys = [c for c in samples.columns]
    s = s.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_copies"))
    j = s.join(r, [entity, "_b"], "left")
    hit = (F.col(t) >= F.col("_s")) & (F.col(t) <= F.col("_e"))
    g = j.groupBy(*keys, "_copies").agg(F.count_if(hit).cast("bigint").alias("n_regions"))
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return g.select(*keys, "n_regions", again.alias("_copy")).drop("_copy")
