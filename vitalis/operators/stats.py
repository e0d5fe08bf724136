"""Profiling and descriptive statistics as single-pass aggregates.

Rule used throughout: one ``agg`` over all requested columns (partial
aggregation on the map side, so a hot key or a hot column never reaches one
task as raw rows), then ``stack`` to a long result.  Exact quantiles, of columns
and of groups, come from selection (``quantiles``); pass ``exact=False`` for
``percentile_approx`` sketches.  NaN is missing like NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from vitalis.functions.columns import safe_div
from vitalis.operators.gram import gram, value
from vitalis.operators.gram import value as present
from vitalis.operators.ordering import join_null_safe
from vitalis.operators.quantiles import exact_quantiles, grouped_quantiles
from vitalis.operators.rankcorr import rank_gram


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quantile(c: Column | str, p, exact: bool = True, accuracy: int = 100000) -> Column:
    """Linear-interpolated quantile(s) as an aggregate; ``p`` scalar or list.

    ``exact`` counts the values of a group in one task: for groups of bounded size, such
    as windows or replicates (``grouped_quantiles`` takes groups of any size).
    """
    c = F.col(c) if isinstance(c, str) else c
    if exact:
        return F.percentile(c, p)
    return F.percentile_approx(c, p, accuracy)


def _kind(dt) -> str:
    if isinstance(dt, (NumericType, BooleanType)):
        return "numeric"
    if isinstance(dt, (TimestampType, TimestampNTZType, DateType)):
        return "datetime"
    return "categorical"


def _stack(row_df: DataFrame, entries: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Unpivot a one-row frame: each entry is one output row of Columns."""
    flat = []
    for e in entries:
        flat.extend(e)
    width = len(names)
    tmp = row_df.select(*[c.alias(f"_s{i}") for i, c in enumerate(flat)])
    args = ", ".join(f"_s{i}" for i in range(len(flat)))
    return tmp.selectExpr(f"stack({len(entries)}, {args}) AS ({', '.join(_q(n) for n in names)})") if width else tmp


# --------------------------------------------------------------------- D1

def profile_table(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per-column profile (numeric / categorical / datetime), one row per column.

    NULL and NaN are missing.  Columns: column_name, kind, n_missing, pct_missing, min, max, mean, median, std
    (sample), n_unique, top (most common value, ties -> smallest), ts_min, ts_max.
    """
    columns = list(columns or df.columns)
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields if f.name in columns}
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")]
    for i, c in enumerate(columns):
        x = value(c) if kinds[c] == "numeric" else F.col(c)
        aggs.append(F.count_if(x.isNull()).alias(f"_miss{i}"))
        if kinds[c] == "numeric":
            xd = x
            aggs += [F.min(xd).alias(f"_min{i}"), F.max(xd).alias(f"_max{i}"), F.avg(xd).alias(f"_avg{i}"),
                     F.stddev_samp(xd).alias(f"_std{i}")]
            if not exact:
                aggs.append(quantile(xd, 0.5, False).alias(f"_med{i}"))
        elif kinds[c] == "datetime":
            aggs += [F.min(x.cast("timestamp_ntz")).alias(f"_tmin{i}"), F.max(x.cast("timestamp_ntz")).alias(f"_tmax{i}")]
    wide = df.agg(*aggs)
    if exact:
        medians = exact_quantiles(df, {c: c for c in columns if kinds[c] == "numeric"}, [0.5])
        for i, c in enumerate(columns):
            if kinds[c] == "numeric":
                wide = wide.withColumn(f"_med{i}", F.lit(medians[c][0] if medians[c] else None).cast("double"))
    nulld, nullt = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    entries = []
    for i, c in enumerate(columns):
        k = kinds[c]
        miss = F.col(f"_miss{i}").cast("bigint")
        pct = safe_div(miss * F.lit(100.0), F.col("_n"))
        if k == "numeric":
            vals = [F.col(f"_min{i}"), F.col(f"_max{i}"), F.col(f"_avg{i}"), F.col(f"_med{i}"), F.col(f"_std{i}")]
        else:
            vals = [nulld] * 5
        tvals = [F.col(f"_tmin{i}"), F.col(f"_tmax{i}")] if k == "datetime" else [nullt, nullt]
        entries.append([F.lit(c), F.lit(k), miss, pct, *vals, *tvals])
    names = ["column_name", "kind", "n_missing", "pct_missing", "min", "max", "mean", "median", "std", "ts_min", "ts_max"]
    base = _stack(wide, entries, names)
    cats = [c for c in columns if kinds[c] == "categorical"]
    if cats:
        modes = categorical_modes(df, cats)
        base = base.join(modes, "column_name", "left")
    else:
        base = base.withColumn("n_unique", F.lit(None).cast("bigint")).withColumn("top", F.lit(None).cast("string"))
    return base.select("column_name", "kind", "n_missing", "pct_missing", "min", "max", "mean", "median", "std",
                       "n_unique", "top", "ts_min", "ts_max")


def categorical_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_unique, top): all columns in one (column, value) count pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                                 for c in columns]))
    long = df.select(pairs.alias("p")).select("p.column_name", "p.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("value")))
    return counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"), best.alias("_b")).select(
        "column_name", "n_unique", F.col("_b.value").alias("top"))


def profile_totals(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells and their percent of all cells (one row)."""
    ncol = len(df.columns)
    present = [value(f.name) if _kind(f.dataType) == "numeric" else F.col(f.name) for f in df.schema.fields]
    miss = sum((F.count_if(c.isNull()) for c in present), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), miss.cast("bigint").alias("missing")).select(
        "rows", F.lit(ncol).cast("bigint").alias("columns"), "missing",
        safe_div(F.col("missing") * F.lit(100.0), F.col("rows") * F.lit(ncol)).alias("missing_pct"))


# --------------------------------------------------------------------- D2/D3

def overview(df: DataFrame, entity: str, condition: str, label: str, category: str | None = None) -> DataFrame:
    """One row: distinct entities, rows, sorted distinct conditions, label mean/std/min/max."""
    aggs = [
        F.count_distinct(entity).alias("n_entities"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sort_array(F.collect_set(condition)).alias("conditions"),
        F.avg(label).alias("label_mean"), F.stddev_samp(label).alias("label_std"),
        F.min(label).cast("double").alias("label_min"), F.max(label).cast("double").alias("label_max"),
    ]
    return df.agg(*aggs)


def category_counts(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def segment_overview(trials: DataFrame, entity: str, windows: str, label: str) -> DataFrame:
    """Nested overview: entities, trials, total windows, mean windows per trial, label stats (NULLs skipped).

    ``windows`` is an array of windows or their number: counts need no assembled trials.
    """
    n = F.size(windows) if trials.schema[windows].dataType.typeName() == "array" else F.col(windows)
    sz = F.coalesce(n, F.lit(0))
    return trials.agg(
        F.count_distinct(entity).alias("n_entities"),
        F.count(F.lit(1)).alias("n_trials"),
        F.sum(sz).cast("bigint").alias("n_windows"),
        F.avg(sz).alias("mean_windows"),
        F.min(label).cast("double").alias("label_min"),
        F.max(label).cast("double").alias("label_max"),
        F.avg(label).alias("label_mean"),
    )


# --------------------------------------------------------------------- B5

def validate_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Evaluate all boolean rules in one pass: (rule, violations, ok, error).

    A row violates a rule when the predicate is false or NULL.  A rule that fails to run
    (a column that is not there, an arithmetic error) doesn't stop the others: when the
    common pass fails, each rule has a pass of its own, and the one that raises gets its
    message in ``error``, no number of violations, and is not ok.
    """
    names = list(rules)

    def violations(rule: str) -> Column:
        return F.count_if(~F.coalesce(rules[rule], F.lit(False)))

    def alone(rule: str) -> tuple[int | None, str | None]:
        try:
            return df.agg(violations(rule)).first()[0], None
        except PySparkException as e:
            return None, str(e).splitlines()[0]

    try:
        found = [(n, None) for n in df.agg(*[violations(r).alias(f"_r{i}") for i, r in enumerate(names)]).first()]
    except PySparkException:
        found = [alone(r) for r in names]
    rows = [(r, n, n == 0, e) for r, (n, e) in zip(names, found, strict=True)]
    return df.sparkSession.createDataFrame(rows, "rule string, violations bigint, ok boolean, error string")


# --------------------------------------------------------------------- B8

def zscore_anomalies(df: DataFrame, columns: Sequence[str], row_id: str, threshold: float = 3.0) -> DataFrame:
    """(column, row_id, z) for |z| > threshold, sample std; columns without hits give no rows.  NaN is missing."""
    stats = df.agg(*[F.avg(value(c)).alias(f"_m{i}") for i, c in enumerate(columns)],
                   *[F.stddev_samp(value(c)).alias(f"_s{i}") for i, c in enumerate(columns)]).first()
    longs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 safe_div(value(c) - F.lit(stats[f"_m{i}"]), F.lit(stats[f"_s{i}"])).alias("z"))
        for i, c in enumerate(columns)]))
    out = df.select(F.col(row_id).alias("row_id"), longs.alias("e")).select("e.column", "row_id", "e.z")
    return out.where(F.abs("z") > threshold)


# --------------------------------------------------------------------- D4/D5/D7/D8

def _long(df: DataFrame, rows: Sequence[str], cols: Sequence[str], r) -> DataFrame:
    """(col_a, col_b, r) of a matrix of correlations, NaN as NULL."""
    cells = [(a, b, None if math.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(rows) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(cells, "col_a string, col_b string, r double")


def corr_pearson(df: DataFrame, columns: Sequence[str], lower_only: bool = False) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form (col_a, col_b, r), NaN missing like NULL.

    One pass adds up the masked products of all columns (``gram``); the matrix itself has
    p x p numbers.  Zero variance (or no complete pair) gives NULL instead of an error.
    ``lower_only`` keeps each unordered pair once.
    """
    columns = list(columns)
    out = _long(df, columns, columns, gram(df, columns).correlation())
    if lower_only:
        place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
        out = out.where(place[F.col("col_a")] <= place[F.col("col_b")])
    return out


def corr_spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman = Pearson of average ranks, pairwise complete: ranks among the rows that hold both columns.

    The ranks of all columns come from one exchange by (column, value) and go back to the
    rows in another, whatever the number of columns (see ``rankcorr``).  NaN is missing.
    """
    columns = list(columns)
    return _long(df, columns, columns, rank_gram(df, columns).correlation())


def corr_kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall tau-b of two columns, O(n log n) and distributed (see kendall module)."""
    from vitalis.operators.kendall import kendall_tau_b

    return kendall_tau_b(df, x, y)


def corr_with_target(df: DataFrame, features: Sequence[str], target: str, top: int | None = 20) -> DataFrame:
    """Pearson r of each feature with the target, ordered by |r| desc (then name)."""
    features = [f for f in features if f != target]
    r = _long(df, features, [target], gram(df, features, [target]).correlation())
    out = r.select(F.col("col_a").alias("feature"), "r").withColumn("abs_r", F.abs("r"))
    out = out.orderBy(F.col("abs_r").desc_nulls_last(), F.col("feature"))
    return out.limit(top) if top else out


# --------------------------------------------------------------------- D9

def duplicates(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Duplicate groups over ``subset``: key columns and group size n (> 1).

    NULL keys drop out of the group listing (as pandas groupby does).  Partial
    aggregation on the map side makes a hot key cost one row per task.
    """
    keep = F.lit(True)
    for c in subset:
        keep = keep & F.col(c).isNotNull()
    return df.where(keep).groupBy(*subset).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once (``keep=False``), with its group size.

    NULL keys equal each other here, as they do in the totals of ``duplicate_summary``.
    The group sizes are joined back on the key (AQE: broadcast when small, skew
    split otherwise), so the member list stays a distributed frame of whole rows.
    """
    groups = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return join_null_safe(df, groups, list(subset))


def duplicate_summary(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """total rows that have a duplicate (keep=False), their percent, number of groups."""
    counts = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("n"))
    dup = counts.agg(
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("bigint").alias("total_duplicates"),
        F.count_if(F.col("n") > 1).cast("bigint").alias("duplicate_groups"),
        F.sum("n").cast("bigint").alias("rows"),
    )
    return dup.select("total_duplicates", "duplicate_groups",
                      safe_div(F.col("total_duplicates") * F.lit(100.0), F.col("rows")).alias("duplicate_pct"))


# --------------------------------------------------------------------- D10/D11

def distribution_summary(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """mean, median, sample std, bias-adjusted skew and excess kurtosis per column (NULL and NaN passed over)."""
    aggs = []
    for i, c in enumerate(columns):
        x = value(c)
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"),
                 F.stddev_samp(x).alias(f"_s{i}"), F.skewness(x).alias(f"_g{i}"), F.kurtosis(x).alias(f"_k{i}")]
        if not exact:
            aggs.append(quantile(x, 0.5, False).alias(f"_md{i}"))
    wide = df.agg(*aggs)
    if exact:
        for i, q in enumerate(exact_quantiles(df, {c: c for c in columns}, [0.5]).values()):
            wide = wide.withColumn(f"_md{i}", F.lit(q[0] if q else None).cast("double"))
    entries = []
    for i, c in enumerate(columns):
        n = F.col(f"_n{i}").cast("double")
        skew = F.when(n > 2, F.col(f"_g{i}") * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, ((n + 1) * F.col(f"_k{i}") + 6) * (n - 1) / ((n - 2) * (n - 3)))
        entries.append([F.lit(c), F.col(f"_m{i}"), F.col(f"_md{i}"), F.col(f"_s{i}"), skew, kurt])
    return _stack(wide, entries, ["column", "mean", "median", "std", "skew", "kurtosis"])


def histogram(df: DataFrame, column: str, bins: int = 20, hue: str | None = None) -> DataFrame:
    """Equal-width bin counts over [min, max]; the max value falls in the last bin.  NULL and NaN are in no bin."""
    x = value(column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = ([hue] if hue else []) + ["bin"]
    out = df.where(x.isNotNull()).withColumn("bin", b).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("lo", F.lit(lo) + F.col("bin") * F.lit(width)).withColumn(
        "hi", F.lit(lo) + (F.col("bin") + 1) * F.lit(width))


# --------------------------------------------------------------------- D12/D13

def crosstab_mean(df: DataFrame, row: str, col: str, value: str, col_values: Sequence | None = None) -> DataFrame:
    """Mean of ``value`` for row x col (pivot).  Pass ``col_values`` to skip the distinct pass."""
    g = df.groupBy(row)
    p = g.pivot(col, list(col_values)) if col_values is not None else g.pivot(col)
    return p.agg(F.avg(value))


def box_stats(df: DataFrame, group: str, value: str, exact: bool = True) -> DataFrame:
    """Per group: q1, median, q3, whiskers at the most extreme data inside 1.5*IQR, outlier count."""
    x = present(value)
    if exact:
        q = grouped_quantiles(df, [group], {"_q": x}, [0.25, 0.5, 0.75])
    else:
        q = df.groupBy(group).agg(quantile(x, [0.25, 0.5, 0.75], False).alias("_q"))
    q = q.select(group, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q = q.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = df.select(group, x.alias("_v")).join(q, group)
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.count_if(~inside).cast("bigint").alias("n_outliers"),
    )


# --------------------------------------------------------------------- D14/D15

def entity_stats(df: DataFrame, entity: str, label: str, exact: bool = True) -> DataFrame:
    """Per entity: mean, population std, min, max, median of the label (NULL and NaN labels skipped)."""
    x = value(label)
    held = df.where(x.isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    if not exact:
        return held.groupBy(entity).agg(*aggs, quantile(x, 0.5, False).alias("median"))
    median = grouped_quantiles(held, [entity], {"_q": x}, [0.5])
    return join_null_safe(held.groupBy(entity).agg(*aggs), median, [entity]).withColumn("median", F.col("_q")[0]).drop("_q")


def error_by_group(df: DataFrame, y_true: str, y_pred: str, groups: Sequence[str]) -> DataFrame:
    """abs error mean, sample std, count and mean relative error by each grouping column (grouping sets)."""
    err = F.abs(F.col(y_true) - F.col(y_pred))
    rel = err / (F.abs(F.col(y_true)) + F.lit(1e-10))
    base = df.select(*groups, err.alias("_e"), rel.alias("_r"))
    parts = []
    for g in groups:
        parts.append(base.groupBy(F.lit(g).alias("dim"), F.col(g).cast("string").alias("value")).agg(
            F.avg("_e").alias("mean_abs_error"), F.stddev_samp("_e").alias("std_abs_error"),
            F.count("_e").alias("n"), F.avg("_r").alias("mean_rel_error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------- D19/D20

def qcut3(df: DataFrame, column: str, labels: Sequence[str] = ("Low", "Medium", "High"),
          out: str = "qclass", exact: bool = True) -> DataFrame:
    """Quantile binning into len(labels) classes (edges at linear quantiles, right-closed)."""
    k = len(labels)
    probs = [i / k for i in range(1, k)]
    if exact:
        edges = exact_quantiles(df, {column: column}, probs)[column] or []
    else:
        edges = df.agg(quantile(F.col(column).cast("double"), probs, False).alias("e")).first()["e"]
    if len(set(edges)) != len(edges):
        raise ValueError("duplicate bin edges")
    x = F.col(column)
    expr = F.when(x.isNull(), F.lit(None))
    for e, lab in zip(edges, labels[:-1]):
        expr = expr.when(x <= F.lit(e), F.lit(lab))
    return df.withColumn(out, expr.otherwise(F.lit(labels[-1])))


def accuracy_by_group(df: DataFrame, y_true: str, y_pred: str, group: str) -> DataFrame:
    hit = (F.col(y_true) == F.col(y_pred)).cast("double")
    return df.groupBy(group).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- G1/G2

def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """(column, n_unique) for every column in one pass."""
    f: Callable = F.approx_count_distinct if approx else F.count_distinct
    wide = df.agg(*[f(c).alias(f"_u{i}") for i, c in enumerate(columns)])
    return _stack(wide, [[F.lit(c), F.col(f"_u{i}").cast("bigint")] for i, c in enumerate(columns)],
                  ["column", "n_unique"])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of separately loaded frames, missing columns filled with NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_n_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows per group by ``order`` (row_number <= n; Catalyst turns it into a group limit)."""
    g = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*g).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")




def topk(df: DataFrame, value: str, name: str, n: int, extra: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` rows by ``value`` desc (ties by name); companion columns travel with their row."""
    return df.select(name, value, *extra).orderBy(F.col(value).desc_nulls_last(), F.col(name)).limit(n)
