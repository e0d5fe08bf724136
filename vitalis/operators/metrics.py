"""Evaluation metrics as aggregates over a prediction frame.

Predictions are a DataFrame ``(row_id, y_true, y_pred[, score | scores][, group...])``.
Regression metrics are one ``agg`` (optionally per group); classification
metrics start from the confusion counts ``groupBy(keys, y, p).count()`` (a frame
of at most groups x classes^2 rows) and derive everything from that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import safe_div
from vitalis.operators.ordering import join_null_safe
from vitalis.operators.quantiles import exact_quantiles, grouped_quantiles
from vitalis.operators.stats import quantile

REG_METRICS = ("mse", "rmse", "mae", "r2", "explained_variance", "mape", "median_ae", "max_error")
CLS_METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "kappa")


def _finite_ratio_score(num: Column, den: Column) -> Column:
    """1 - num/den with the convention den == 0 -> 1 if num == 0 else 0."""
    return F.when(den == 0, F.when(num == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - num / den)


def regression_aggs(y: Column, p: Column, metrics: Sequence[str] = REG_METRICS, mape_scale: float = 1.0,
                    exact: bool = True) -> list[Column]:
    e = y - p
    ae = F.abs(e)
    n = F.count(e)
    sse = F.sum(e * e)
    out = []
    for m in metrics:
        if m == "mse":
            out.append(F.avg(e * e).alias("mse"))
        elif m == "rmse":
            out.append(F.sqrt(F.avg(e * e)).alias("rmse"))
        elif m == "mae":
            out.append(F.avg(ae).alias("mae"))
        elif m == "r2":
            sst = F.var_pop(y) * n
            out.append(F.when(n >= 2, _finite_ratio_score(sse, sst)).alias("r2"))
        elif m == "explained_variance":
            out.append(F.when(n >= 2, _finite_ratio_score(F.var_pop(e), F.var_pop(y))).alias("explained_variance"))
        elif m == "mape":
            rel = F.when(y != 0, ae / F.abs(y))
            out.append((F.avg(rel) * F.lit(mape_scale)).alias("mape"))
        elif m == "median_ae":
            out.append(quantile(ae, 0.5, exact).alias("median_ae"))
        elif m == "max_error":
            out.append(F.max(ae).alias("max_error"))
        else:
            raise ValueError(f"unknown regression metric {m!r}")
    return out


def regression_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                       metrics: Sequence[str] | None = None, by: Sequence[str] | None = None,
                       exact: bool = True) -> DataFrame:
    """mse, rmse, mae, r2, explained_variance, mape (fraction, y == 0 skipped), median_ae, max_error."""
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    n = F.count_if(y.isNotNull() & p.isNotNull()).cast("bigint")
    metrics = list(metrics or REG_METRICS)
    if not exact or "median_ae" not in metrics:
        aggs = [n.alias("n")] + regression_aggs(y, p, metrics, exact=exact)
        return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    if by:
        rest = df.groupBy(*by).agg(n.alias("n"), *regression_aggs(y, p, [m for m in metrics if m != "median_ae"]))
        median = grouped_quantiles(df, list(by), {"_q": F.abs(y - p)}, [0.5])
        return join_null_safe(rest, median, list(by)).withColumn("median_ae", F.col("_q")[0]).select(*by, "n", *metrics)
    out = df.agg(n.alias("n"), *regression_aggs(y, p, [m for m in metrics if m != "median_ae"]))
    median = exact_quantiles(df, {"ae": F.abs(y - p)}, [0.5])["ae"]
    return out.withColumn("median_ae", F.lit(median[0] if median else None).cast("double")).select("n", *metrics)


def forecast_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Regression metrics with MAPE in percent (the forecast convention)."""
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    return df.agg(*regression_aggs(y, p, ("mse", "rmse", "mae", "r2", "explained_variance", "mape"), mape_scale=100.0))


# ------------------------------------------------------------ classification

def confusion_counts(df: DataFrame, y_true: str, y_pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(
        F.count(F.lit(1)).alias("cnt"))


def per_class_table(conf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys + (label, support, predicted, tp, precision, recall, f1); classes = union of t and p."""
    keys = list(keys)
    # each cell counts for its true and for its predicted class; one aggregate keeps null keys
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("t") == F.col("p"), F.col("cnt")).otherwise(none)
    cells = F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("cnt").alias("support"), none.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("p").alias("label"), none.alias("support"), F.col("cnt").alias("predicted"), none.alias("tp")),
    )).alias("x")
    j = conf.select(*keys, cells).select(*keys, "x.*").groupBy(*keys, "label").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("support", "predicted", "tp")])
    prec = F.coalesce(safe_div(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(safe_div(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(safe_div(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", f1)


def _averaged(c: str, average: str, n: Column) -> Column:
    if average == "macro":
        return F.avg(c)
    return F.sum("tp") / n if average == "micro" else F.sum(F.col("support") * F.col(c)) / n


def metrics_from_confusion(conf: DataFrame, keys: Sequence[str] = (), average: str = "weighted") -> DataFrame:
    """accuracy, balanced_accuracy, averaged precision/recall/f1, Cohen kappa (+ n) per key group.

    ``average``: ``weighted`` by support, ``macro`` (mean over the classes that occur as
    truth or prediction) or ``micro`` (from the totals).
    """
    if average not in ("weighted", "macro", "micro"):
        raise ValueError(f"average must be weighted, macro or micro, not {average!r}")
    pc = per_class_table(conf, keys)
    n = F.sum("support").cast("double")
    aggs = [
        F.sum("support").cast("bigint").alias("n"),
        (F.sum("tp") / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        *[_averaged(c, average, n).alias(c) for c in ("precision", "recall", "f1")],
        (F.sum(F.col("support").cast("double") * F.col("predicted")) / (n * n)).alias("_pe"),
    ]
    g = pc.groupBy(*keys).agg(*aggs) if keys else pc.agg(*aggs)
    kappa = F.when(F.col("_pe") == 1, F.lit(None).cast("double")).otherwise(
        (F.col("accuracy") - F.col("_pe")) / (1 - F.col("_pe")))
    return g.withColumn("kappa", kappa).drop("_pe")


def classification_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                           by: Sequence[str] = (), average: str = "weighted",
                           metrics: Sequence[str] | None = None) -> DataFrame:
    """n and the metrics of ``CLS_METRICS``, or those of them in ``metrics``, per key group."""
    unknown = set(metrics or ()) - set(CLS_METRICS)
    if unknown:
        raise ValueError(f"unknown classification metric {sorted(unknown)}")
    m = metrics_from_confusion(confusion_counts(df, y_true, y_pred, by), by, average)
    return m.select(*by, "n", *metrics) if metrics else m


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per-class precision/recall/f1/support plus 'accuracy', 'macro avg', 'weighted avg' rows."""
    pc = per_class_table(confusion_counts(df, y_true, y_pred))
    rows = pc.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    n = F.sum("support").cast("double")
    summary = pc.agg(
        F.sum("support").cast("bigint").alias("n"), (F.sum("tp") / n).alias("acc"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("support") * F.col("precision")) / n).alias("wp"),
        (F.sum(F.col("support") * F.col("recall")) / n).alias("wr"),
        (F.sum(F.col("support") * F.col("f1")) / n).alias("wf"))
    nul = F.lit(None).cast("double")
    extra = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), nul.alias("precision"), nul.alias("recall"),
                 F.col("acc").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")),
    )).alias("r")).select("r.*")
    return rows.unionByName(extra)


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     classes: Sequence | None = None) -> DataFrame:
    """Dense (y_true, y_pred, n, row_frac) grid; row_frac = n / (row total + 1e-6).

    The class list (bounded by the number of classes) is fetched once when not
    given; the grid is generated by exploding it, the counts are left-joined.
    """
    conf = confusion_counts(df, y_true, y_pred)
    if classes is None:
        classes = sorted(r[0] for r in conf.select("t").union(conf.select("p")).distinct().collect()
                         if r[0] is not None)
    lits = F.array(*[F.lit(c) for c in classes])
    grid = conf.sparkSession.range(1).select(F.explode(lits).alias("y_true")).select(
        "y_true", F.explode(lits).alias("y_pred"))
    c2 = conf.select(F.col("t").alias("y_true"), F.col("p").alias("y_pred"), "cnt")
    j = grid.join(c2, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("cnt", F.lit(0)).cast("bigint"))
    tot = j.groupBy("y_true").agg(F.sum("n").alias("_rt"))
    return j.join(tot, "y_true").select("y_true", "y_pred", "n", (F.col("n") / (F.col("_rt") + F.lit(1e-6))).alias("row_frac"))


def confusion_cube(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Cell counts with row, column and grand totals (NULL marks 'all')."""
    return df.cube(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def ordinal_metrics(df: DataFrame, classes: Sequence, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """accuracy, adjacent accuracy (|index diff| <= 1) and MAE of the class index, explicit class order."""
    idx = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    ti, pi = idx[F.col(y_true)], idx[F.col(y_pred)]
    d = F.abs(ti - pi)
    return df.agg(F.avg((d == 0).cast("double")).alias("accuracy"),
                  F.avg((d <= 1).cast("double")).alias("adjacent_accuracy"),
                  F.avg(d.cast("double")).alias("mae"))


# ------------------------------------------------------------ by entity / group

def metrics_by_entity_reg(df: DataFrame, entity: str, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per entity: n, mse, rmse, mae, r2 (NULL for one row); sorted by entity."""
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    aggs = regression_aggs(y, p, ("mse", "rmse", "mae", "r2"))
    n = F.count_if(y.isNotNull() & p.isNotNull()).cast("bigint")
    return df.groupBy(entity).agg(n.alias("n"), *aggs).orderBy(entity)


def metrics_by_entity_cls(df: DataFrame, entity: str, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per entity: n, accuracy, weighted precision/recall/f1 (from per-entity confusion counts)."""
    m = metrics_from_confusion(confusion_counts(df, y_true, y_pred, [entity]), [entity])
    return m.select(entity, "n", "accuracy", "precision", "recall", "f1").orderBy(entity)


def fairness(df: DataFrame, attribute: str, y_true: str = "y_true", y_pred: str = "y_pred",
             classification: bool = True, values: Sequence | None = None) -> DataFrame:
    """Metrics per attribute value (+ a 'max_gap' row: max - min of each metric)."""
    d = df.where(F.col(attribute).isin(list(values))) if values is not None else df
    if classification:
        m = classification_metrics(d, y_true, y_pred, by=[attribute])
        cols = list(CLS_METRICS)
    else:
        m = regression_metrics(d, y_true, y_pred, by=[attribute], metrics=("mse", "rmse", "mae", "r2"))
        cols = ["mse", "rmse", "mae", "r2"]
    m = m.select(F.col(attribute).cast("string").alias("value"), "n", *cols)
    gap = m.agg(*[(F.max(c) - F.min(c)).alias(c) for c in cols]).select(
        F.lit("max_gap").alias("value"), F.lit(None).cast("bigint").alias("n"), *cols)
    return m.unionByName(gap)


def residual_trend(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Least-squares line of residual (y - p) on prediction."""
    r = F.col(y_true) - F.col(y_pred)
    p = F.col(y_pred).cast("double")
    return df.agg(F.regr_slope(r, p).alias("slope"), F.regr_intercept(r, p).alias("intercept"),
                  F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("std_residual"))


def mean_baseline(train: DataFrame, test: DataFrame, y_true: str = "y_true") -> DataFrame:
    """Predict the training mean for every test row; regression metrics on test."""
    m = train.agg(F.avg(F.col(y_true).cast("double"))).first()[0]
    pred = test.withColumn("_base", F.lit(m).cast("double"))
    return regression_metrics(pred, y_true, "_base", metrics=("mse", "rmse", "mae", "r2")).withColumn(
        "train_mean", F.lit(m).cast("double"))


def history_extrema(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Per key: best value and its first position; min if the key name contains 'loss', else max."""
    v, p = F.col(value).cast("double"), F.col(pos)
    mn = F.min(F.struct(v.alias("v"), p.alias("p")))
    mx = F.max(F.struct(v.alias("v"), (-p).alias("np")))
    g = df.groupBy(key).agg(mn.alias("_mn"), mx.alias("_mx"))
    is_loss = F.lower(F.col(key).cast("string")).contains("loss")
    return g.select(key,
                    F.when(is_loss, F.col("_mn.v")).otherwise(F.col("_mx.v")).alias("best_value"),
                    F.when(is_loss, F.col("_mn.p")).otherwise(-F.col("_mx.np")).alias("best_pos"),
                    F.when(is_loss, F.lit("min")).otherwise(F.lit("max")).alias("mode"))


def compare_models(long_preds: DataFrame, model: str = "model", y_true: str = "y_true", y_pred: str = "y_pred",
                   classification: bool = False, negate_errors: bool = False) -> DataFrame:
    """One metrics row per model from a long (model, row_id, y, p) frame."""
    if classification:
        return classification_metrics(long_preds, y_true, y_pred, by=[model])
    m = regression_metrics(long_preds, y_true, y_pred, by=[model], metrics=("mse", "rmse", "mae", "r2"))
    if negate_errors:
        for c in ("mse", "rmse", "mae"):
            m = m.withColumn(c, -F.col(c))
    return m
