"""Classification / regression metric, curve and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalis.functions.columns import md5_int32_sql, md5_unit, md5_unit_sql, mixed_unit_sql
from vitalis.operators import curves, metrics, resample
from vitalis.plans import roles
from vitalis.plans.registry import out, register
from vitalis.plans.roles import with_ctes
from vitalis.plans.sqlhelp import reg_aggs, rounded

_CLS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "kappa"]


def _cls_sql(src: str, keys: list[str], select_keys: bool = True) -> str:
    """Oracle for classification metrics from confusion counts (optionally per key)."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    using = ", ".join(keys + ["label"])
    return f"""WITH conf AS (SELECT {kc}y_true AS t, y_pred AS p, count(*) AS cnt FROM {src} GROUP BY ALL),
sup AS (SELECT {kc}t AS label, sum(cnt) AS support FROM conf GROUP BY ALL),
prd AS (SELECT {kc}p AS label, sum(cnt) AS predicted FROM conf GROUP BY ALL),
tpt AS (SELECT {kc}t AS label, cnt AS tp FROM conf WHERE t = p),
pc AS (SELECT {kc}label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
       FROM sup FULL OUTER JOIN prd USING ({using}) LEFT JOIN tpt USING ({using})),
pc2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM pc),
pc3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM pc2),
g AS (SELECT {kc}CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy,
             avg(CASE WHEN support > 0 THEN rec END) AS balanced_accuracy,
             sum(support * prec) / sum(support) AS precision, sum(support * rec) / sum(support) AS recall,
             sum(support * f1) / sum(support) AS f1,
             sum(CAST(support AS DOUBLE) * predicted) / (CAST(sum(support) AS DOUBLE) * sum(support)) AS pe
      FROM pc3 GROUP BY ALL)
SELECT {kc}n, accuracy, balanced_accuracy, precision, recall, f1,
       CASE WHEN pe = 1 THEN NULL ELSE (accuracy - pe) / (1 - pe) END AS kappa FROM g"""


@register("classification_metrics_macro", with_ctes(rounded("""WITH c AS (SELECT DISTINCT y_true AS k FROM preds_multi UNION SELECT DISTINCT y_pred FROM preds_multi),
r AS (SELECT k, count(*) FILTER (y_true = k AND y_pred = k) AS tp, count(*) FILTER (y_true = k) AS s, count(*) FILTER (y_pred = k) AS q
      FROM preds_multi, c GROUP BY k),
m AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0.0 END AS prec, CASE WHEN s > 0 THEN tp / s ELSE 0.0 END AS rec FROM r)
SELECT CAST(sum(s) AS BIGINT) AS n, avg(prec) AS precision, avg(rec) AS recall,
       avg(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END) AS f1 FROM m""", ["precision", "recall", "f1"]), "preds_multi"))
def q_classification_metrics_macro(spark, d):
    return out(metrics.classification_metrics(roles.preds_multi_view(spark, d), average="macro", metrics=["precision", "recall", "f1"]))


@register("classification_metrics", with_ctes(rounded(_cls_sql("preds_multi", []), _CLS), "preds_multi"))
def q_classification_metrics(spark, d):
    return out(metrics.classification_metrics(roles.preds_multi_view(spark, d)))


@register("classification_metrics_bin", with_ctes(rounded(_cls_sql("preds_bin", []), _CLS), "preds_bin"))
def q_classification_metrics_bin(spark, d):
    return out(metrics.classification_metrics(roles.preds_bin_view(spark, d)))


@register("classification_report", with_ctes(rounded("""WITH conf AS (SELECT y_true AS t, y_pred AS p, count(*) AS cnt FROM preds_multi GROUP BY ALL),
sup AS (SELECT t AS label, sum(cnt) AS support FROM conf GROUP BY ALL),
prd AS (SELECT p AS label, sum(cnt) AS predicted FROM conf GROUP BY ALL),
tpt AS (SELECT t AS label, cnt AS tp FROM conf WHERE t = p),
pc AS (SELECT label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
       FROM sup FULL OUTER JOIN prd USING (label) LEFT JOIN tpt USING (label)),
pc2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM pc),
pc3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM pc2)
SELECT CAST(label AS VARCHAR) AS label, prec AS precision, rec AS recall, f1, CAST(support AS BIGINT) AS support FROM pc3
UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM pc3
UNION ALL SELECT 'macro avg', avg(prec), avg(rec), avg(f1), CAST(sum(support) AS BIGINT) FROM pc3
UNION ALL SELECT 'weighted avg', sum(support * prec) / sum(support), sum(support * rec) / sum(support),
                 sum(support * f1) / sum(support), CAST(sum(support) AS BIGINT) FROM pc3""",
    ["precision", "recall", "f1"]), "preds_multi"))
def q_classification_report(spark, d):
    return out(metrics.classification_report(roles.preds_multi_view(spark, d)))


@register("confusion_matrix", with_ctes(rounded("""WITH cls AS (SELECT DISTINCT c FROM (SELECT y_true AS c FROM preds_multi UNION SELECT y_pred FROM preds_multi)),
cnt AS (SELECT y_true, y_pred, count(*) AS n FROM preds_multi GROUP BY ALL),
grid AS (SELECT a.c AS y_true, b.c AS y_pred, coalesce(cnt.n, 0) AS n
         FROM cls a JOIN cls b ON true LEFT JOIN cnt ON cnt.y_true = a.c AND cnt.y_pred = b.c)
SELECT y_true, y_pred, CAST(n AS BIGINT) AS n, n / (sum(n) OVER (PARTITION BY y_true) + 1e-06) AS row_frac FROM grid""",
    ["row_frac"]), "preds_multi"))
def q_confusion_matrix(spark, d):
    return out(metrics.confusion_matrix(roles.preds_multi_view(spark, d)))


@register("confusion_cube", with_ctes(
    "SELECT y_true, y_pred, count(*) AS n FROM preds_multi GROUP BY CUBE (y_true, y_pred)", "preds_multi"))
def q_confusion_cube(spark, d):
    return metrics.confusion_cube(roles.preds_multi_view(spark, d))


@register("ordinal_metrics", with_ctes(rounded("""SELECT avg(CAST(abs(y_true - y_pred) = 0 AS DOUBLE)) AS accuracy,
  avg(CAST(abs(y_true - y_pred) <= 1 AS DOUBLE)) AS adjacent_accuracy, avg(CAST(abs(y_true - y_pred) AS DOUBLE)) AS mae
FROM preds_multi""", ["accuracy", "adjacent_accuracy", "mae"]), "preds_multi"))
def q_ordinal_metrics(spark, d):
    return out(metrics.ordinal_metrics(roles.preds_multi_view(spark, d), list(range(10))))


@register("forecast_metrics", with_ctes(rounded(
    f"SELECT {reg_aggs('y_true', 'y_pred', ('mse', 'rmse', 'mae', 'r2', 'explained_variance', 'mape'), 100.0)} "
    "FROM preds_reg", ["mse", "rmse", "mae", "r2", "explained_variance", "mape"],
    overrides={"mse": 0, "rmse": 4, "mae": 4}), "preds_reg"))
def q_forecast_metrics(spark, d):
    return out(metrics.forecast_metrics(roles.preds_reg_view(spark, d)), mse=0, rmse=4, mae=4)


@register("metrics_by_entity_cls", with_ctes(rounded(
    "SELECT grp, n, accuracy, precision, recall, f1 FROM (" + _cls_sql("preds_bin", ["grp"]) + ") m",
    ["accuracy", "precision", "recall", "f1"]), "preds_bin"))
def q_metrics_by_entity_cls(spark, d):
    return out(metrics.metrics_by_entity_cls(roles.preds_bin_view(spark, d), "grp"))


@register("fairness", with_ctes(rounded(f"""WITH m AS (SELECT CAST(grp AS VARCHAR) AS value, n, {', '.join(_CLS)}
  FROM ({_cls_sql('preds_bin', ['grp'])}) x)
SELECT * FROM m UNION ALL
SELECT 'max_gap', NULL, {', '.join(f'max({c}) - min({c})' for c in _CLS)} FROM m""", _CLS), "preds_bin"))
def q_fairness(spark, d):
    return out(metrics.fairness(roles.preds_bin_view(spark, d), "grp"))


@register("fairness_reg", with_ctes(rounded(f"""WITH m AS (SELECT CAST(status AS VARCHAR) AS value, count(*) AS n,
  {reg_aggs('y_true', 'y_pred', ('mse', 'rmse', 'mae', 'r2'))} FROM preds_reg GROUP BY status)
SELECT * FROM m UNION ALL
SELECT 'max_gap', NULL, max(mse) - min(mse), max(rmse) - min(rmse), max(mae) - min(mae), max(r2) - min(r2) FROM m""",
    ["mse", "rmse", "mae", "r2"], overrides={"mse": 0, "rmse": 4, "mae": 4}), "preds_reg"))
def q_fairness_reg(spark, d):
    return out(metrics.fairness(roles.preds_reg_view(spark, d), "status", classification=False), mse=0, rmse=4, mae=4)


@register("residual_trend", with_ctes(rounded("""SELECT regr_slope(y_true - y_pred, y_pred) AS slope,
  regr_intercept(y_true - y_pred, y_pred) AS intercept, avg(y_true - y_pred) AS mean_residual,
  stddev_samp(y_true - y_pred) AS std_residual FROM preds_reg""", ["slope", "intercept", "mean_residual", "std_residual"],
    overrides={"intercept": 3, "mean_residual": 4, "std_residual": 4}), "preds_reg"))
def q_residual_trend(spark, d):
    return out(metrics.residual_trend(roles.preds_reg_view(spark, d)), intercept=3, mean_residual=4, std_residual=4)


_TEST_BUCKET_SQL = md5_unit_sql(42, "row_id")


@register("mean_baseline", with_ctes(rounded(f"""WITH s AS (SELECT *, {_TEST_BUCKET_SQL} < 0.2 AS is_test FROM preds_reg),
m AS (SELECT avg(y_true) AS mu FROM s WHERE NOT is_test)
SELECT count(*) AS n, {reg_aggs('y_true', 'm.mu', ('mse', 'rmse', 'mae', 'r2'))}, m.mu AS train_mean
FROM s, m WHERE is_test GROUP BY m.mu""", ["mse", "rmse", "mae", "r2", "train_mean"],
    overrides={"mse": 0, "rmse": 4, "mae": 4, "train_mean": 4}), "preds_reg"))
def q_mean_baseline(spark, d):
    p = roles.preds_reg_view(spark, d).withColumn("_u", md5_unit(42, "row_id"))
    train, test = p.where(F.col("_u") >= 0.2), p.where(F.col("_u") < 0.2)
    return out(metrics.mean_baseline(train, test), mse=0, rmse=4, mae=4, train_mean=4)


_HIST_KEY = "CASE WHEN event_type IN ('error', 'signup') THEN event_type || '_loss' ELSE event_type END"


@register("history_extrema", rounded(f"""WITH h AS (SELECT {_HIST_KEY} AS key, event_id AS pos, value FROM events)
SELECT key, CASE WHEN key LIKE '%loss%' THEN min(value) ELSE max(value) END AS best_value,
  CASE WHEN key LIKE '%loss%' THEN arg_min(pos, (value, pos)) ELSE arg_max(pos, (value, -pos)) END AS best_pos,
  CASE WHEN key LIKE '%loss%' THEN 'min' ELSE 'max' END AS mode
FROM h GROUP BY key""", ["best_value"]))
def q_history_extrema(spark, d):
    e = roles.table(spark, d, "events")
    key = F.when(F.col("event_type").isin("error", "signup"), F.concat("event_type", F.lit("_loss"))).otherwise(
        F.col("event_type"))
    h = e.select(key.alias("key"), F.col("event_id").alias("pos"), "value")
    return out(metrics.history_extrema(h, "key", "pos", "value"))


@register("compare_models", with_ctes(rounded(f"""WITH lp AS (
  SELECT 'qty_model' AS model, row_id, y_true, y_pred FROM preds_reg
  UNION ALL SELECT 'total_model', p.row_id, p.y_true, o.o_totalprice FROM preds_reg p JOIN ofeat o USING (row_id))
SELECT model, count(*) AS n, {reg_aggs('y_true', 'y_pred', ('mse', 'rmse', 'mae', 'r2'))} FROM lp GROUP BY model""",
    ["mse", "rmse", "mae", "r2"], overrides={"mse": 0, "rmse": 4, "mae": 4}), "preds_reg"))
def q_compare_models(spark, d):
    p = roles.preds_reg_view(spark, d)
    o = roles.ofeat_view(spark, d).select("row_id", "o_totalprice")
    a = p.select(F.lit("qty_model").alias("model"), "row_id", "y_true", "y_pred")
    b = p.join(o, "row_id").select(F.lit("total_model").alias("model"), "row_id", "y_true",
                                   F.col("o_totalprice").alias("y_pred"))
    return out(metrics.compare_models(a.unionByName(b)), mse=0, rmse=4, mae=4)


# ------------------------------------------------------------------ curves

_SCORE_COUNTS = """c AS (SELECT score, sum(CASE WHEN y_true = 1 THEN 1.0 ELSE 0.0 END) AS pos,
              sum(CASE WHEN y_true = 1 THEN 0.0 ELSE 1.0 END) AS neg FROM preds_bin GROUP BY score),
cc AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg,
              sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM c)"""


@register("roc_curve", with_ctes(rounded(f"""WITH {_SCORE_COUNTS}
SELECT 0 AS cls, score AS threshold, cum_neg / N AS fpr, cum_pos / P AS tpr FROM cc UNION ALL SELECT 0, NULL, 0.0, 0.0""", ["threshold", "fpr", "tpr"]),
    "preds_bin"))
def q_roc_curve(spark, d):
    return out(curves.roc_curve(roles.preds_bin_view(spark, d)))


@register("roc_auc", with_ctes(rounded(f"""WITH {_SCORE_COUNTS}
SELECT 0 AS cls, sum(pos * (N - cum_neg + neg / 2)) / (max(P) * max(N)) AS auc, max(P) AS n_pos, max(N) AS n_neg FROM cc""",
    ["auc", "n_pos", "n_neg"]), "preds_bin"))
def q_roc_auc(spark, d):
    return out(curves.roc_auc(roles.preds_bin_view(spark, d)))


@register("roc_auc_multi", with_ctes(rounded("""WITH e AS (SELECT y_true, unnest(generate_series(0, len(scores) - 1)) AS cls,
                   unnest(scores) AS s FROM preds_multi),
c AS (SELECT cls, s, sum(CASE WHEN y_true = cls THEN 1.0 ELSE 0.0 END) AS pos,
             sum(CASE WHEN y_true = cls THEN 0.0 ELSE 1.0 END) AS neg FROM e GROUP BY cls, s),
cc AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY s DESC) AS cum_neg, sum(pos) OVER (PARTITION BY cls) AS P,
              sum(neg) OVER (PARTITION BY cls) AS N FROM c),
a AS (SELECT cls, sum(pos * (N - cum_neg + neg / 2)) / (max(P) * max(N)) AS auc, max(P) AS n_pos FROM cc GROUP BY cls)
SELECT sum(auc * n_pos) / sum(n_pos) AS roc_auc FROM a WHERE n_pos > 0""", ["roc_auc"]), "preds_multi"))
def q_roc_auc_multi(spark, d):
    return out(curves.roc_auc_weighted(roles.preds_multi_view(spark, d)))


@register("pr_curve", with_ctes(rounded(f"""WITH {_SCORE_COUNTS}
SELECT score AS threshold, cum_pos / (cum_pos + cum_neg) AS precision, cum_pos / P AS recall FROM cc UNION ALL SELECT NULL, 1.0, 0.0""",
    ["threshold", "precision", "recall"]), "preds_bin"))
def q_pr_curve(spark, d):
    return out(curves.pr_curve(roles.preds_bin_view(spark, d)))


_MULTI_COUNTS = """e AS (SELECT y_true, unnest(generate_series(0, len(scores) - 1)) AS cls, unnest(scores) AS s FROM preds_multi),
c AS (SELECT cls, s, sum(CASE WHEN y_true = cls THEN 1.0 ELSE 0.0 END) AS pos, count(*) AS n FROM e GROUP BY cls, s),
cc AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n, sum(pos) OVER (PARTITION BY cls) AS P
       FROM c WINDOW w AS (PARTITION BY cls ORDER BY s DESC))"""


@register("pr_curve_multi", with_ctes(rounded(f"""WITH {_MULTI_COUNTS}
SELECT CAST(cls AS INTEGER) AS cls, s AS threshold, cum_pos / cum_n AS precision, CASE WHEN P > 0 THEN cum_pos / P END AS recall FROM cc
UNION ALL SELECT DISTINCT CAST(cls AS INTEGER), NULL, 1.0, 0.0 FROM c""", ["threshold", "precision", "recall"]), "preds_multi"))
def q_pr_curve_multi(spark, d):
    return out(curves.pr_curve(roles.preds_multi_view(spark, d), "y_true", "scores", scores_array=True))


@register("avg_precision_multi", with_ctes(rounded(f"""WITH {_MULTI_COUNTS}
SELECT CAST(cls AS INTEGER) AS cls, CASE WHEN max(P) > 0 THEN sum(pos * cum_pos / cum_n) / max(P) END AS avg_precision FROM cc GROUP BY cls""",
    ["avg_precision"]), "preds_multi"))
def q_avg_precision_multi(spark, d):
    return out(curves.average_precision(roles.preds_multi_view(spark, d), "y_true", "scores", scores_array=True))


@register("avg_precision", with_ctes(rounded(f"""WITH {_SCORE_COUNTS}
SELECT sum(pos * cum_pos / (cum_pos + cum_neg)) / max(P) AS avg_precision FROM cc""", ["avg_precision"]), "preds_bin"))
def q_avg_precision(spark, d):
    return out(curves.average_precision(roles.preds_bin_view(spark, d)))


_EDGES_SQL = "[" + ", ".join(repr(e) for e in curves.calibration_edges(10)) + "]"
_BIN_SQL = f"CAST(len(list_filter({_EDGES_SQL}, lambda e: e < score)) AS INTEGER)"


@register("calibration", with_ctes(rounded(f"""SELECT {_BIN_SQL} AS bin, avg(CAST(y_true AS DOUBLE)) AS prob_true,
  avg(score) AS prob_pred, count(*) AS n FROM preds_bin GROUP BY 1""", ["prob_true", "prob_pred"]), "preds_bin"))
def q_calibration(spark, d):
    return out(curves.calibration(roles.preds_bin_view(spark, d)))


@register("ece", with_ctes(rounded(f"""WITH c AS (SELECT {_BIN_SQL} AS bin, avg(CAST(y_true AS DOUBLE)) AS pt,
  avg(score) AS pp, count(*) AS n FROM preds_bin GROUP BY 1)
SELECT sum(n * abs(pt - pp)) / sum(n) AS ece, max(abs(pt - pp)) AS mce FROM c""", ["ece", "mce"]), "preds_bin"))
def q_ece(spark, d):
    return out(curves.calibration_error(roles.preds_bin_view(spark, d)))


# ------------------------------------------------------------------ D32 bootstrap

_CDF_SQL = "[" + ", ".join(repr(c) for c in resample.poisson1_cdf()) + "]"
_BOOT_B = 1000


@register("bootstrap_ci", with_ctes(rounded(f"""WITH e AS (SELECT {md5_int32_sql(42, 'p.row_id')} AS h, p.y_true, p.y_pred, b.b
  FROM preds_reg p, (SELECT unnest(generate_series(0, {_BOOT_B - 1})) AS b) b),
w AS (SELECT *, CAST(len(list_filter({_CDF_SQL}, lambda c: c <= {mixed_unit_sql('h', 'b')})) AS DOUBLE) AS wt FROM e),
r AS (SELECT b, sum(wt) AS w, sum(wt * (y_true - y_pred) * (y_true - y_pred)) AS se FROM w GROUP BY b),
m AS (SELECT se / w AS m FROM r WHERE w > 0)
SELECT 'mse' AS metric, (SELECT avg((y_true - y_pred) * (y_true - y_pred)) FROM preds_reg) AS mean,
  quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m""",
    ["mean", "lower", "upper"], digits=0), "preds_reg"))
def q_bootstrap_ci(spark, d):
    p = roles.preds_reg_view(spark, d)
    return out(resample.bootstrap_ci(p, "row_id", "y_true", "y_pred", "mse", n_boot=_BOOT_B), 0)


@register("bootstrap_ci_r2", with_ctes(rounded(f"""WITH e AS (SELECT {md5_int32_sql(42, 'p.row_id')} AS h, p.y_true, p.y_pred, b.b
  FROM preds_reg p, (SELECT unnest(generate_series(0, 199)) AS b) b),
w AS (SELECT *, CAST(len(list_filter({_CDF_SQL}, lambda c: c <= {mixed_unit_sql('h', 'b')})) AS DOUBLE) AS wt FROM e),
r AS (SELECT b, sum(wt) AS w, sum(wt * (y_true - y_pred) * (y_true - y_pred)) AS se, sum(wt * y_true) AS sy,
      sum(wt * y_true * y_true) AS sy2 FROM w GROUP BY b),
m AS (SELECT 1 - se / (sy2 - sy * sy / w) AS m FROM r WHERE w > 0)
SELECT 'r2' AS metric, (SELECT 1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true) FROM preds_reg) AS mean,
  quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m""",
    ["mean", "lower", "upper"], digits=6), "preds_reg"))
def q_bootstrap_ci_r2(spark, d):
    p = roles.preds_reg_view(spark, d)
    return out(resample.bootstrap_ci(p, "row_id", "y_true", "y_pred", "r2", n_boot=200), 6)
