"""Core queries: scans, projections, profile, entity statistics, regression metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.operators import features, metrics, stats
from vitalis.plans import roles
from vitalis.plans.registry import out, register
from vitalis.plans.roles import with_ctes
from vitalis.plans.sqlhelp import reg_aggs, rounded


# =============================================================== A: scans

@register("scan_parquet", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice
FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'""")
def q_scan_parquet(spark, d):
    li = roles.table(spark, d, "lineitem")
    return li.where((F.col("l_discount") > 0.05) & (F.col("l_returnflag") == "R")).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


# =============================================================== B: projections / predicates

@register("project_features", with_ctes(
    "SELECT qty, price, disc, tax, n FROM ofeat", "ofeat"))
def q_project_features(spark, d):
    o = roles.ofeat_view(spark, d)
    r = roles.Roles(meta=["row_id", "o_orderpriority", "o_orderstatus", "o_custkey", "o_orderdate"],
                    labels=["o_totalprice"])
    return r.project_features(o)


@register("prefix_category", """SELECT c_custkey, CASE WHEN CAST(c_custkey AS VARCHAR) LIKE '8%' THEN 'minimal_exp'
  WHEN CAST(c_custkey AS VARCHAR) LIKE '9%' THEN 'commercial' ELSE 'air_force' END AS category
FROM customer""")
def q_prefix_category(spark, d):
    from vitalis.functions.columns import entity_category

    c = roles.table(spark, d, "customer")
    return c.select("c_custkey", entity_category("c_custkey").alias("category"))


# =============================================================== D: aggregates

_PROFILE_COLS = ["row_id", "entity", "condition", "label", "k", "ts"]


def _profile_sql() -> str:
    parts = []
    for c, kind in [("row_id", "numeric"), ("entity", "categorical"), ("condition", "categorical"),
                    ("label", "numeric"), ("k", "numeric"), ("ts", "datetime")]:
        miss = f"count(*) - count({c})"
        if kind == "numeric":
            vals = (f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), avg({c}), "
                    f"quantile_cont(CAST({c} AS DOUBLE), 0.5), stddev_samp({c})")
        else:
            vals = "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
        if kind == "categorical":
            cat = (f"(SELECT count(DISTINCT {c}) FROM trials_null), "
                   f"(SELECT {c} FROM trials_null WHERE {c} IS NOT NULL GROUP BY {c} "
                   f"ORDER BY count(*) DESC, {c} LIMIT 1)")
        else:
            cat = "NULL::BIGINT, NULL::VARCHAR"
        ts = f"min({c}), max({c})" if kind == "datetime" else "NULL::TIMESTAMP, NULL::TIMESTAMP"
        parts.append(
            f"SELECT '{c}' AS column_name, '{kind}' AS kind, CAST({miss} AS BIGINT) AS n_missing, "
            f"({miss}) * 100.0 / count(*) AS pct_missing, {vals.replace(', ', ' , ')}, {cat}, {ts} FROM trials_null")
    body = "\nUNION ALL\n".join(parts)
    inner = ("SELECT column_name, kind, n_missing, pct_missing, v1 AS min, v2 AS max, v3 AS mean, v4 AS median, "
             "v5 AS std, n_unique, top, ts_min, ts_max FROM (\n" + body.replace(
                 "FROM trials_null", "FROM trials_null") + "\n) u(column_name, kind, n_missing, pct_missing, v1, v2, v3, v4, "
             "v5, n_unique, top, ts_min, ts_max)")
    return with_ctes(rounded(inner, ["pct_missing", "min", "max", "mean", "median", "std"]), "trials_null")


@register("profile_table", _profile_sql())
def q_profile_table(spark, d):
    t = roles.trials_null_view(spark, d)
    return out(stats.profile_table(t, _PROFILE_COLS))


@register("profile_totals", with_ctes(rounded(
    "SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, "
    "CAST(sum((label IS NULL)::INT) + sum((k IS NULL)::INT) AS BIGINT) AS missing, "
    "(sum((label IS NULL)::INT) + sum((k IS NULL)::INT)) * 100.0 / (count(*) * 6) AS missing_pct FROM trials_null",
    ["missing_pct"]), "trials_null"))
def q_profile_totals(spark, d):
    return out(stats.profile_totals(roles.trials_null_view(spark, d)))


@register("overview", with_ctes(rounded(
    "SELECT count(DISTINCT entity) AS n_entities, count(*) AS n_rows, list_sort(list_distinct(list(condition))) AS conditions, "
    "avg(label) AS label_mean, stddev_samp(label) AS label_std, min(label) AS label_min, max(label) AS label_max FROM trials",
    ["label_mean", "label_std", "label_min", "label_max"]), "trials"))
def q_overview(spark, d):
    t = roles.trials_view(spark, d)
    return out(stats.overview(t, "entity", "condition", "label"))


@register("category_counts", with_ctes(
    "SELECT CASE WHEN entity LIKE '8%' THEN 'minimal_exp' WHEN entity LIKE '9%' THEN 'commercial' "
    "ELSE 'air_force' END AS category, count(*) AS n FROM trials GROUP BY 1", "trials"))
def q_category_counts(spark, d):
    from vitalis.functions.columns import entity_category

    t = roles.trials_view(spark, d).withColumn("category", entity_category("entity"))
    return stats.category_counts(t, "category")


@register("entity_stats", with_ctes(rounded(
    "SELECT entity, count(*) AS n, avg(label) AS mean, stddev_pop(label) AS std, min(label) AS min, "
    "max(label) AS max, quantile_cont(label, 0.5) AS median FROM trials WHERE label IS NOT NULL GROUP BY entity",
    ["mean", "std", "min", "max", "median"]), "trials"))
def q_entity_stats(spark, d):
    return out(stats.entity_stats(roles.trials_view(spark, d), "entity", "label"))


# =============================================================== E: per-entity windows

@register("entity_zscore", with_ctes(rounded(
    """SELECT t.row_id, t.entity,
  CASE WHEN s.n >= 3 THEN CASE WHEN s.s1 > 0 THEN (t.label - s.m1) / s.s1 ELSE 0.0 END END AS label_pilot_norm,
  CASE WHEN s.n >= 3 THEN CASE WHEN s.s2 > 0 THEN (t.k - s.m2) / s.s2 ELSE 0.0 END END AS k_pilot_norm
FROM trials t JOIN (SELECT entity, count(*) AS n, avg(label) AS m1, stddev_samp(label) AS s1,
                           avg(k) AS m2, stddev_samp(k) AS s2 FROM trials GROUP BY entity) s USING (entity)""",
    ["label_pilot_norm", "k_pilot_norm"]), "trials"))
def q_entity_zscore(spark, d):
    t = roles.trials_view(spark, d)
    z = features.entity_zscore(t, "entity", ["label", "k"])
    return out(z.select("row_id", "entity", "label_pilot_norm", "k_pilot_norm"))


# =============================================================== metrics

@register("regression_metrics", with_ctes(rounded(
    f"SELECT count(*) AS n, {reg_aggs('y_true', 'y_pred')} FROM preds_reg",
    ["mse", "rmse", "mae", "r2", "explained_variance", "mape", "median_ae", "max_error"],
    overrides={"mse": 0, "rmse": 4, "mae": 4, "median_ae": 4, "max_error": 4}), "preds_reg"))
def q_regression_metrics(spark, d):
    p = roles.preds_reg_view(spark, d)
    return out(metrics.regression_metrics(p), mse=0, rmse=4, mae=4, median_ae=4, max_error=4)


_ENTITY_MEAN_PREDS = """p AS (SELECT t.row_id, t.entity, t.label AS y_true, m.mu AS y_pred
       FROM trials t JOIN (SELECT entity, avg(label) AS mu FROM trials GROUP BY entity) m USING (entity))"""


def entity_mean_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predict each trial's label with its entity's mean label (the sanity baseline)."""
    t = roles.trials_view(spark, d)
    mu = t.groupBy("entity").agg(F.avg("label").alias("y_pred"))
    return t.join(mu, "entity").select("row_id", "entity", F.col("label").alias("y_true"), "y_pred")


@register("metrics_by_entity_reg", with_ctes(rounded(
    f"WITH {_ENTITY_MEAN_PREDS} SELECT entity, count(*) AS n, {reg_aggs('y_true', 'y_pred', ('mse', 'rmse', 'mae', 'r2'))} "
    "FROM p GROUP BY entity", ["mse", "rmse", "mae", "r2"]), "trials"))
def q_metrics_by_entity_reg(spark, d):
    return out(metrics.metrics_by_entity_reg(entity_mean_predictions(spark, d), "entity"))
