"""Split and fold queries (replayable md5 buckets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalis.functions.columns import md5_unit_sql
from vitalis.operators import split
from vitalis.plans import roles
from vitalis.plans.registry import register
from vitalis.plans.roles import with_ctes

_U = md5_unit_sql(42, "row_id")


@register("split_random", with_ctes(
    f"SELECT row_id, CASE WHEN {_U} < 0.2 THEN 'test' ELSE 'train' END AS split FROM trials", "trials"))
def q_split_random(spark, d):
    return split.split_random(roles.trials_view(spark, d), "row_id", 0.2, 42).select("row_id", "split")


@register("split_stratified", with_ctes(f"""SELECT row_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split
FROM (SELECT row_id, row_number() OVER (PARTITION BY condition ORDER BY {_U}, row_id) AS rn,
             count(*) OVER (PARTITION BY condition) AS n FROM trials) t""", "trials"))
def q_split_stratified(spark, d):
    return split.split_stratified(roles.trials_view(spark, d), "row_id", "condition", 0.2, 42).select("row_id", "split")


@register("kfold", with_ctes(f"""SELECT row_id, CAST((row_number() OVER (ORDER BY {_U}, row_id) - 1) % 5 AS INTEGER) AS fold
FROM trials""", "trials"))
def q_kfold(spark, d):
    return split.kfold(roles.trials_view(spark, d), "row_id", 5, 42).select("row_id", "fold")


@register("stratified_kfold", with_ctes(f"""SELECT row_id,
  CAST((row_number() OVER (PARTITION BY condition ORDER BY {_U}, row_id) - 1) % 5 AS INTEGER) AS fold FROM trials""",
    "trials"))
def q_stratified_kfold(spark, d):
    return split.stratified_kfold(roles.trials_view(spark, d), "row_id", "condition", 5, 42).select("row_id", "fold")


@register("timeseries_split", with_ctes("""WITH r AS (SELECT row_id, row_number() OVER (ORDER BY ts, row_id) - 1 AS rk,
                  count(*) OVER () AS n FROM trials),
f AS (SELECT unnest(range(3)) AS fold)
SELECT row_id, CAST(fold AS INTEGER) AS fold,
  CASE WHEN rk < n - 3 * (n // 4) + fold * (n // 4) THEN 'train' ELSE 'test' END AS role
FROM r, f WHERE rk < n - 3 * (n // 4) + (fold + 1) * (n // 4)""", "trials"))
def q_timeseries_split(spark, d):
    t = roles.trials_view(spark, d)
    return split.timeseries_split(t, ["ts", "row_id"], 3).select("row_id", "fold", "role")


@register("group_kfold", with_ctes("""WITH RECURSIVE g AS (
  SELECT entity, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, entity) AS rn FROM trials GROUP BY entity),
r(step, loads, entity, fold) AS (
  SELECT 0, [0, 0, 0, 0, 0]::BIGINT[], NULL::VARCHAR, NULL::INTEGER
  UNION ALL
  SELECT r.step + 1,
         list_transform(range(5), lambda i: r.loads[i + 1]
                        + CASE WHEN i = list_position(r.loads, list_min(r.loads)) - 1 THEN g.n ELSE 0 END),
         g.entity, CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INTEGER)
  FROM r JOIN g ON g.rn = r.step + 1)
SELECT t.row_id, t.entity, f.fold FROM trials t JOIN (SELECT entity, fold FROM r WHERE step > 0) f USING (entity)""",
    "trials"))
def q_group_kfold(spark, d):
    """Greedy size-balanced group folds: largest group first onto the lightest fold (lowest index on ties)."""
    t = roles.trials_view(spark, d)
    return split.group_kfold(t, "entity", 5).select("row_id", "entity", "fold")


__all__ = ["F"]
