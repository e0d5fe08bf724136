"""Aggregate, correlation, group-feature, set and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalis.functions.columns import entity_category
from vitalis.operators import features, stats
from vitalis.operators.quantiles import grouped_quantiles
from vitalis.plans import roles
from vitalis.plans.registry import out, register
from vitalis.plans.roles import with_ctes
from vitalis.plans.sqlhelp import rounded

_CAT_SQL = ("CASE WHEN entity LIKE '8%' THEN 'minimal_exp' WHEN entity LIKE '9%' THEN 'commercial' "
            "ELSE 'air_force' END")

# ------------------------------------------------------------------ B5 / B8

_RULES_SQL = [
    ("qty_positive", "qty > 0"),
    ("price_nonneg", "price >= 0"),
    ("disc_range", "disc BETWEEN 0 AND 0.1"),
    ("n_at_most_7", "n <= 7"),
    ("total_above_price", "o_totalprice > price"),
]


def _rules():
    c = F.col
    return {
        "qty_positive": c("qty") > 0,
        "price_nonneg": c("price") >= 0,
        "disc_range": c("disc").between(0, 0.1),
        "n_at_most_7": c("n") <= 7,
        "total_above_price": c("o_totalprice") > c("price"),
    }


@register("validate_rules", with_ctes("\nUNION ALL\n".join(
    f"SELECT '{n}' AS rule, CAST(count_if(NOT coalesce({e}, false)) AS BIGINT) AS violations, "
    f"count_if(NOT coalesce({e}, false)) = 0 AS ok, CAST(NULL AS VARCHAR) AS error FROM ofeat" for n, e in _RULES_SQL), "ofeat"))
def q_validate_rules(spark, d):
    return stats.validate_rules(roles.ofeat_view(spark, d), _rules())


_ANOM_COLS = ["qty", "price", "disc", "tax"]


@register("zscore_anomalies", with_ctes(rounded("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, o.row_id, (o.{c} - s.m) / s.s AS z FROM ofeat o, "
    f"(SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM ofeat) s WHERE abs((o.{c} - s.m) / s.s) > 3.0"
    for c in _ANOM_COLS), ["z"]), "ofeat"))
def q_zscore_anomalies(spark, d):
    return out(stats.zscore_anomalies(roles.ofeat_view(spark, d), _ANOM_COLS, "row_id", 3.0))


# ------------------------------------------------------------------ D4 / D5 / D7 / D8

def _pearson_sql(table: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            xa, xb = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, covar_pop({xa}, {xb}) / "
                         f"nullif(stddev_pop({xa}) * stddev_pop({xb}), 0) AS r FROM {table}")
    return "\nUNION ALL\n".join(parts)


_CORR_COLS = ["qty", "price", "disc", "tax", "o_totalprice"]


@register("corr_pearson", with_ctes(rounded(_pearson_sql("ofeat", _CORR_COLS), ["r"]), "ofeat"))
def q_corr_pearson(spark, d):
    return out(stats.corr_pearson(roles.ofeat_view(spark, d), _CORR_COLS))


@register("corr_pearson_nulls", with_ctes(rounded(_pearson_sql("trials_null", ["label", "k", "row_id"]), ["r"]),
                                          "trials_null"))
def q_corr_pearson_nulls(spark, d):
    return out(stats.corr_pearson(roles.trials_null_view(spark, d), ["label", "k", "row_id"]))


_SPEAR_COLS = ["qty", "price", "disc"]


def _spearman_sql() -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _SPEAR_COLS)
    return f"WITH rk AS (SELECT {ranks} FROM ofeat)\n" + rounded(_pearson_sql("rk", _SPEAR_COLS), ["r"])


@register("corr_spearman", with_ctes(_spearman_sql(), "ofeat"))
def q_corr_spearman(spark, d):
    return out(stats.corr_spearman(roles.ofeat_view(spark, d), _SPEAR_COLS))


_NULL_COLS = ["label", "k", "row_id"]


def _spearman_nulls_sql() -> str:
    """Every pair ranked among the rows that hold both columns."""
    parts = []
    for a in _NULL_COLS:
        for b in _NULL_COLS:
            rank = {x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0" for x in (a, b)}
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS r "
                         f"FROM (SELECT {rank[a]} AS ra, {rank[b]} AS rb FROM trials_null WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t")
    return with_ctes(rounded("\nUNION ALL\n".join(parts), ["r"]), "trials_null")


@register("corr_spearman_nulls", _spearman_nulls_sql())
def q_corr_spearman_nulls(spark, d):
    return out(stats.corr_spearman(roles.trials_null_view(spark, d), _NULL_COLS))


def _wide(n: int) -> list[tuple[str, str]]:
    """Features of lineitem rows, some missing where a line number is even."""
    parts = ["l_quantity * {0}", "l_extendedprice % (100.0 + {0})", "CASE WHEN l_linenumber % 2 = 1 THEN l_discount * l_quantity + {0} END", "l_tax * (l_partkey % ({0} + 2))"]
    return [(f"f{i}", parts[i % 4].format(i + 1)) for i in range(n)]


_WIDE = _wide(24)


@register("corr_pearson_wide", "WITH w AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE) + " FROM lineitem)\n"
          + rounded(_pearson_sql("w", [c for c, _ in _WIDE]), ["r"]))
def q_corr_pearson_wide(spark, d):
    li = roles.table(spark, d, "lineitem").selectExpr(*[f"cast({e} as double) AS {c}" for c, e in _WIDE])
    return out(stats.corr_pearson(li, [c for c, _ in _WIDE]))


_PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


@register("grouped_quantiles", rounded(f"""SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, {_PROBS}) AS price,
  quantile_cont(l_quantity, {_PROBS}) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus""", [], arrays=["price", "qty"]))
def q_grouped_quantiles(spark, d):
    """Quantiles per group; groups of over 2,000 rows are selected by brackets."""
    li = roles.table(spark, d, "lineitem")
    q = grouped_quantiles(li, ["l_returnflag", "l_linestatus"], {"price": "l_extendedprice", "qty": "l_quantity"}, _PROBS, small=2000)
    return out(q)


@register("corr_with_target", with_ctes(rounded(
    "SELECT feature, r, abs(r) AS abs_r FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, covar_pop({c}, price) / nullif(stddev_pop({c}) * stddev_pop(price), 0) AS r FROM ofeat"
        for c in ["qty", "disc", "tax", "n", "o_totalprice"]) + ") t ORDER BY abs(r) DESC NULLS LAST, feature LIMIT 3",
    ["r", "abs_r"]), "ofeat"))
def q_corr_with_target(spark, d):
    o = roles.ofeat_view(spark, d)
    return out(stats.corr_with_target(o, ["qty", "disc", "tax", "n", "o_totalprice"], "price", top=3))


# ------------------------------------------------------------------ D9

@register("duplicates", """SELECT l_orderkey, l_linenumber, count(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_duplicates(spark, d):
    li = roles.table(spark, d, "lineitem")
    return stats.duplicates(li, ["l_orderkey", "l_linenumber"])


@register("duplicate_rows", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, g.n
FROM lineitem l JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
                      GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) g USING (l_orderkey, l_linenumber)""")
def q_duplicate_rows(spark, d):
    li = roles.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return stats.duplicate_rows(li, ["l_orderkey", "l_linenumber"])


@register("duplicate_summary", rounded("""SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS total_duplicates,
  CAST(count_if(n > 1) AS BIGINT) AS duplicate_groups,
  sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100.0 / sum(n) AS duplicate_pct
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) g""", ["duplicate_pct"]))
def q_duplicate_summary(spark, d):
    return out(stats.duplicate_summary(roles.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


# ------------------------------------------------------------------ D10 / D11 / D12 / D13

@register("distribution_summary", with_ctes(rounded("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS std, "
    f"skewness({c}) AS skew, kurtosis({c}) AS kurtosis FROM trials" for c in ["label", "k"]),
    ["mean", "median", "std", "skew", "kurtosis"]), "trials"))
def q_distribution_summary(spark, d):
    return out(stats.distribution_summary(roles.trials_view(spark, d), ["label", "k"]))


@register("histogram", with_ctes(rounded("""WITH mm AS (SELECT min(label) AS lo, max(label) AS hi FROM trials),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS w FROM mm)
SELECT condition, bin, count(*) AS n, lo + bin * w AS lo, lo + (bin + 1) * w AS hi FROM (
  SELECT t.condition, CAST(least(floor((t.label - w.lo) / w.w), 19) AS INTEGER) AS bin, w.lo, w.w
  FROM trials t, w WHERE t.label IS NOT NULL) b GROUP BY condition, bin, lo, w""", ["lo", "hi"]), "trials"))
def q_histogram(spark, d):
    return out(stats.histogram(roles.trials_view(spark, d), "label", 20, hue="condition"))


_CATS = ["air_force", "commercial", "minimal_exp"]


@register("crosstab_mean", with_ctes(rounded(
    "SELECT condition, " + ", ".join(f"avg(CASE WHEN {_CAT_SQL} = '{c}' THEN label END) AS {c}" for c in _CATS)
    + " FROM trials GROUP BY condition", _CATS), "trials"))
def q_crosstab_mean(spark, d):
    t = roles.trials_view(spark, d).withColumn("category", entity_category("entity"))
    return out(stats.crosstab_mean(t, "condition", "category", "label", _CATS))


@register("box_stats", with_ctes(rounded("""WITH q AS (
  SELECT condition, quantile_cont(label, 0.25) AS q1, quantile_cont(label, 0.5) AS median,
         quantile_cont(label, 0.75) AS q3 FROM trials GROUP BY condition)
SELECT q.condition, q.q1, q.median, q.q3,
  min(CASE WHEN t.label BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN t.label END) AS whisker_lo,
  max(CASE WHEN t.label BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN t.label END) AS whisker_hi,
  CAST(count_if(NOT (t.label BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1))) AS BIGINT) AS n_outliers
FROM trials t JOIN q USING (condition) GROUP BY q.condition, q.q1, q.median, q.q3""",
    ["q1", "median", "q3", "whisker_lo", "whisker_hi"]), "trials"))
def q_box_stats(spark, d):
    return out(stats.box_stats(roles.trials_view(spark, d), "condition", "label"))


# ------------------------------------------------------------------ D15 / D19 / D20

@register("error_by_group", with_ctes(rounded("\nUNION ALL\n".join(
    f"SELECT '{g}' AS dim, CAST({g} AS VARCHAR) AS value, avg(abs(y_true - y_pred)) AS mean_abs_error, "
    f"stddev_samp(abs(y_true - y_pred)) AS std_abs_error, count(*) AS n, "
    f"avg(abs(y_true - y_pred) / (abs(y_true) + 1e-10)) AS mean_rel_error FROM preds_reg GROUP BY {g}"
    for g in ["grp", "status"]), ["mean_abs_error", "std_abs_error", "mean_rel_error"],
    overrides={"mean_abs_error": 4, "std_abs_error": 4}), "preds_reg"))
def q_error_by_group(spark, d):
    p = roles.preds_reg_view(spark, d)
    return out(stats.error_by_group(p, "y_true", "y_pred", ["grp", "status"]), mean_abs_error=4, std_abs_error=4)


@register("qcut", with_ctes("""WITH e AS (SELECT quantile_cont(price, 0.3333333333333333) AS e1,
                    quantile_cont(price, 0.6666666666666666) AS e2 FROM ofeat)
SELECT o.row_id, CASE WHEN o.price <= e.e1 THEN 'Low' WHEN o.price <= e.e2 THEN 'Medium' ELSE 'High' END AS qclass
FROM ofeat o, e""", "ofeat"))
def q_qcut(spark, d):
    return stats.qcut3(roles.ofeat_view(spark, d), "price").select("row_id", "qclass")


@register("accuracy_by_group", with_ctes(rounded(
    "SELECT grp, avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy, count(*) AS n FROM preds_bin GROUP BY grp",
    ["accuracy"]), "preds_bin"))
def q_accuracy_by_group(spark, d):
    return out(stats.accuracy_by_group(roles.preds_bin_view(spark, d), "y_true", "y_pred", "grp"))


# ------------------------------------------------------------------ G1 / G2 / E11 / F1 / F2

@register("distinct_counts", with_ctes("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_unique FROM trials" for c in ["entity", "condition", "k"]),
    "trials"))
def q_distinct_counts(spark, d):
    return stats.distinct_counts(roles.trials_view(spark, d), ["entity", "condition", "k"])


@register("union_trials", with_ctes("""SELECT * FROM (SELECT row_id, entity, condition, label, k FROM trials WHERE condition IN ('view', 'click'))
UNION ALL BY NAME
SELECT * FROM (SELECT row_id, entity, condition, label FROM trials WHERE condition NOT IN ('view', 'click'))""", "trials"))
def q_union_trials(spark, d):
    t = roles.trials_view(spark, d)
    first = F.col("condition").isin("view", "click")
    a = t.where(first).select("row_id", "entity", "condition", "label", "k")
    b = t.where(~first).select("row_id", "entity", "condition", "label")
    return stats.union_all([a, b])


@register("first_n_per_group", with_ctes("""SELECT entity, row_id FROM (
  SELECT entity, row_id, row_number() OVER (PARTITION BY entity ORDER BY ts, row_id) AS rn FROM trials) t
WHERE rn <= 2""", "trials"))
def q_first_n_per_group(spark, d):
    t = roles.trials_view(spark, d)
    return stats.first_n_per_group(t, "entity", ["ts", "row_id"], 2).select("entity", "row_id")


@register("topk", rounded("""SELECT p_name, p_retailprice, p_size FROM part
ORDER BY p_retailprice DESC NULLS LAST, p_name LIMIT 10""", ["p_retailprice"]))
def q_topk(spark, d):
    return out(stats.topk(roles.table(spark, d, "part"), "p_retailprice", "p_name", 10, extra=["p_size"]))


@register("worst_predictions", with_ctes(rounded("""SELECT row_id, y_true, y_pred, abs(y_true - y_pred) AS abs_error, grp, status
FROM preds_reg ORDER BY abs(y_true - y_pred) DESC, row_id LIMIT 10""", ["y_true", "y_pred", "abs_error"], digits=4),
    "preds_reg"))
def q_worst_predictions(spark, d):
    p = roles.preds_reg_view(spark, d).withColumn("abs_error", F.abs(F.col("y_true") - F.col("y_pred")))
    w = p.orderBy(F.col("abs_error").desc(), "row_id").limit(10)
    return out(w.select("row_id", "y_true", "y_pred", "abs_error", "grp", "status"), 4)


# ------------------------------------------------------------------ C1 / C3 / C4 / E2 / E3

@register("group_baseline", with_ctes(rounded("""WITH r AS (SELECT *, price / (disc + 1e-06) AS ratio FROM ofeat),
s AS (SELECT o_orderpriority, avg(price) AS mp, avg(qty) AS mq, quantile_cont(ratio, 0.5) AS mr
      FROM r GROUP BY o_orderpriority)
SELECT r.row_id, r.price - s.mp AS price_resp, r.qty - s.mq AS qty_resp, r.ratio,
       r.ratio / (s.mr + 1e-06) AS ratio_norm
FROM r JOIN s USING (o_orderpriority)""", ["price_resp", "qty_resp", "ratio", "ratio_norm"], digits=4), "ofeat"))
def q_group_baseline(spark, d):
    o = roles.ofeat_view(spark, d)
    g = features.group_baseline(o, "o_orderpriority", {"price": "price_resp", "qty": "qty_resp"},
                                ratio=("price", "disc", "ratio", "ratio_norm"))
    return out(g.select("row_id", "price_resp", "qty_resp", "ratio", "ratio_norm"), 4)


@register("attach_metadata", with_ctes("""SELECT p.row_id, p.y_true, p.y_pred, o.o_orderstatus, o.o_custkey
FROM preds_reg p JOIN (SELECT o_orderkey AS row_id, o_orderstatus, o_custkey FROM orders) o USING (row_id)""",
                                       "preds_reg"))
def q_attach_metadata(spark, d):
    p = roles.preds_reg_view(spark, d).select("row_id", "y_true", "y_pred")
    meta = roles.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus", "o_custkey")
    return features.attach_metadata(p, meta)


@register("annotate_regions", with_ctes("""WITH ends AS (SELECT entity, max(i) AS t_end FROM series GROUP BY entity),
reg AS (SELECT s.entity, s.i AS start, least(s.i + 5, e.t_end) AS "end" FROM series s JOIN ends e USING (entity)
        WHERE s.condition = 'error' AND s.i <= e.t_end)
SELECT s.entity, s.i, CAST(count(r.start) AS BIGINT) AS n_regions
FROM series s LEFT JOIN reg r ON s.entity = r.entity AND s.i BETWEEN r.start AND r."end"
GROUP BY s.entity, s.i""", "series"))
def q_annotate_regions(spark, d):
    s = roles.series_view(spark, d)
    ends = s.groupBy("entity").agg(F.max("i").alias("t_end"))
    regions = s.where(F.col("condition") == "error").select("entity", F.col("i").alias("start"),
                                                           (F.col("i") + 5).alias("end"))
    regions = features.clip_regions(regions, ends, "entity")
    samples = s.select("entity", F.col("i"))
    return features.annotate_samples(samples, regions, "entity", t="i", bucket=8.0)


@register("percentile_of_score", with_ctes(rounded("""SELECT row_id, entity,
  (count(*) OVER w_lt + count(*) OVER w_le + 1) / (2.0 * count(*) OVER w_all) AS label_pct
FROM (SELECT * FROM trials WHERE label IS NOT NULL) t
WINDOW w_all AS (PARTITION BY entity),
       w_le AS (PARTITION BY entity ORDER BY label RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       w_lt AS (PARTITION BY entity ORDER BY label RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)""",
    ["label_pct"]), "trials"))
def q_percentile_of_score(spark, d):
    t = roles.trials_view(spark, d)
    return out(features.percentile_of_score(t, "entity", "label").select("row_id", "entity", "label_pct"))


@register("normalize_label_zscore", with_ctes(rounded("""SELECT t.row_id, (t.label - s.m) / nullif(s.sd, 0) AS label_norm
FROM trials t JOIN (SELECT entity, avg(label) AS m, stddev_pop(label) AS sd FROM trials GROUP BY entity) s USING (entity)""",
    ["label_norm"]), "trials"))
def q_normalize_label_zscore(spark, d):
    t = roles.trials_view(spark, d)
    return out(features.normalize_label(t, "entity", "label", "zscore").select("row_id", "label_norm"))


@register("normalize_label_minmax", with_ctes(rounded("""SELECT t.row_id,
  CASE WHEN s.mx - s.mn = 0 THEN 0.5 ELSE (t.label - s.mn) / (s.mx - s.mn) END AS label_norm
FROM trials t JOIN (SELECT entity, min(label) AS mn, max(label) AS mx FROM trials GROUP BY entity) s USING (entity)""",
    ["label_norm"]), "trials"))
def q_normalize_label_minmax(spark, d):
    t = roles.trials_view(spark, d)
    return out(features.normalize_label(t, "entity", "label", "minmax").select("row_id", "label_norm"))
