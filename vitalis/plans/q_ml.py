"""Model queries on the order feature table (Spark ML); most are checked by rows + invariant tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.functions.columns import md5_unit, md5_unit_sql
from vitalis.operators import isoforest, kendall, ml, stats
from vitalis.operators import metrics as M
from vitalis.operators.gram import gram
from vitalis.plans import experiments, roles
from vitalis.plans.registry import out, register
from vitalis.plans.roles import with_ctes
from vitalis.plans.sqlhelp import rounded
from vitalis.session import written

FEATS = ["qty", "disc", "tax", "n"]


def _data(spark: SparkSession, d: str) -> DataFrame:
    o = roles.ofeat_view(spark, d)
    return o.withColumn("_u", md5_unit(42, "row_id"))


def _split(spark, d):
    o = _data(spark, d)
    return o.where(F.col("_u") >= 0.2), o.where(F.col("_u") < 0.2)


def _model(spark, d, kind, label, task, params=None) -> ml.TabularModel:
    train, _ = _split(spark, d)
    return ml.TabularModel(kind, task, dict(params or {})).fit(train, FEATS, label)


def _stored_split(spark, d, label):
    """``_split`` with the features and a label, read from a table that is written once."""
    o = written(_data(spark, d).select("row_id", label, *FEATS, (F.col("_u") < 0.2).alias("_test")), "orders")
    return o.where(~F.col("_test")), o.where("_test")


def _fit_predict(spark, d, kind, label, task, params=None):
    m = _model(spark, d, kind, label, task, params)
    _, test = _split(spark, d)
    return m, m.transform(test)


# Fitted models have no SQL, but much of what makes them right has: the keys of the rows they answer
# for, the conditions that an optimum meets, the sums that add up and the scores to beat.  Each query fits
# its model, states such facts as columns, and its oracle says what they must be.

_U = md5_unit_sql(42, "row_id")
_TEST = f"{_U} < 0.2"


def _judged(pred: DataFrame, label: str, regression: bool = True) -> DataFrame:
    """row_id, the label, and whether the model beats the constant prediction (regression: the mean; classes: all
    predictions are classes of the label, with probabilities that add up to 1)."""
    if regression:
        r = M.regression_metrics(pred, label, "y_pred", metrics=("r2",)).first()
        return out(pred.select("row_id", label, F.lit(r["r2"] is not None and r["r2"] > 0).alias("beats_mean")), 2)
    known = [x[0] for x in pred.select(label).distinct().collect()]
    sure = F.abs(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6 if "proba" in pred.columns else F.lit(True)
    return pred.select("row_id", label, F.col("y_pred").isin(known).alias("known"), sure.alias("adds_up"))


def _judged_sql(label: str, regression: bool = True) -> str:
    if regression:
        return with_ctes(rounded(f"SELECT row_id, {label}, TRUE AS beats_mean FROM ofeat WHERE {_TEST}", [label], digits=2), "ofeat")
    return with_ctes(f"SELECT row_id, {label}, TRUE AS known, TRUE AS adds_up FROM ofeat WHERE {_TEST}", "ofeat")


@register("rf", _judged_sql("price"))
def q_rf(spark, d):
    """Random forest regression (100 trees, seed 42): test rows."""
    _, p = _fit_predict(spark, d, "rf", "price", "regression")
    return _judged(p, "price")


@register("rf_classifier", _judged_sql("o_orderpriority", False))
def q_rf_classifier(spark, d):
    """Random forest classes of order priorities."""
    _, p = _fit_predict(spark, d, "rf", "o_orderpriority", "classification")
    return _judged(p, "o_orderpriority", False)


@register("gbt", _judged_sql("price"))
def q_gbt(spark, d):
    """Gradient boosting regression (100 rounds, step 0.1, depth 3): test rows."""
    _, p = _fit_predict(spark, d, "gb", "price", "regression")
    return _judged(p, "price")


@register("svm", _judged_sql("o_orderstatus", False))
def q_svm(spark, d):
    """RBF-kernel SVM via random Fourier features + one-vs-rest linear SVMs."""
    train, test = _stored_split(spark, d, "o_orderstatus")
    p = ml.TabularModel("svm", "classification").fit(train, FEATS, "o_orderstatus", stored=True).transform(test)
    return _judged(p, "o_orderstatus", False)


@register("mlp", _judged_sql("o_orderstatus", False))
def q_mlp(spark, d):
    """Multilayer perceptron classifier (100 hidden units, up to 500 iterations)."""
    _, p = _fit_predict(spark, d, "mlp", "o_orderstatus", "classification")
    return _judged(p, "o_orderstatus", False)


def _optimal(m: ml.TabularModel, train: DataFrame, lam: float, l1: float) -> dict[str, bool]:
    """Whether each coefficient of an elastic net meets the condition of an optimum: the slope of the squared error
    along it is the penalty's where it is not 0, and no larger than the L1 part where it is; residuals average 0."""
    fitted = m.model_.stages[-1]
    coef = dict(zip(FEATS, fitted.coefficients.toArray().tolist(), strict=True))
    rest = F.col("price") - F.lit(fitted.intercept) - sum(F.lit(coef[f]) * F.col(f) for f in FEATS)
    row = train.agg(*[F.avg(F.col(f) * rest).alias(f) for f in FEATS], F.avg(rest).alias("_r"), F.max(F.abs("price")).alias("_s"),
                    *[F.avg(F.abs(F.col(f) * F.col("price"))).alias(f"_{f}") for f in FEATS]).first()
    out = {"": abs(row["_r"]) < 1e-6 * row["_s"]}
    for f in FEATS:
        b, near = coef[f], 1e-4 * row[f"_{f}"] + 1e-9
        slope = row[f] - lam * (1 - l1) * b
        out[f] = abs(slope - lam * l1 * (1 if b > 0 else -1)) < near if b else abs(slope) < lam * l1 + near
    return out


@register("elastic", with_ctes(rounded(f"SELECT row_id, price, TRUE AS beats_mean, TRUE AS optimal FROM ofeat WHERE {_TEST}", ["price"], digits=2), "ofeat"))
def q_elastic(spark, d):
    """Elastic net (alpha 1, l1_ratio 0.5) with the textbook penalty: test rows, and whether the conditions of an optimum hold."""
    m, p = _fit_predict(spark, d, "elastic", "price", "regression")
    train, _ = _split(spark, d)
    return _judged(p, "price").withColumn("optimal", F.lit(all(_optimal(m, train, 1.0, 0.5).values())))


@register("logistic", with_ctes(f"""SELECT row_id, o_orderstatus, TRUE AS known, TRUE AS adds_up, TRUE AS shares_match FROM ofeat WHERE {_TEST}""", "ofeat"))
def q_logistic(spark, d):
    """Logistic classes; with free intercepts an optimum gives each class its share of the training rows on average."""
    m, p = _fit_predict(spark, d, "logistic", "o_orderstatus", "classification")
    train, _ = _split(spark, d)
    t = m.transform(train)
    mean = t.agg(*[F.avg(F.get("proba", i) - (F.col("o_orderstatus") == c).cast("double")).alias(str(i)) for i, c in enumerate(m.labels_)]).first()
    return _judged(p, "o_orderstatus", False).withColumn("shares_match", F.lit(all(abs(x) < 0.01 for x in mean)))


@register("ols", with_ctes(rounded("""SELECT regr_slope(price, qty) AS slope, regr_intercept(price, qty) AS intercept,
  regr_r2(price, qty) AS r2, regr_count(price, qty) AS n FROM ofeat""", ["slope", "intercept", "r2"], digits=4),
    "ofeat"))
def q_ols(spark, d):
    return out(ml.ols(roles.ofeat_view(spark, d), "qty", "price"), 4)


@register("model_evaluate", with_ctes(f"SELECT count(*) AS n, TRUE AS beats_mean, TRUE AS consistent FROM ofeat WHERE {_TEST}", "ofeat"))
def q_model_evaluate(spark, d):
    """Fit + evaluate: the forest's metrics on the test split, each in its relation to the others."""
    _, test = _split(spark, d)
    e = _model(spark, d, "rf", "price", "regression").evaluate(test)
    ok = (F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) < 1e-6 * F.col("mse")) & (F.col("mae") <= F.col("rmse")) & (F.col("median_ae") <= F.col("max_error")) & (F.col("rmse") <= F.col("max_error"))
    return e.select("n", (F.col("r2") > 0).alias("beats_mean"), ok.alias("consistent"))


@register("pipeline_model", _judged_sql("price"))
def q_pipeline_model(spark, d):
    """Exact standard scaler + forest as one fitted unit."""
    train, test = _split(spark, d)
    m = ml.ScaledModel("rf", "standard", "regression").fit(train, FEATS, "price")
    return _judged(m.transform(test), "price")


@register("importance", "SELECT unnest(['qty', 'disc', 'tax', 'n']) AS feature, TRUE AS in_range, 1.0::DOUBLE AS total")
def q_importance(spark, d):
    """Impurity importances of the forest: none negative, 1 in all."""
    i = _model(spark, d, "rf", "price", "regression").importances()
    total = i.agg(F.sum("importance")).first()[0]
    return out(stats.topk(i, "importance", "feature", len(FEATS)).select("feature", F.col("importance").between(0, 1).alias("in_range"), F.lit(total).alias("total")))


@register("select_features", "SELECT TRUE AS at_least_mean, TRUE AS some_kept")
def q_select_features(spark, d):
    """Features whose importance is at least the mean (fitted on the training rows): those and no others, not all."""
    i = _model(spark, d, "rf", "price", "regression").importances()
    keep, mean = ml.select_features(i, "mean"), i.agg(F.avg("importance")).first()[0]
    right = {r["feature"] for r in i.where(F.col("importance") >= mean).collect()} == set(keep)
    return spark.createDataFrame([(right, 0 < len(keep) < len(FEATS))], "at_least_mean boolean, some_kept boolean")


@register("permutation_importance", "SELECT f AS feature, TRUE AS size_counts, TRUE AS has_spread FROM (SELECT unnest(['qty', 'disc', 'tax', 'n']) AS f) t")
def q_permutation_importance(spark, d):
    """Mean and population std of the r2 drop over 10 permutations per feature: the price hangs on an order's
    quantity and lines, not on its discount and tax."""
    train, test = _stored_split(spark, d, "price")
    m = ml.TabularModel("rf", "regression").fit(train, FEATS, "price", stored=True)
    p = ml.permutation_importance(m, test, "row_id", 10, 42)
    top = stats.topk(p, "importance_mean", "feature", 1).first()["feature"]
    return p.select("feature", F.lit(top in ("qty", "n")).alias("size_counts"), (F.col("importance_std") >= 0).alias("has_spread"))


@register("cross_validate", "SELECT m AS metric, p AS part, 5::BIGINT AS folds, TRUE AS in_range FROM (SELECT unnest(['r2', 'mse']) AS m), (SELECT unnest(['test', 'train']) AS p)")
def q_cross_validate(spark, d):
    """5-fold scores (r2, mse) with train scores."""
    s = ml.cross_validate(_data(spark, d), FEATS, "price", "rf", 5, ("r2", "mse"), "regression", return_train=True)
    ok = F.when(F.col("metric") == "r2", F.col("score").between(0, 1)).otherwise(F.col("score") > 0)
    return s.groupBy("metric", "part").agg(F.count_distinct("fold").alias("folds"), F.every(ok).alias("in_range"))


_PENALTIES = {"alpha": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.5, 0.9]}


@register("grid_search", """SELECT '[(''alpha'', ' || a || '), (''l1_ratio'', ' || l || ')]' AS params, TRUE AS best_is_largest
FROM (SELECT unnest(['0.01', '0.1', '1.0', '10.0']) AS a), (SELECT unnest(['0.1', '0.5', '0.9']) AS l)""")
def q_grid_search(spark, d):
    """Every combination of penalty and mix of the elastic net with 5 folds, fits side by side."""
    res, best = ml.grid_search(_data(spark, d), FEATS, "price", "elastic", _PENALTIES, k=5, task="regression")
    top = stats.topk(res, "mean_score", "params", 1).first()["mean_score"]
    mean = res.where(F.col("params") == str(sorted(best.items()))).first()["mean_score"]
    return res.select("params", F.lit(mean == top).alias("best_is_largest"))


@register("random_search", _judged_sql("price"))
def q_random_search(spark, d):
    """Two of the 36 forest combinations with 5 folds; the best one, refitted, on the test split."""
    train, test = _split(spark, d)
    r = ml.random_search(train, FEATS, "price", "rf", ml.GRIDS["rf"], n_iter=2, task="regression")
    return _judged(r.model.transform(test), "price")


@register("learning_curve", """SELECT 'r2' AS metric, p AS part, f AS fraction, TRUE AS in_range
FROM (SELECT unnest(['test', 'train']) AS p), (SELECT unnest([0.1, 0.325, 0.55, 0.775, 1.0]::DOUBLE[]) AS f)""")
def q_learning_curve(spark, d):
    """Train/test r2 of the linear model over nested training fractions."""
    c = ml.learning_curve(_data(spark, d), FEATS, "price", "linear", 5, task="regression")
    return c.select("metric", "part", "fraction", (F.col("mean").between(0, 1) & (F.col("std") >= 0)).alias("in_range"))


def _ordinal_frame(spark, d):
    """The order table with its price classes; written once, as the edges, both fits and the predictions read it again and again."""
    o = written(_data(spark, d).select("row_id", "price", *FEATS, "_u"), "orders")
    return stats.qcut3(o, "price", out="y_class")


@register("ordinal_fit", with_ctes(f"""WITH e AS (SELECT quantile_cont(price, 0.3333333333333333) AS e1, quantile_cont(price, 0.6666666666666666) AS e2 FROM ofeat)
SELECT o.row_id, CASE WHEN o.price <= e.e1 THEN 'Low' WHEN o.price <= e.e2 THEN 'Medium' ELSE 'High' END AS y_class,
  TRUE AS known, TRUE AS adds_up, TRUE AS beats_guess FROM ofeat o, e WHERE {md5_unit_sql(42, 'o.row_id')} < 0.2""", "ofeat"))
def q_ordinal_fit(spark, d):
    """Ordinal classifier (2 class-weighted logistic models) on 3 price classes: test rows."""
    q = _ordinal_frame(spark, d)
    train, test = q.where(F.col("_u") >= 0.2), q.where(F.col("_u") < 0.2)
    p = ml.OrdinalClassifier(["Low", "Medium", "High"]).fit(train, FEATS, "y_class").transform(test)
    right = p.agg(F.avg((F.col("y_class") == F.col("y_pred")).cast("double"))).first()[0] or 0.0
    return _judged(p.withColumnRenamed("class_proba", "proba"), "y_class", False).withColumn("beats_guess", F.lit(right > 1 / 3))


def _cum_probs(spark, d):
    """P(y > k) for the 10 embedding classes from the softmax scores (1 - cumulative sum)."""
    p = roles.preds_multi_view(spark, d)
    cols = [(1 - F.aggregate(F.slice("scores", 1, k + 1), F.lit(0.0), lambda a, x: a + x)).alias(f"p_gt_{k}")
            for k in range(9)]
    return p.select("row_id", "y_true", *cols)


@register("ordinal_combine", with_ctes(rounded("""WITH c AS (SELECT row_id, y_true,
  list_transform(range(9), lambda k: 1 - list_sum(scores[1:k + 1])) AS pg FROM preds_multi)
SELECT row_id, y_true,
  CAST(least(len(list_filter(pg, lambda v: v >= 0.5)), 9) AS INTEGER) AS y_pred,
  [1 - pg[1]] || list_transform(range(1, 9), lambda k: pg[k] - pg[k + 1]) || [pg[9]] AS class_proba
FROM c""", [], arrays=["class_proba"]), "preds_multi"))
def q_ordinal_combine(spark, d):
    c = _cum_probs(spark, d)
    r = ml.ordinal_combine(c, [f"p_gt_{k}" for k in range(9)], list(range(10)))
    return out(r.select("row_id", "y_true", "y_pred", "class_proba"))


@register("ensemble_combine", with_ctes(rounded("""SELECT p.row_id, p.y_pred * (2.0 / 3.0) + o.o_totalprice * (1.0 / 3.0) AS y_pred
FROM preds_reg p JOIN ofeat o USING (row_id)""", ["y_pred"], digits=4), "preds_reg"))
def q_ensemble_combine(spark, d):
    p = roles.preds_reg_view(spark, d).join(roles.ofeat_view(spark, d).select("row_id", "o_totalprice"), "row_id")
    r = ml.ensemble_combine(p.withColumnRenamed("y_pred", "a"), ["a", "o_totalprice"], [2.0, 1.0], regression=True)
    return out(r.select("row_id", "y_pred"), 4)


@register("ensemble_vote", with_ctes("""WITH v AS (SELECT row_id, y_pred AS a, (y_pred + 1) % 10 AS b, y_true AS c FROM preds_multi),
votes AS (SELECT row_id, cand, sum(w) AS s FROM (
  SELECT row_id, CAST(a AS VARCHAR) AS cand, 0.5 AS w FROM v UNION ALL
  SELECT row_id, CAST(b AS VARCHAR), 0.25 FROM v UNION ALL SELECT row_id, CAST(c AS VARCHAR), 0.25 FROM v) x
  GROUP BY row_id, cand)
SELECT row_id, arg_max(cand, (s, -ascii(cand))) AS y_pred FROM (
  SELECT row_id, cand, s, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, cand) AS rn FROM votes) y
WHERE rn = 1 GROUP BY row_id""", "preds_multi"))
def q_ensemble_vote(spark, d):
    p = roles.preds_multi_view(spark, d)
    v = p.select("row_id", F.col("y_pred").alias("a"), ((F.col("y_pred") + 1) % 10).alias("b"), F.col("y_true").alias("c"))
    return ml.ensemble_combine(v, ["a", "b", "c"], [2.0, 1.0, 1.0], regression=False).select("row_id", "y_pred")


@register("ensemble_fit", _judged_sql("price"))
def q_ensemble_fit(spark, d):
    """Forest + boosting + elastic net averaged (regression) on the test split."""
    train, test = _split(spark, d)
    e = ml.Ensemble(("rf", "gb", "elastic"), task="regression").fit(train, FEATS, "price")
    return _judged(e.transform(test), "price")


@register("stacking", _judged_sql("price"))
def q_stacking(spark, d):
    """Out-of-fold forest + elastic-net predictions -> forest meta model."""
    train, test = _split(spark, d)
    s = ml.Stacking(("rf", "elastic"), "rf", 5, "regression").fit(train, FEATS, "price")
    return _judged(s.transform(test), "price")


_PCA = ["qty", "price", "disc", "tax", "o_totalprice"]
_SQUARES = " + ".join(f"power(corr({a}, {b}), 2)" for a in _PCA for b in _PCA)


@register("pca_variance", with_ctes(rounded(f"""SELECT unnest(range(1, 6))::INTEGER AS component, 1.0 AS total, TRUE AS falling, TRUE AS adds_up, ({_SQUARES}) / 25 AS squares
FROM ofeat""", ["total", "squares"]), "ofeat"))
def q_pca_variance(spark, d):
    """Shares of variance: they fall and add up to 1, and their squares to those of the correlations (the trace of the square)."""
    res, _ = ml.pca_variance(roles.ofeat_view(spark, d), _PCA)
    r = res.orderBy("component").collect()
    ratio = [x["variance_ratio"] for x in r]
    cum = all(abs(x["cumulative"] - sum(ratio[: i + 1])) < 1e-12 for i, x in enumerate(r))
    facts = [F.lit(sum(ratio)).alias("total"), F.lit(ratio == sorted(ratio, reverse=True)).alias("falling"), F.lit(cum).alias("adds_up"), F.lit(sum(x * x for x in ratio)).alias("squares")]
    return out(res.select("component", *facts))


@register("pca_project", with_ctes("SELECT row_id, TRUE AS finite, TRUE AS centred, TRUE AS uncorrelated, TRUE AS variances_match FROM ofeat", "ofeat"))
def q_pca_project(spark, d):
    """Scores on two components: centred, uncorrelated, and with the variances that the eigenvalues say."""
    o = roles.ofeat_view(spark, d)
    scores, _ = ml.pca_project(o, _PCA, 2, keep=["row_id"])
    g = gram(scores, ["pc1", "pc2"])
    ratio = [r["variance_ratio"] for r in ml.pca_variance(o, _PCA)[0].orderBy("component").limit(2).collect()]
    mean = scores.agg(F.avg("pc1"), F.avg("pc2")).first()
    var = np.diag(g.covariance())
    facts = {"centred": max(map(abs, mean)) < 1e-9, "uncorrelated": abs(g.correlation()[0, 1]) < 1e-6, "variances_match": bool(np.allclose(var, np.array(ratio) * len(_PCA), rtol=1e-6))}
    return scores.select("row_id", (F.abs("pc1") + F.abs("pc2") < 1e9).alias("finite"), *[F.lit(v).alias(k) for k, v in facts.items()])


@register("feature_clusters", "SELECT unnest(['qty', 'price', 'disc', 'tax', 'o_totalprice']) AS feature, TRUE AS one_place, TRUE AS closest_first")
def q_feature_clusters(spark, d):
    """Leaf order of the features: every place once, and the pair of least distance merged first, next to each other."""
    corr = stats.corr_pearson(roles.ofeat_view(spark, d), _PCA)
    c = ml.feature_clusters(corr).collect()
    r = {(x["col_a"], x["col_b"]): x["r"] or 0.0 for x in corr.collect()}
    gap = {(a, b): sum((r[a, k] - r[b, k]) ** 2 for k in _PCA) ** 0.5 for a in _PCA for b in _PCA if a < b}
    a, b = min(gap, key=gap.get)
    place, height = ({x["feature"]: x[k] for x in c} for k in ("position", "merge_height"))
    first = abs(place[a] - place[b]) == 1 and abs(height[a] - gap[a, b]) < 1e-9 and height[a] == height[b] == min(height.values())
    return spark.createDataFrame([(f, sorted(place.values()) == list(range(len(_PCA))), bool(first)) for f in place], "feature string, one_place boolean, closest_first boolean")


@register("isolation_forest", with_ctes("SELECT row_id, TRUE AS in_range, TRUE AS share_matches FROM ofeat", "ofeat"))
def q_isolation_forest(spark, d):
    """Isolation forest scores, and as many outliers as the exact 90 % quantile of the scores leaves above it."""
    s = isoforest.isolation_forest(roles.ofeat_view(spark, d), FEATS, "row_id", 0.1)
    n, flagged, least, most = s.agg(F.count(F.lit(1)), F.count_if("is_outlier"), F.min(F.when(F.col("is_outlier"), F.col("anomaly_score"))), F.max(F.when(~F.col("is_outlier"), F.col("anomaly_score")))).first()
    right = flagged <= 0.1 * n + 1 and (least is None or least > most)
    return s.select("row_id", F.col("anomaly_score").between(0, 1).alias("in_range"), F.lit(right).alias("share_matches"))


@register("corr_kendall", with_ctes(rounded("""WITH d AS (SELECT row_id, label AS x, CAST(k AS DOUBLE) AS y FROM trials),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s FROM d a JOIN d b ON a.row_id < b.row_id),
n AS (SELECT count(*) AS n FROM d),
tx AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT count(*) AS c FROM d GROUP BY x) q),
ty AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT count(*) AS c FROM d GROUP BY y) q)
SELECT s.s / sqrt((n.n * (n.n - 1) / 2 - tx.t) * (n.n * (n.n - 1) / 2 - ty.t)) AS tau, n.n AS n FROM s, n, tx, ty""",
    ["tau"]), "trials"))
def q_corr_kendall(spark, d):
    t = roles.trials_view(spark, d)
    return out(kendall.kendall_tau_b(t, "label", "k"))


_KCOLS = ["label", "k", "sec"]


def _kendall_matrix_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(_KCOLS) for b in _KCOLS[i + 1:]]
    sums = ", ".join(f"sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) AS s_{a}_{b}" for a, b in pairs)
    ties = ", ".join(f"(SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM d GROUP BY {c}) q) AS t_{c}"
                     for c in _KCOLS)
    n0 = "(n.n * (n.n - 1) / 2)"
    rows = []
    for a, b in pairs:
        tau = f"s.s_{a}_{b} / sqrt(({n0} - t.t_{a}) * ({n0} - t.t_{b}))"
        rows += [f"SELECT '{a}' AS col_a, '{b}' AS col_b, {tau} AS tau FROM s, t, n",
                 f"SELECT '{b}', '{a}', {tau} FROM s, t, n"]
    rows += [f"SELECT '{c}', '{c}', 1.0 FROM n" for c in _KCOLS]
    return f"""WITH d AS (SELECT row_id, label, CAST(k AS DOUBLE) AS k, CAST(second(ts) AS DOUBLE) AS sec FROM trials),
s AS (SELECT {sums} FROM d x JOIN d y ON x.row_id < y.row_id),
t AS (SELECT {ties}),
n AS (SELECT count(*) AS n FROM d)
""" + "\nUNION ALL\n".join(rows)


@register("corr_kendall_matrix", with_ctes(rounded(_kendall_matrix_sql(), ["tau"]), "trials"))
def q_corr_kendall_matrix(spark, d):
    t = roles.trials_view(spark, d).withColumn("sec", F.second("ts").cast("double"))
    return out(kendall.kendall_matrix(t, _KCOLS))


@register("group_cv", with_ctes(f"""WITH RECURSIVE g AS (
  SELECT entity, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, entity) AS rn FROM trials GROUP BY entity),
r(step, loads) AS (SELECT 0, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL
  SELECT r.step + 1, list_transform(range(5), lambda i: r.loads[i + 1] + CASE WHEN i = list_position(r.loads, list_min(r.loads)) - 1 THEN g.n ELSE 0 END)
  FROM r JOIN g ON g.rn = r.step + 1)
SELECT 'group' AS scheme, CAST(unnest(range(5)) AS INTEGER) AS fold, unnest(loads) AS n, TRUE AS in_range FROM r WHERE step = (SELECT max(step) FROM r)
UNION ALL SELECT 'random', CAST(rk % 5 AS INTEGER), count(*), TRUE FROM (SELECT row_number() OVER (ORDER BY {_U}, row_id) - 1 AS rk FROM trials) t GROUP BY rk % 5""", "trials"))
def q_group_cv(spark, d):
    """Entity-grouped folds vs random folds, forest regression per fold: fold sizes and scores in range."""
    t = roles.trials_view(spark, d).withColumn("hour", F.hour("ts").cast("double"))
    c = experiments.group_cv(t, ["k", "hour"], "label", "entity", 5)
    return c.select("scheme", "fold", "n", ((F.col("r2") <= 1) & (F.col("mse") > 0) & (F.col("mae") * F.col("mae") <= F.col("mse") * 1.000001)).alias("in_range"))


@register("classify_experiment", """SELECT m AS model, g AS "group", TRUE AS in_range FROM (SELECT unnest(['ordinal', 'forest']) AS m),
(SELECT 'all' AS g UNION SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def q_classify_experiment(spark, d):
    """Ordinal model vs class-balanced forest on 3 price classes, overall and per order priority: all beat a guess."""
    c = experiments.classify_experiment(roles.ofeat_view(spark, d), FEATS, "price", "o_orderpriority")
    ok = F.col("accuracy").between(1 / 3, 1) & (F.coalesce("adjacent_accuracy", F.lit(1.0)) >= F.col("accuracy"))
    return c.select("model", "group", ok.alias("in_range"))


@register("normalized_experiment", with_ctes(f"SELECT count(*) AS n, TRUE AS consistent FROM ofeat WHERE {_TEST}", "ofeat"))
def q_normalized_experiment(spark, d):
    """Per-customer z-scored order features -> forest -> test metrics."""
    o = roles.ofeat_view(spark, d).withColumn("cust", F.col("o_custkey").cast("string"))
    met, top = experiments.normalized_experiment(o, FEATS, "price", "cust")
    whole = abs(top.agg(F.sum("importance")).first()[0] - 1) < 1e-9
    ok = (F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) < 1e-6 * F.col("mse")) & (F.col("mae") <= F.col("rmse")) & (F.col("r2") <= 1) & F.lit(whole)
    return met.select("n", ok.alias("consistent"))