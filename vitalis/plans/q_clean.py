"""Cleaning, imputation, scaling, transform and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalis.functions import columns as C
from vitalis.operators import clean, knncells
from vitalis.plans import roles
from vitalis.plans.registry import out, register
from vitalis.plans.roles import with_ctes
from vitalis.plans.sqlhelp import rounded

_OCOLS = ["qty", "price", "disc", "tax"]


def _z_keep_sql(cols, t):
    conds = " AND ".join(f"abs((o.{c} - s.m_{c}) / s.s_{c}) < {t}" for c in cols)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in cols)
    return conds, stats


def _zscore_sql(table, cols, t, select):
    conds, stats = _z_keep_sql(cols, t)
    return f"SELECT {select} FROM {table} o, (SELECT {stats} FROM {table}) s WHERE coalesce({conds}, false)"


@register("outlier_zscore", with_ctes(_zscore_sql("ofeat", _OCOLS, 3.0, "o.row_id"), "ofeat"))
def q_outlier_zscore(spark, d):
    o = roles.ofeat_view(spark, d)
    return clean.OutlierRemover(_OCOLS, "zscore", 3.0).fit(o).transform(o).select("row_id")


def _iqr_sql(table, cols, t):
    stats = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in cols)
    conds = " AND ".join(f"o.{c} >= s.a_{c} - {t} * (s.b_{c} - s.a_{c}) AND o.{c} <= s.b_{c} + {t} * (s.b_{c} - s.a_{c})"
                         for c in cols)
    return f"SELECT o.row_id FROM {table} o, (SELECT {stats} FROM {table}) s WHERE coalesce({conds}, false)"


@register("outlier_iqr", with_ctes(_iqr_sql("ofeat", _OCOLS, 1.5), "ofeat"))
def q_outlier_iqr(spark, d):
    o = roles.ofeat_view(spark, d)
    return clean.OutlierRemover(_OCOLS, "iqr", 1.5).fit(o).transform(o).select("row_id")


@register("remove_outliers", with_ctes(_zscore_sql("trials", ["label", "k"], 2.0, "o.row_id"), "trials"))
def q_remove_outliers(spark, d):
    t = roles.trials_view(spark, d)
    return clean.remove_outliers(t, ["label", "k"], "zscore", 2.0).select("row_id")


# ------------------------------------------------------------------ J1

def _imp_frame(spark, d):
    t = roles.trials_null_view(spark, d)
    return t.withColumn("cond", F.when(F.col("row_id") % 11 == 0, F.lit(None)).otherwise(F.col("condition")))


_IMP_BASE = "imp AS (SELECT row_id, label, k, CASE WHEN row_id % 11 = 0 THEN NULL ELSE condition END AS cond FROM trials_null)"
_MODE_SQL = ("(SELECT {c} FROM imp WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


def _imp_sql(label_fill, k_fill, cond_fill):
    return with_ctes(rounded(f"""WITH {_IMP_BASE}
SELECT row_id, coalesce(label, {label_fill}) AS label, coalesce(CAST(k AS DOUBLE), {k_fill}) AS k,
       coalesce(cond, {cond_fill}) AS cond FROM imp""", ["label", "k"]), "trials_null")


def _imputed(spark, d, strategy, cat_strategy="most_frequent"):
    f = _imp_frame(spark, d)
    imp = clean.Imputer(["label", "k"], strategy, categorical=["cond"], categorical_strategy=cat_strategy).fit(f)
    return out(imp.transform(f).select("row_id", "label", "k", "cond"))


@register("impute_mean", _imp_sql("(SELECT avg(label) FROM imp)", "(SELECT avg(k) FROM imp)",
                                  _MODE_SQL.format(c="cond")))
def q_impute_mean(spark, d):
    return _imputed(spark, d, "mean")


@register("impute_median", _imp_sql("(SELECT quantile_cont(label, 0.5) FROM imp)",
                                    "(SELECT quantile_cont(CAST(k AS DOUBLE), 0.5) FROM imp)", _MODE_SQL.format(c="cond")))
def q_impute_median(spark, d):
    return _imputed(spark, d, "median")


@register("impute_mode", _imp_sql(_MODE_SQL.format(c="label"), f"CAST({_MODE_SQL.format(c='k')} AS DOUBLE)",
                                  _MODE_SQL.format(c="cond")))
def q_impute_mode(spark, d):
    return _imputed(spark, d, "most_frequent")


@register("impute_constant", _imp_sql("0.0", "0.0", "'missing_value'"))
def q_impute_constant(spark, d):
    return _imputed(spark, d, "constant", "constant")


# ------------------------------------------------------------------ J2

_KNN_COLS = ["label", "k", "sec"]


def _knn_sql() -> str:
    p = len(_KNN_COLS)
    both = {c: f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)" for c in _KNN_COLS}
    cnt = " + ".join(f"CAST({both[c]} AS INTEGER)" for c in _KNN_COLS)
    ss = " + ".join(f"CASE WHEN {both[c]} THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0.0 END" for c in _KNN_COLS)
    fills = []
    for c in _KNN_COLS:
        fills.append(f"""fill_{c} AS (SELECT rid, avg(v) AS v FROM (
    SELECT rid, v, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS rn FROM (
      SELECT r.row_id AS rid, d.row_id AS did, d.{c} AS v, sqrt({p}.0 / ({cnt}) * ({ss})) AS dist
      FROM r, f d WHERE r.{c} IS NULL AND d.{c} IS NOT NULL AND d.row_id <> r.row_id AND ({cnt}) > 0) x) y
  WHERE rn <= 5 GROUP BY rid)""")
    sel = ", ".join(f"coalesce(f.{c}, fill_{c}.v, (SELECT avg({c}) FROM f)) AS {c}" for c in _KNN_COLS)
    joins = " ".join(f"LEFT JOIN fill_{c} ON fill_{c}.rid = f.row_id" for c in _KNN_COLS)
    return with_ctes(rounded(f"""WITH f AS (SELECT row_id, label, CAST(k AS DOUBLE) AS k, CAST(second(ts) AS DOUBLE) AS sec
           FROM trials_null),
r AS (SELECT * FROM f WHERE label IS NULL OR k IS NULL OR sec IS NULL),
{', '.join(fills)}
SELECT f.row_id, {sel} FROM f {joins}""", list(_KNN_COLS)), "trials_null")


@register("impute_knn", _knn_sql())
def q_impute_knn(spark, d):
    t = roles.trials_null_view(spark, d).select("row_id", "label", F.col("k").cast("double").alias("k"),
                                                 F.second("ts").cast("double").alias("sec"))
    return out(clean.knn_impute(t, "row_id", _KNN_COLS, k=5).select("row_id", *_KNN_COLS))


@register("impute_knn_lsh", _knn_sql())
def q_impute_knn_lsh(spark, d):
    """The same result through cells of near donors."""
    t = roles.trials_null_view(spark, d).select("row_id", "label", F.col("k").cast("double").alias("k"),
                                                 F.second("ts").cast("double").alias("sec"))
    return out(knncells.knn_impute_lsh(t, "row_id", _KNN_COLS, k=5, cell=16).select("row_id", *_KNN_COLS))


# ------------------------------------------------------------------ J3

_SCOLS = ["qty", "price", "disc"]


def _scale_sql(loc_scale: dict) -> str:
    stats = ", ".join(f"{loc} AS l_{c}, {sc} AS s_{c}" for c, (loc, sc) in loc_scale.items())
    sel = ", ".join(f"(o.{c} - s.l_{c}) / CASE WHEN s.s_{c} = 0 OR s.s_{c} IS NULL THEN 1.0 ELSE s.s_{c} END AS {c}"
                    for c in loc_scale)
    return with_ctes(rounded(f"SELECT o.row_id, {sel} FROM ofeat o, (SELECT {stats} FROM ofeat) s",
                             list(loc_scale)), "ofeat")


def _scaled(spark, d, method):
    o = roles.ofeat_view(spark, d)
    return out(clean.Scaler(_SCOLS, method).fit(o).transform(o).select("row_id", *_SCOLS))


@register("scale_standard", _scale_sql({c: (f"avg({c})", f"stddev_pop({c})") for c in _SCOLS}))
def q_scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@register("scale_minmax", _scale_sql({c: (f"min({c})", f"max({c}) - min({c})") for c in _SCOLS}))
def q_scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@register("scale_robust", _scale_sql({c: (f"quantile_cont({c}, 0.5)",
                                          f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)") for c in _SCOLS}))
def q_scale_robust(spark, d):
    return _scaled(spark, d, "robust")


# ------------------------------------------------------------------ J4

def _power_sql(method: str, table: str, cols: list[str]) -> str:
    coarse = "[" + ", ".join(repr(x) for x in clean.lambda_grid()) + "]"

    def T(x, lam):
        if method == "box-cox":
            return f"CASE WHEN abs({lam}) < 1e-12 THEN ln({x}) ELSE (pow({x}, {lam}) - 1) / {lam} END"
        pos = f"CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END"
        neg = (f"CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {x}) "
               f"ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END")
        return f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"

    jac = "ln(x)" if method == "box-cox" else "sign(x) * ln(1 + abs(x))"
    ctes = []
    for c in cols:
        ll = (f"CASE WHEN var_pop({T('x', 'g.lam')}) > 0 THEN -count(x) / 2.0 * ln(var_pop({T('x', 'g.lam')})) "
              f"+ (g.lam - 1) * sum({jac}) ELSE '-inf'::DOUBLE END")
        ctes.append(f"""x_{c} AS (SELECT row_id, CAST({c} AS DOUBLE) AS x FROM {table}),
ll1_{c} AS (SELECT g.lam, {ll} AS ll FROM x_{c}, (SELECT unnest({coarse}) AS lam) g GROUP BY g.lam),
b1_{c} AS (SELECT lam FROM ll1_{c} ORDER BY ll DESC, abs(lam), lam DESC LIMIT 1),
g2_{c} AS (SELECT round(b.lam - 0.1 + 0.01 * i, 2) AS lam FROM b1_{c} b, range(21) t(i)),
ll2_{c} AS (SELECT g.lam, {ll} AS ll FROM x_{c}, g2_{c} g GROUP BY g.lam),
b2_{c} AS (SELECT lam FROM ll2_{c} ORDER BY ll DESC, abs(lam), lam DESC LIMIT 1),
t_{c} AS (SELECT x_{c}.row_id, {T('x_' + c + '.x', 'b.lam')} AS v FROM x_{c}, b2_{c} b),
z_{c} AS (SELECT t.row_id, (t.v - s.m) / CASE WHEN s.sd = 0 THEN 1.0 ELSE s.sd END AS {c}
          FROM t_{c} t, (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM t_{c}) s)""")
    body = "SELECT z_{0}.row_id, {1} FROM z_{0} ".format(cols[0], ", ".join(f"z_{c}.{c}" for c in cols))
    body += " ".join(f"JOIN z_{c} USING (row_id)" for c in cols[1:])
    return "WITH " + ",\n".join(ctes) + "\n" + body


@register("tf_boxcox", with_ctes(rounded(_power_sql("box-cox", "ofeat", ["qty", "price"]), ["qty", "price"]), "ofeat"))
def q_tf_boxcox(spark, d):
    o = roles.ofeat_view(spark, d)
    pt = clean.PowerTransformer(["qty", "price"], "box-cox").fit(o)
    return out(pt.transform(o).select("row_id", "qty", "price"))


@register("tf_yeojohnson", with_ctes(rounded(_power_sql(
    "yeo-johnson", "(SELECT row_id, qty, disc - 0.05 AS dc FROM ofeat)", ["qty", "dc"]), ["qty", "dc"]), "ofeat"))
def q_tf_yeojohnson(spark, d):
    o = roles.ofeat_view(spark, d).select("row_id", "qty", (F.col("disc") - 0.05).alias("dc"))
    pt = clean.PowerTransformer(["qty", "dc"], "yeo-johnson").fit(o)
    return out(pt.transform(o).select("row_id", "qty", "dc"))


# ------------------------------------------------------------------ J5 / J6 / H1 / H2

_BUCKET = C.md5_unit_sql(42, "row_id")


@register("preprocess", with_ctes(rounded(f"""WITH t AS (SELECT row_id, label, CAST(k AS DOUBLE) AS k, {_BUCKET} < 0.2 AS is_test FROM trials_null),
tr AS (SELECT * FROM t WHERE NOT is_test),
s0 AS (SELECT avg(label) AS ml, stddev_samp(label) AS sl, avg(k) AS mk, stddev_samp(k) AS sk FROM tr),
trf AS (SELECT tr.* FROM tr, s0 WHERE coalesce(abs((label - ml) / sl) < 3.0 AND abs((k - mk) / sk) < 3.0, false)),
imp AS (SELECT avg(label) AS il, avg(k) AS ik FROM trf),
sc AS (SELECT avg(coalesce(label, il)) AS a1, stddev_pop(coalesce(label, il)) AS b1,
              avg(coalesce(k, ik)) AS a2, stddev_pop(coalesce(k, ik)) AS b2 FROM trf, imp),
rows AS (SELECT * FROM trf UNION ALL SELECT * FROM t WHERE is_test)
SELECT rows.row_id, rows.is_test,
  (coalesce(label, il) - a1) / CASE WHEN b1 = 0 THEN 1.0 ELSE b1 END AS label,
  (coalesce(k, ik) - a2) / CASE WHEN b2 = 0 THEN 1.0 ELSE b2 END AS k
FROM rows, imp, sc""", ["label", "k"]), "trials_null"))
def q_preprocess(spark, d):
    t = roles.trials_null_view(spark, d).withColumn("is_test", C.md5_unit(42, "row_id") < 0.2)
    train, test = t.where(~F.col("is_test")), t.where(F.col("is_test"))
    pre = clean.Preprocessor(["label", "k"], "standard", "mean", None, "zscore", 3.0)
    tr_out = pre.fit_transform(train)
    te_out = pre.transform(test)
    return out(tr_out.unionByName(te_out).select("row_id", "is_test", "label", "k"))


@register("custom_transform", with_ctes(rounded(
    "SELECT row_id, ln(1 + price) AS t, exp(ln(1 + price)) - 1 AS back FROM ofeat", ["t", "back"], digits=4), "ofeat"))
def q_custom_transform(spark, d):
    o = roles.ofeat_view(spark, d).select("row_id", F.col("price").alias("t"))
    fwd = clean.FunctionStep(["t"], F.log1p, F.expm1).transform(o)
    back = clean.FunctionStep(["back"], F.log1p, F.expm1).inverse_transform(fwd.withColumn("back", F.col("t")))
    return out(back.select("row_id", "t", "back"), 4)


@register("tf_log", with_ctes(rounded(
    "SELECT row_id, CASE WHEN label - 20 > -1 THEN ln(1 + (label - 20)) END AS v FROM trials", ["v"]), "trials"))
def q_tf_log(spark, d):
    t = roles.trials_view(spark, d)
    return out(t.select("row_id", C.log1p_safe(F.col("label") - 20).alias("v")))


@register("tf_sqrt", with_ctes(rounded(
    "SELECT row_id, CASE WHEN label - 20 >= 0 THEN sqrt(label - 20) END AS v FROM trials", ["v"]), "trials"))
def q_tf_sqrt(spark, d):
    t = roles.trials_view(spark, d)
    return out(t.select("row_id", C.sqrt_safe(F.col("label") - 20).alias("v")))


# ------------------------------------------------------------------ H4 / H5 / H6 / H7 / H8

@register("scalar_fns", with_ctes(rounded("""SELECT o.row_id,
  (o.price - s.m) / s.sd AS z, (o.price - s.lo) / (s.hi - s.lo) AS mm, least(greatest(o.disc, 0.02), 0.08) AS clipped,
  abs(o.price - 1500 * o.qty) AS abs_err, o.price / (o.disc + 1e-06) AS ratio
FROM ofeat o, (SELECT avg(price) AS m, stddev_samp(price) AS sd, min(price) AS lo, max(price) AS hi FROM ofeat) s""",
    ["z", "mm", "clipped", "abs_err", "ratio"], digits=4), "ofeat"))
def q_scalar_fns(spark, d):
    o = roles.ofeat_view(spark, d)
    s = o.agg(F.avg("price").alias("m"), F.stddev_samp("price").alias("sd"), F.min("price").alias("lo"),
              F.max("price").alias("hi")).first()
    return out(o.select(
        "row_id", C.zscore("price", F.lit(s["m"]), F.lit(s["sd"])).alias("z"),
        C.minmax("price", F.lit(s["lo"]), F.lit(s["hi"])).alias("mm"),
        C.clip("disc", 0.02, 0.08).alias("clipped"),
        C.abs_error("price", F.lit(1500.0) * F.col("qty")).alias("abs_err"),
        C.eps_ratio("price", "disc").alias("ratio")), 4)


@register("string_fns", """SELECT page_id, starts_with(url, 'https') AS is_https,
  lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([^./]+)$', 1)) AS ext,
  split_part(regexp_replace(url, '^https?://', ''), '.', 1) AS stem,
  regexp_matches(url, '/en/') AS has_en, md5(url) AS url_md5
FROM pages""")
def q_string_fns(spark, d):
    p = roles.table(spark, d, "pages")
    path = F.regexp_replace("url", r"[?#].*$", "")
    host = F.regexp_replace("url", r"^https?://", "")
    return p.select("page_id", F.col("url").startswith("https").alias("is_https"),
                    C.file_extension(path).alias("ext"), C.stem_before_dot(host).alias("stem"),
                    F.col("url").rlike("/en/").alias("has_en"), F.md5("url").alias("url_md5"))


@register("array_fns", with_ctes(rounded("""SELECT window_id, v[1:3] AS head3, v[1] AS first, CAST(len(v) AS INTEGER) AS n,
  CAST(len(v || list_transform(range(70 - len(v)), lambda i: 0.0)) AS INTEGER) AS padded_len,
  CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS argmax
FROM signals""", ["first"], arrays=["head3"]), "signals"))
def q_array_fns(spark, d):
    s = roles.signals_view(spark, d)
    return out(s.select("window_id", C.first_n("v", 3).alias("head3"), C.elem("v", 0).alias("first"),
                        F.size("v").alias("n"), F.size(C.pad_right("v", F.lit(70))).alias("padded_len"),
                        C.argmax("v").alias("argmax")))


@register("json_fns", """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k,
  coalesce(CAST(json_extract_string(props, '$.z') AS INTEGER), 0) AS z FROM events""")
def q_json_fns(spark, d):
    e = roles.table(spark, d, "events")
    return e.select("event_id", C.json_get("props", "k", -1, "int").alias("k"),
                    C.json_get("props", "z", 0, "int").alias("z"))


@register("taper", with_ctes(rounded("""SELECT window_id,
  list_transform(range(len(v)), lambda j: v[j + 1] * (0.54 - 0.46 * cos(2 * pi() * j / (len(v) - 1)))) AS hamming,
  list_transform(range(len(v)), lambda j: v[j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / (len(v) - 1)))) AS hanning,
  list_transform(range(len(v)), lambda j: v[j + 1] * (0.42 - 0.5 * cos(2 * pi() * j / (len(v) - 1))
                                                      + 0.08 * cos(2 * (2 * pi() * j / (len(v) - 1))))) AS blackman
FROM signals""", [], arrays=["hamming", "hanning", "blackman"]), "signals"))
def q_taper(spark, d):
    s = roles.signals_view(spark, d)
    return out(s.select("window_id", *[C.apply_taper("v", k).alias(k) for k in ("hamming", "hanning", "blackman")]))
