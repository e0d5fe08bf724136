"""Sources/sinks round trips, cleaning fit/apply, ML invariants and streaming reuse of fitted steps."""

import json
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL
from vitalis.operators import clean, isoforest, ml, split
from vitalis.sources import readers, sinks
from vitalis.streaming import apply as stream_apply


def _twenty(spark):
    rows = [(i, f"n{i}", float(i) / 3, i % 2 == 0) for i in range(20)]
    return spark.createDataFrame(rows, "id int, name string, x double, flag boolean")


# ------------------------------------------------------------------ sources / sinks

def test_same_rows_in_every_format(spark):
    df = _twenty(spark)
    base = tempfile.mkdtemp(prefix="vitalis-fmt-")
    df.write.parquet(f"{base}/t.parquet")
    sinks.write_csv(df, f"{base}/t.csv")
    df.write.option("header", True).option("sep", "\t").csv(f"{base}/t.tsv")
    sinks.write_json(df, f"{base}/t.json")
    want = sorted(tuple(r) for r in df.collect())
    for name in ("t.parquet", "t.csv", "t.tsv", "t.json"):
        got = readers.read_any(spark, f"{base}/{name}", schema=df.schema).select(*df.columns)
        assert sorted(tuple(r) for r in got.collect()) == want, name
    assert readers.detect_format("a/b.TSV") == "csv" and readers.detect_format("x.yaml") == "unknown"
    with pytest.raises(ValueError):
        readers.read_any(spark, f"{base}/t.xlsx")


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_segment_files_nested_layout(spark):
    d = tempfile.mkdtemp(prefix="vitalis-seg-")
    w = {"timestamp": 1.0, "eng_features_input": [float(i) for i in range(30)], "ppg_input": [[1.0, 2.0, 3.0]]}
    _write(f"{d}/812.json", json.dumps([
        {"label": 3.0, "turbulence": "5", "windowed_features": [w, w]},
        {"turbulence": "7", "windowed_features": [w]},                  # missing label
        {"label": 1.0, "windowed_features": []},                        # missing turbulence, empty windows
    ]))
    _write(f"{d}/905.v2.json", json.dumps([{"label": 2.0, "turbulence": "1"}]))  # no windows key
    _write(f"{d}/999.json", "[{broken json")
    trials = readers.load_segment_files(spark, d)
    got = {(r["entity"], r["trial_idx"]): r for r in trials.collect()}
    assert set(got) == {("812", 0), ("812", 1), ("812", 2), ("905", 0)}
    assert got[("812", 1)]["label"] is None and got[("812", 2)]["condition"] == "unknown"
    assert len(got[("905", 0)]["windows"]) == 0
    wins = readers.explode_segments(trials)
    assert wins.count() == 3
    feats = readers.segment_features(wins, "window", "eng_features", 22).first()["features"]
    assert len(feats) == 22
    raw = readers.segment_features(wins, "window", "raw").first()["features"]
    assert raw == [1.0, 2.0, 3.0]
    only = readers.load_segment_files(spark, d, pattern="^9")
    assert {r["entity"] for r in only.collect()} == {"905"}


def test_json_dir_counts_broken_lines(spark):
    d = tempfile.mkdtemp(prefix="vitalis-jd-")
    _write(f"{d}/a.json", '{"k": 1, "v": "x"}\n{"k": 2, "v": "y"}\n')
    _write(f"{d}/b.json", '{"k": 3, "v": "z"}\nnot json\n')
    _write(f"{d}/c.txt", '{"k": 4, "v": "ignored"}\n')
    good, bad = readers.scan_json_dir(spark, d, "k int, v string")
    assert sorted(r["k"] for r in good.collect()) == [1, 2, 3]
    assert {r["file_name"]: r["n_bad"] for r in bad.collect()} == {"b.json": 1}
    files = readers.list_files(spark, d, ".json", "a|b").select("file_name").collect()
    assert sorted(r[0] for r in files) == ["a.json", "b.json"]


def test_materialize_cache_hit_miss_and_damage(spark):
    d = tempfile.mkdtemp(prefix="vitalis-cache-")
    df = _twenty(spark)
    first = sinks.materialize(df, "twenty", d)
    assert first.count() == 20
    key = readers.cache_key("twenty")
    assert os.path.exists(f"{d}/{key}/_SUCCESS")
    again = sinks.materialize(spark.range(3).toDF("id"), "twenty", d)   # hit: the cached table comes back
    assert again.count() == 20
    os.remove(f"{d}/{key}/_SUCCESS")                                     # damaged entry -> miss, rewrite
    assert sinks.materialize(spark.range(3).toDF("id"), "twenty", d).count() == 3
    sinks.clear_cache(spark, d, "twenty")
    assert not os.path.exists(f"{d}/{key}")


def test_model_save_load_same_predictions(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").withColumn("row_id", F.col("o_orderkey"))
    o = o.withColumn("x1", F.col("o_totalprice") / 1000).withColumn("x2", F.col("o_custkey").cast("double"))
    m = ml.TabularModel("elastic", "regression").fit(o, ["x1", "x2"], "o_totalprice")
    d = tempfile.mkdtemp(prefix="vitalis-model-")
    sinks.save_model(m.model_, d, {"kind": "elastic", "features": ["x1", "x2"]})
    loaded, meta = sinks.load_model(d)
    assert meta["kind"] == "elastic"
    a = m.model_.transform(o).select("row_id", "prediction").orderBy("row_id").collect()
    b = loaded.transform(o).select("row_id", "prediction").orderBy("row_id").collect()
    assert a == b


def test_fingerprint_changes_with_files(spark):
    d = tempfile.mkdtemp(prefix="vitalis-fp-")
    _write(f"{d}/a.json", "{}")
    f1 = readers.fingerprint(spark, d).first()
    _write(f"{d}/b.parquet", "x")
    f2 = readers.fingerprint(spark, d).first()
    assert f1["n_files"] == 1 and f2["n_files"] == 2 and f1["fingerprint"] != f2["fingerprint"]


# ------------------------------------------------------------------ cleaning

def test_outlier_remover_fit_on_train_apply_on_new(spark):
    train = spark.createDataFrame([(float(x),) for x in list(range(20)) + [1000]], "x double")
    new = spark.createDataFrame([(5.0,), (1e6,), (None,)], "x double")
    r = clean.OutlierRemover(["x"], "iqr", 1.5).fit(train)
    assert [row["x"] for row in r.transform(new).collect()] == [5.0]
    flags = {row["x"]: row["is_inlier"] for row in r.flag(new).collect()}
    assert flags == {5.0: True, 1e6: False, None: False}


def test_imputer_ties_and_types(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (2, "b"), (1, None), (None, "a")], "k int, s string")
    imp = clean.Imputer(["k"], "most_frequent", categorical=["s"]).fit(df)
    out = imp.transform(df).collect()
    assert imp.values_ == {"k": 1.0, "s": "a"}     # ties -> smallest
    assert all(r["k"] is not None and r["s"] is not None for r in out)


def test_knn_impute_matches_numpy(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 3))
    X[rng.random((60, 3)) < 0.15] = np.nan
    pdf = pd.DataFrame(X, columns=["a", "b", "c"])
    pdf["id"] = np.arange(60)
    got = clean.knn_impute(spark.createDataFrame(pdf), "id", ["a", "b", "c"], k=5, block_rows=25).toPandas()
    got = got.set_index("id").sort_index()
    for i in range(60):
        for j, c in enumerate("abc"):
            if not np.isnan(X[i, j]):
                continue
            cands = []
            for d in range(60):
                if d == i or np.isnan(X[d, j]):
                    continue
                both = ~np.isnan(X[i]) & ~np.isnan(X[d])
                if both.sum() == 0:
                    continue
                dist = np.sqrt(3 / both.sum() * ((X[i, both] - X[d, both]) ** 2).sum())
                cands.append((dist, d, X[d, j]))
            cands.sort()
            want = np.mean([v for _, _, v in cands[:5]]) if cands else np.nanmean(X[:, j])
            assert got.loc[i, c] == pytest.approx(want)


def test_scalers_and_power_transform(spark):
    df = spark.createDataFrame([(float(x), 7.0) for x in [1, 2, 3, 4, 100]], "x double, c double")
    s = clean.Scaler(["x", "c"], "standard").fit(df).transform(df).toPandas()
    assert s["x"].mean() == pytest.approx(0.0, abs=1e-12) and s["x"].std(ddof=0) == pytest.approx(1.0)
    assert (s["c"] == 0.0).all()                              # constant -> scale 1
    r = clean.Scaler(["x"], "robust").fit(df).transform(df).toPandas()["x"]
    assert r.tolist()[2] == pytest.approx(0.0)                # median maps to 0
    pt = clean.PowerTransformer(["x"], "box-cox").fit(df)
    out = pt.transform(df).toPandas()["x"]
    assert out.mean() == pytest.approx(0.0, abs=1e-9) and pt.lambdas_["x"] < 0.5
    with pytest.raises(ValueError):
        clean.Scaler(["x"], "bogus").fit(df)
    with pytest.raises(ValueError):
        clean.FunctionStep(["x"], F.sqrt).inverse_transform(df)


# ------------------------------------------------------------------ ML and splits

@pytest.fixture(scope="module")
def orders(spark):
    o = spark.read.parquet(f"{SF_MID}/orders.parquet")
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.count(F.lit(1)).cast("double").alias("n"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("row_id"), "qty", "disc", "n", "o_totalprice", "o_orderstatus", "o_custkey").cache()


def test_forest_importances_sum_to_one_and_selection(orders):
    m = ml.TabularModel("rf", "regression", {"n_estimators": 20}).fit(orders, ["qty", "disc", "n"], "o_totalprice")
    imp = m.importances().toPandas()
    assert imp["importance"].sum() == pytest.approx(1.0)
    keep = ml.select_features(m.importances(), "mean")
    assert set(keep) <= {"qty", "disc", "n"} and keep


def test_elastic_net_matches_textbook_ridge(orders):
    """l1_ratio = 0: Spark's penalty is rescaled so the fit equals the closed-form ridge solution."""
    pdf = orders.select("qty", "n", "o_totalprice").toPandas()
    X, y = pdf[["qty", "n"]].to_numpy(), pdf["o_totalprice"].to_numpy()
    lam = 50.0
    m = ml.TabularModel("elastic", "regression", {"alpha": lam, "l1_ratio": 0.0}).fit(orders, ["qty", "n"], "o_totalprice")
    coef = m.model_.stages[-1].coefficients.toArray()
    Xc, yc = X - X.mean(0), y - y.mean()
    n = len(y)
    want = np.linalg.solve(Xc.T @ Xc / n + lam * np.eye(2), Xc.T @ yc / n)
    assert np.allclose(coef, want, rtol=1e-3)


def test_group_kfold_keeps_groups_apart(orders):
    g = split.group_kfold(orders, "o_custkey", 5)
    per = g.groupBy("o_custkey").agg(F.countDistinct("fold").alias("f"))
    assert per.where("f > 1").count() == 0
    sizes = [r["n"] for r in g.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) - min(sizes) <= max(r["c"] for r in orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c")).collect())


def test_fold_sizes_exact(orders):
    f = split.kfold(orders, "row_id", 4).groupBy("fold").count().collect()
    n = orders.count()
    assert sorted(r["count"] for r in f) == sorted(split.fold_sizes(n, 4))


def test_isolation_forest_flags_contamination(orders):
    r = isoforest.isolation_forest(orders, ["qty", "disc", "n"], "row_id", 0.05, n_trees=30, psi=128)
    pdf = r.select("anomaly_score", "is_outlier").toPandas()
    assert pdf["anomaly_score"].between(0, 1).all()
    assert abs(pdf["is_outlier"].mean() - 0.05) < 0.02
    assert pdf.loc[pdf["is_outlier"], "anomaly_score"].min() >= pdf.loc[~pdf["is_outlier"], "anomaly_score"].max()


def test_ordinal_ensemble_classification(orders):
    from vitalis.operators import stats

    q = stats.qcut3(orders, "o_totalprice", out="y")
    om = ml.OrdinalClassifier(["Low", "Medium", "High"]).fit(q, ["qty", "n"], "y")
    p = om.transform(q).select("y_pred", "class_proba").collect()
    assert {r["y_pred"] for r in p} <= {"Low", "Medium", "High"}
    assert all(abs(sum(r["class_proba"]) - 1) < 1e-9 for r in p)
    v = q.sparkSession.createDataFrame([("a", "b", "a"), ("b", "c", "c")], "m1 string, m2 string, m3 string")
    out = ml.ensemble_combine(v, ["m1", "m2", "m3"], [1, 1, 1], regression=False).collect()
    assert [r["y_pred"] for r in out] == ["a", "c"]


# ------------------------------------------------------------------ streaming

def test_fitted_steps_apply_to_a_stream(spark):
    src = tempfile.mkdtemp(prefix="vitalis-stream-")
    batch = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value", "ts")
    batch.write.mode("overwrite").parquet(src)
    sc = clean.Scaler(["value"], "standard").fit(batch)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    out = stream_apply.run_to_memory(spark, stream_apply.apply_fitted(stream, [sc]).select("event_id", "value"),
                                     "vitalis_scaled", checkpoint=tempfile.mkdtemp(prefix="vitalis-ck-"))
    want = sc.transform(batch).select("event_id", "value")
    assert sorted(out.collect()) == sorted(want.collect())
    win = stream_apply.windowed_stream(stream, "ts", "1 hour", "30 minutes", "10 minutes")
    res = stream_apply.run_to_memory(spark, win, "vitalis_windows", checkpoint=tempfile.mkdtemp(prefix="vitalis-ck-"))
    assert res.agg(F.sum("n")).first()[0] <= 2 * batch.count()
