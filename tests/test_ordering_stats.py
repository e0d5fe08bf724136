"""Distributed order helpers, statistics and metrics on hand-made frames (edge cases)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalis.operators import curves, kendall, metrics, ordering, stats


def test_prefix_sums_many_partitions_and_hot_key(spark):
    rng = np.random.default_rng(0)
    keys = np.arange(5000)
    w = rng.integers(1, 5, size=5000).astype(float)
    w[1234] = 1e6  # one hot key carrying most of the weight
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "w": w}))
    out = ordering.prefix_sums(df, [F.col("k").asc()], ["w"], num_partitions=16).toPandas().sort_values("k")
    expected = np.cumsum(w) - w
    assert np.allclose(out["w_before"].to_numpy(), expected)


def test_prefix_sums_descending(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(100)], "s double, c double")
    out = ordering.prefix_sums(df, [F.col("s").desc()], ["c"], num_partitions=7).toPandas()
    assert dict(zip(out["s"], out["c_before"])) == {float(i): float(99 - i) for i in range(100)}


def test_rank_in_group_matches_window(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 3000), "v": rng.permutation(3000)})
    pdf.loc[:2000, "g"] = 0  # a group with two thirds of the rows
    df = spark.createDataFrame(pdf)
    ours = ordering.rank_in_group(df, ["g"], [F.col("v").asc()], "r", num_partitions=12)
    ref = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1)
    j = ours.join(ref, ["g", "v"])
    assert j.where(F.col("r") != F.col("r2")).count() == 0
    assert j.count() == 3000


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(x,) for x in [3.0, 1.0, 3.0, 2.0, None, 3.0]], "x double")
    r = ordering.average_rank(df, "x").toPandas()
    got = sorted(zip(r["x"].fillna(-1), r["x_rank"].fillna(-1)))
    assert got == [(-1, -1), (1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


def test_kendall_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, 400).astype(float)
    y = (x + rng.integers(0, 4, 400)).astype(float)
    tau = kendall.kendall_tau_b(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").first()["tau"]
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i + 1, n))
    n0 = n * (n - 1) / 2
    t = lambda a: sum(c * (c - 1) / 2 for c in pd.Series(a).value_counts())
    assert tau == pytest.approx(s / math.sqrt((n0 - t(x)) * (n0 - t(y))), abs=1e-12)


def test_corr_zero_variance_and_all_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    r = {(x["col_a"], x["col_b"]): x["r"] for x in stats.corr_pearson(df, ["a", "b", "c"]).collect()}
    assert r[("a", "a")] == pytest.approx(1.0)
    assert r[("a", "b")] is None and r[("b", "b")] is None and r[("a", "c")] is None


def test_profile_all_null_constant_and_datetime(spark):
    import datetime as dt

    df = spark.createDataFrame([(None, 1.0, "x", dt.datetime(2024, 1, 2)), (None, 1.0, "y", dt.datetime(2024, 1, 1)),
                                (None, 1.0, "x", None)], "n double, c double, s string, t timestamp_ntz")
    p = {r["column_name"]: r for r in stats.profile_table(df).collect()}
    assert p["n"]["n_missing"] == 3 and p["n"]["mean"] is None
    assert p["c"]["std"] == 0.0 and p["c"]["median"] == 1.0
    assert p["s"]["n_unique"] == 2 and p["s"]["top"] == "x"
    assert p["t"]["kind"] == "datetime" and p["t"]["n_missing"] == 1


def test_regression_metrics_edge_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 3.0), ("b", 3.0, 3.0), ("c", 0.0, 1.0), ("c", 2.0, 1.0)],
                               "e string, y double, p double")
    m = {r["e"]: r for r in metrics.metrics_by_entity_reg(df, "e", "y", "p").collect()}
    assert m["a"]["r2"] is None          # one row
    assert m["b"]["r2"] == 1.0           # constant truth, perfect prediction
    assert m["c"]["r2"] == 0.0           # SSE 2 / SST 2
    allm = metrics.regression_metrics(df, "y", "p").first()
    assert allm["mape"] == pytest.approx((1.0 + 0 + 0 + 0.5) / 4)  # y == 0 skipped


def test_classification_with_unseen_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "d")], "y string, p string")
    rep = {r["label"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rep["d"]["support"] == 0 and rep["d"]["precision"] == 0.0   # only predicted
    assert rep["c"]["recall"] == 0.0                                    # only true
    m = metrics.classification_metrics(df, "y", "p").first()
    assert m["accuracy"] == pytest.approx(0.4)
    assert m["balanced_accuracy"] == pytest.approx((1 / 3 + 1 + 0) / 3)
    pe = (3 * 1 + 1 * 3 + 1 * 0 + 0 * 1) / 25
    assert m["kappa"] == pytest.approx((0.4 - pe) / (1 - pe))


def test_roc_ties_form_one_point(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, score double")
    pts = sorted((r["fpr"], r["tpr"]) for r in curves.roc_curve(df, "y", "score").collect())
    assert pts == [(0.0, 0.0), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    # pairs: tie (0.5) + 1 + 0 + 1 over 4 = trapezoid area of (0,0),(.5,.5),(.5,1),(1,1)
    assert curves.roc_auc(df, "y", "score").first()["auc"] == pytest.approx(0.625)


def test_calibration_bins_on_edges(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.3), (1, 0.30000000000000004), (1, 1.0)], "y int, score double")
    bins = {r["bin"]: r["n"] for r in curves.calibration(df, "y", "score").collect()}
    # 0.1 lies on the first inner edge -> bin 0; 0.3 is below the 0.30000000000000004 edge -> bin 2
    assert bins == {0: 1, 2: 2, 9: 1}


def test_zscore_anomalies_and_duplicates(spark):
    rows = [(i, float(i % 3)) for i in range(60)] + [(100, 50.0)]
    df = spark.createDataFrame(rows, "id long, x double")
    a = stats.zscore_anomalies(df, ["x"], "id", 3.0).collect()
    assert [r["row_id"] for r in a] == [100]
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "k int, s string")
    assert stats.duplicates(d, ["k", "s"]).count() == 1          # NULL keys drop out of the listing
    assert stats.duplicate_rows(d, ["k", "s"]).count() == 4      # whole member rows, keep=False; NULL equals NULL
    s = stats.duplicate_summary(d, ["k", "s"]).first()
    assert s["total_duplicates"] == 4 and s["duplicate_groups"] == 2


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    h = {r["bin"]: r["n"] for r in stats.histogram(df, "x", 5).collect()}
    assert sum(h.values()) == 11 and h[4] == 3


def test_percentile_of_score_against_rank_formula(spark):
    from vitalis.operators import features

    labels = [1.0, 2.0, 2.0, 3.0]
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate(labels)] + [("f", 9, 5.0)], "e string, id int, v double")
    got = {r["id"]: r["pct"] for r in features.percentile_of_score(df, "e", "v", "pct").collect()}
    # kind='rank': (left + right + 1) / (2n) for members
    assert got == {0: pytest.approx(2 / 8), 1: pytest.approx(5 / 8), 2: pytest.approx(5 / 8), 3: pytest.approx(8 / 8),
                   9: pytest.approx(1.0)}
