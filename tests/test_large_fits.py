"""Fits on many rows: what is added up before the fit says the same as the rows."""

import pytest
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from vitalis.operators import clean, isoforest, kendall, knncells, ml

FEATS = ["a", "b"]


@pytest.fixture
def few(spark):
    """Features of at most 20 values, labels that differ within a cell."""
    x = spark.range(3000).select("id", (F.col("id") % 20).alias("a"), (F.hash("id") % 7).cast("double").alias("b"))
    x = x.withColumn("y", F.col("a") * 3.0 + F.col("b") * F.col("b") + (F.pmod(F.hash("id", F.lit(1)), F.lit(100)) / 50))
    return x.withColumn("c", F.when(F.col("y") < 20, "low").when(F.col("y") < 45, "mid").otherwise("up"))


def _bins(m):
    return isinstance(m.model_.stages[0], Bucketizer)


def test_boosting_on_cells_is_boosting_on_rows(few, monkeypatch):
    rows = ml.TabularModel("gb", "regression", {"n_estimators": 8, "min_samples_leaf": 40}).fit(few, FEATS, "y")
    monkeypatch.setattr(ml, "SHARES", 100)
    cells = ml.TabularModel("gb", "regression", {"n_estimators": 8, "min_samples_leaf": 40}).fit(few, FEATS, "y")
    assert _bins(cells) and not _bins(rows)
    both = cells.transform(rows.transform(few, "p"), "q")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    sizes = [3, 8]
    assert ml._staged(cells, few, "y", sizes) == pytest.approx(ml._staged(rows, few, "y", sizes), abs=1e-9)


def test_cells_hold_every_row_and_a_forest_of_them_predicts_like_one_of_rows(few, monkeypatch):
    rows = ml.TabularModel("rf", "regression", {"n_estimators": 20}).fit(few, FEATS, "y")
    monkeypatch.setattr(ml, "SHARES", 1000)
    cells = ml.TabularModel("rf", "regression", {"n_estimators": 20}).fit(few, FEATS, "y")
    assert _bins(cells)
    got = cells._cells(few, FEATS, "y").agg(F.sum("_n"), F.sum("_weight"), F.sum(F.col("y") * F.col("_weight"))).first()
    assert tuple(got) == pytest.approx((3000, 3000.0, few.agg(F.sum("y")).first()[0]))
    r2 = [1 - m.transform(few).agg(F.avg(F.pow(F.col("y") - F.col("y_pred"), 2)) / F.var_pop("y")).first()[0] for m in (rows, cells)]
    assert min(r2) > 0.9 and abs(r2[0] - r2[1]) < 0.05


def test_classes_and_weights_on_cells(few, monkeypatch, tmp_path):
    monkeypatch.setattr(ml, "SHARES", 500)
    df = few.withColumn("w", F.when(F.col("c") == "mid", 2.0).otherwise(0.5))
    m = ml.TabularModel("rf", "classification", {"n_estimators": 10, "weight_col": "w"}).fit(df, FEATS, "c")
    assert _bins(m) and m.labels_ == ["low", "mid", "up"]
    assert m.transform(df).agg(F.avg((F.col("c") == F.col("y_pred")).cast("int"))).first()[0] > 0.9
    m.save(str(tmp_path / "m"))
    again = ml.TabularModel.load(str(tmp_path / "m"))
    assert again.transform(df).exceptAll(m.transform(df)).count() == 0


@pytest.mark.parametrize("spoiled", ["y", "a"])
def test_missing_labels_and_nan_features_are_refused(few, monkeypatch, spoiled):
    monkeypatch.setattr(ml, "SHARES", 100)
    bad = few.withColumn("a", F.col("a").cast("double"))
    bad = bad.withColumn(spoiled, F.when(F.col("id") == 7, None if spoiled == "y" else float("nan")).otherwise(F.col(spoiled)))
    with pytest.raises(Exception, match="(?i)nan|null"):
        ml.TabularModel("rf", "regression", {"n_estimators": 2}).fit(bad, FEATS, "y")


def test_edges_from_all_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") == 999).cast("int").alias("rare"), F.lit(4).alias("same"))
    x, rare, same = ml.bin_edges(df, ["x", "rare", "same"])
    assert len(x) == ml.BINS - 1 and rare == [0.5] and same == []


def test_kendall_in_bounded_tasks(spark, monkeypatch):
    rows = [(i, (i * 37) % 50 / 7, (i * 11) % 23 if i % 9 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, x double, y int")
    used, sums = [], kendall.prefix_sums
    monkeypatch.setattr(kendall, "prefix_sums", lambda *a, **k: used.append(k["num_partitions"]) or sums(*a, **k))
    for name in ("ROWS", "KEYS", "CELLS"):
        monkeypatch.setattr(kendall, name, 16)
    tau, n = kendall.kendall_tau_b(df, "x", "y").first()
    both = [(x, y) for _, x, y in rows if y is not None]
    sign = lambda a, b: (a > b) - (a < b)
    pairs = [(sign(p[0], q[0]), sign(p[1], q[1])) for i, p in enumerate(both) for q in both[:i]]
    whole = (sum(bool(a) for a, _ in pairs) * sum(bool(b) for _, b in pairs)) ** 0.5
    assert n == len(both) and tau == pytest.approx(sum(a * b for a, b in pairs) / whole)
    assert used[0] >= len(set(both)) / 16 and used[1] > used[0]


def test_isolation_scores_are_made_once(spark, monkeypatch):
    df = spark.range(300).select("id", F.pmod(F.hash("id"), F.lit(100)).alias("a"), (F.col("id") % 7).alias("b"))
    made = spark.sparkContext.accumulator(0)
    score = isoforest.score_isolation_forest

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    monkeypatch.setattr(isoforest, "score_isolation_forest", lambda d, f: score(d, f).withColumn("anomaly_score", counted("anomaly_score")))
    out = isoforest.isolation_forest(df, ["a", "b"], "id", 0.1, n_trees=5, psi=32)
    assert out.count() == 300 and 0 < out.where("is_outlier").count() <= 31
    out.agg(F.sum("anomaly_score")).collect()
    assert made.value == 300


def test_equal_receivers_look_for_donors_once(spark, monkeypatch):
    """The exact result with equal receivers, repeated ids and donors of the receivers' ids; equal receivers meet donors once."""
    rows = [(i % 380, None if i % 3 == 0 else float((i * 37) % 101), float(i % 4) if i % 7 else None, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    seen = []
    meet = knncells.block_candidates
    monkeypatch.setattr(knncells, "block_candidates", lambda recv, *a, **k: seen.append(recv.count()) or meet(recv, *a, **k))
    order = ["id", "x", "y", "z"]
    got = knncells.knn_impute_lsh(df, "id", ["x", "y", "z"], 3).select(order).orderBy(order).collect()
    want = clean.knn_impute(df, "id", ["x", "y", "z"], 3).select(order).orderBy(order).collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want]
    missing = [r for r in rows if None in r]
    assert sum(seen) < len(missing) / 2
