"""Machines one against the rest: the same models as Spark's, over a table of vectors."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vitalis.operators import machines, ml


@pytest.fixture
def three(spark):
    x = spark.range(400).select("id", (F.pmod(F.hash("id"), F.lit(1000)) / 100).alias("a"), (F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) / 100).alias("b"))
    return x.withColumn("c", F.when(F.col("a") + F.col("b") < 7, "low").when(F.col("a") > F.col("b"), "mid").otherwise("up"))


@pytest.mark.parametrize("held", [1, 1 << 28])
def test_machines_are_those_of_one_against_the_rest(three, monkeypatch, tmp_path, held):
    tables, at_once = [], []
    write, beside = ml.written, ml.side_by_side
    monkeypatch.setattr(ml, "HELD", held)
    monkeypatch.setattr(ml, "written", lambda df, name: tables.append(name) or write(df, name))
    monkeypatch.setattr(ml, "side_by_side", lambda tasks, parallel: at_once.append(parallel) or beside(tasks, parallel))
    m = ml.TabularModel("svm", "classification", {"n_components": 8, "max_iter": 5}).fit(three, ["a", "b"], "c")
    assert tables == ["vectors"] and at_once == [1 if held == 1 else 3]
    data = m.scaler_.transform(three).select("*", *m.extra_cols_)
    data = VectorAssembler(inputCols=[f"_rff{i}" for i in range(8)], outputCol="features").transform(data)
    data = data.withColumn("y", (F.array_position(F.array(*[F.lit(x) for x in m.labels_]), F.col("c")) - 1).cast("double"))
    want = OneVsRest(classifier=LinearSVC(regParam=0.01, maxIter=5), labelCol="y").fit(data).models
    got = m.model_.stages[-1].models
    for g, w in zip(got, want, strict=True):
        assert g.coefficients.toArray() == pytest.approx(w.coefficients.toArray(), abs=1e-6) and g.intercept == pytest.approx(w.intercept, abs=1e-6)
    m.save(str(tmp_path / "m"))
    again = ml.TabularModel.load(str(tmp_path / "m"))
    assert again.transform(three).exceptAll(m.transform(three)).count() == 0


@pytest.mark.parametrize("rounds", [5, 25])
def test_machines_of_all_classes_in_the_same_passes(three, monkeypatch, tmp_path, rounds):
    """Beyond WIDE no vectors are written or held: the passes make the components, and the machines are Spark's."""
    params = {"n_components": 8, "max_iter": rounds}
    want = ml.TabularModel("svm", "classification", params).fit(three, ["a", "b"], "c")
    tables = []
    write = ml.written
    monkeypatch.setattr(ml, "WIDE", 400 * 8 - 1)
    monkeypatch.setattr(ml, "written", lambda df, name: tables.append(set(df.columns)) or write(df, name))
    m = ml.TabularModel("svm", "classification", params).fit(three, ["a", "b"], "c", stored=True)
    assert tables == [{"x", "y"}]
    for g, w in zip(m.model_.stages[-1].models, want.model_.stages[-1].models, strict=True):
        assert g.coefficients.toArray() == pytest.approx(w.coefficients.toArray(), abs=1e-6) and g.intercept == pytest.approx(w.intercept, abs=1e-6)
    m.save(str(tmp_path / "m"))
    again = ml.TabularModel.load(str(tmp_path / "m"))
    assert again.transform(three).exceptAll(want.transform(three)).count() == 0
    stage = want.model_.transform(want._prep(three)).select("id", F.get(F.array(*[F.lit(x) for x in want.labels_]), F.col("prediction").cast("int")).alias("y_pred"))
    assert again.transform(three).select("id", "y_pred").exceptAll(stage).count() == 0
    bad = three.withColumn("a", F.when(F.col("id") == 7, None).otherwise(F.col("a")))
    with pytest.raises(ValueError, match="impute.*'a'"):
        ml.TabularModel("svm", "classification", params).fit(bad, ["a", "b"], "c")
    bad = three.withColumn("a", F.when(F.col("id") == 7, float("inf")).otherwise(F.col("a")))
    with pytest.raises(Exception, match="(?i)finite|null|nan"):
        ml.TabularModel("svm", "classification", params).fit(bad, ["a", "b"], "c")


def test_equal_features_and_one_class(spark, monkeypatch):
    """Components without spread get no weight, with one class as with two."""
    monkeypatch.setattr(ml, "WIDE", 0)
    same = spark.range(50).select(F.lit(3.0).alias("a"), F.lit("x").alias("one"), F.when(F.col("id") < 10, "x").otherwise("y").alias("two"))
    for label in ("one", "two"):
        m = ml.TabularModel("svm", "classification", {"n_components": 4, "max_iter": 5}).fit(same, ["a"], label)
        assert all(not x.coefficients.toArray().any() for x in m.model_.stages[-1].models)
        assert m.transform(same).select("y_pred").distinct().collect() == [("x" if label == "one" else "y",)]


def test_components_of_many_blocks():
    r = np.random.default_rng(3)
    x, W, b = r.normal(size=(3 * machines.BLOCK + 5, 2)) * 5, r.normal(size=(7, 2)), r.normal(size=7)
    got = np.concatenate([h.copy() for _, h in machines.Maker(W, b).blocks(np.column_stack([x, np.ones(len(x))]))])
    assert got == pytest.approx((1 - np.cos(x @ W.T + b)) / 2, abs=1e-13)
