"""Trees that see bins alone answer every combination of bins once; rows look the answers up."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.operators import ml

FEATS = ["a", "b"]


@pytest.fixture
def few(spark):
    x = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 20).alias("a"), (F.hash("id") % 7).cast("double").alias("b"))
    x = x.withColumn("y", F.col("a") * 3.0 + F.col("b") * F.col("b") + (F.pmod(F.hash("row_id", F.lit(1)), F.lit(100)) / 50))
    return x.withColumn("c", F.when(F.col("y") < 20, "low").when(F.col("y") < 45, "mid").otherwise("up"))


def _drops(model, df, repeats, seed):
    """The drops of r2 by definition: each row takes a value of the next one in the order of its hash, the last of the first."""
    rows = df.collect()
    unit = lambda r, i: int(hashlib.md5(f"{seed}|{r}|{i}".encode()).hexdigest()[:8], 16) / 2.0 ** 32
    made = []
    for r in range(repeats):
        order = sorted(rows, key=lambda x: (unit(r, x["row_id"]), x["row_id"]))
        for f in FEATS:
            made += [(f, r, *[nxt[g] if g == f else row[g] for g in FEATS], row["y"]) for row, nxt in zip(order, order[1:] + order[:1], strict=True)]
    frame = df.sparkSession.createDataFrame(made, "f string, r int, a long, b double, y double")
    r2 = lambda p: 1 - np.mean((p["y"] - p["y_pred"]) ** 2) / np.var(p["y"])
    base = r2(model.transform(df).toPandas())
    drops = {f: [base - r2(p) for _, p in g.groupby("r")] for f, g in model.transform(frame).toPandas().groupby("f")}
    return {f: (np.mean(v), np.std(v)) for f, v in drops.items()}


@pytest.mark.parametrize("kind", ["rf", "linear"])
@pytest.mark.parametrize("stretch", [7, 2000])
def test_permutations_by_definition(few, monkeypatch, kind, stretch):
    monkeypatch.setattr(ml, "SHARES", 1000)
    monkeypatch.setattr(ml, "STRETCH", stretch)
    m = ml.TabularModel(kind, "regression", {"n_estimators": 5} if kind == "rf" else {}).fit(few, FEATS, "y")
    test = few.where("row_id % 5 = 1")
    want = _drops(m, test, 3, 11)
    if kind == "rf":  # the model is asked for combinations of bins, not for 6 copies of the rows
        monkeypatch.setattr(ml.TabularModel, "transform", None)
    got = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in ml.permutation_importance(m, test, "row_id", 3, 11).collect()}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=1e-9) for f in FEATS)


@pytest.mark.parametrize("label", ["y", "c"])
def test_answers_are_the_models(spark, few, monkeypatch, label):
    monkeypatch.setattr(ml, "SHARES", 500)
    m = ml.TabularModel("rf", "regression" if label == "y" else "classification", {"n_estimators": 5}).fit(few, FEATS, label, stored=True)
    known = m.answers(spark, 3000)
    assert known.table.count() == 20 * 13 and m.answers(spark, 200) is None
    got, want = known.transform(few), m.transform(few)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    with pytest.raises(Exception, match="impute"):
        known.transform(few.withColumn("a", F.when(F.col("row_id") != 7, F.col("a")))).collect()
    monkeypatch.setattr(ml, "GRID", 100)
    assert m.answers(spark, 3000) is None


@pytest.mark.parametrize("metrics", [("r2", "mse"), ("r2", "median_ae")])
def test_folds_are_scored_by_answers(few, monkeypatch, metrics):
    """Scores of the models themselves, without asking them for the rows and without a cache of the training rows."""
    def scores():
        return {(r["fold"], r["metric"], r["part"]): r["score"] for r in ml.cross_validate(few, FEATS, "y", "gb", 3, metrics, "regression", return_train=True, params={"n_estimators": 4}).collect()}

    monkeypatch.setattr(ml, "SHARES", 500)
    with monkeypatch.context() as m:
        m.setattr(ml, "GRID", 0)
        want = scores()
    monkeypatch.setattr(ml.TabularModel, "transform", None)
    monkeypatch.setattr(type(few), "persist", lambda self, level=None: self if set(self.columns) != {*FEATS, "y"} else pytest.fail("rows cached"))
    got = scores()
    assert len(got) == 3 * 2 * 2 and got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
