"""Least squares from sums, and the order table of the ordinal fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.operators import ml

FEATS = ["a", "b"]
AT = (0.2, 0.6, 1.0)


def frame(spark, n=600, odd=()):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 2)) * [1, 50] + [3, 1000]
    y = 2 * x[:, 0] - 0.1 * x[:, 1] + r.normal(size=n)
    rows = [(i, *map(float, v), float(t), "not read") for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, *odd], "row_id long, a double, b double, y double, s string").repartition(3)


def curve(df, **options):
    rows = ml.learning_curve(df, FEATS, "y", "linear", 3, AT, task="regression", **options).collect()
    return {(r["part"], r["fraction"]): (r["mean"], r["std"]) for r in rows}


def plain(df):
    folded = ml.fold_once(df, "y", 3, "regression")
    out = {}
    for f in AT:
        s = ml.cv_summary(ml.cross_validate(df, FEATS, "y", "linear", 3, ("r2",), "regression", return_train=True, fraction=f, folded=folded))
        out |= {(r["part"], f): (r["mean"], r["std"]) for r in s.collect()}
    return out


@pytest.mark.parametrize("odd", [(), [(5, 3.0, 1000.0, -90.0, None)] * 40], ids=["rows", "copies"])
def test_a_linear_curve_is_that_of_its_fits(spark, odd):
    df = frame(spark, odd=odd)
    got, want = curve(df), plain(df)
    assert got.keys() == want.keys() and len(got) == 2 * len(AT)
    for key, v in want.items():
        assert got[key] == pytest.approx(v, abs=1e-9)


def test_a_linear_curve_of_dependent_columns_fits_them_plainly(spark):
    df = frame(spark).withColumn("b", F.lit(1.0))
    got, want = curve(df), plain(df)
    assert all(got[key] == pytest.approx(v, abs=1e-9) for key, v in want.items())
    with pytest.raises(ValueError, match="nulls"):
        curve(frame(spark, odd=[(9000 + i, None, 1.0, 1.0, None) for i in range(9)]))


def test_a_linear_curve_reads_its_rows_a_few_times(spark, monkeypatch):
    fitted = []
    fit = ml.TabularModel.fit
    monkeypatch.setattr(ml.TabularModel, "fit", lambda self, df, *a: fitted.append(df.count()) or fit(self, df, *a))
    curve(frame(spark))
    assert fitted and max(fitted) < 10


def test_the_order_table_of_the_ordinal_fit_is_made_once(spark, monkeypatch):
    from vitalis.plans import q_ml

    made = []
    keep = q_ml.written
    monkeypatch.setattr(q_ml, "written", lambda df, name: made.append(name) or keep(df, name))
    q = q_ml._ordinal_frame(spark, "/root/testdata/sf0.001")
    assert made == ["orders"] and "lineitem" not in q._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lineitem" in f for f in q.inputFiles()) and q.where("y_class is null").count() == 0
