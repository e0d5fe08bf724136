"""Error semantics (unknown method -> error, invalid inputs) and the approximate-quantile path."""

import pytest
from pyspark.sql import functions as F

from vitalis.operators import clean, features, ml, stats
from vitalis.sources import readers


def test_unknown_methods_raise(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "e string, y double")
    with pytest.raises(ValueError):
        features.normalize_label(df, "e", "y", "bogus")
    with pytest.raises(ValueError):
        clean.OutlierRemover(["y"], "bogus").fit(df)
    with pytest.raises(ValueError):
        clean.Imputer(["y"], "bogus").fit(df)
    with pytest.raises(ValueError):
        readers.read_any(spark, "/nowhere/file.yaml")


def test_qcut_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(2.0,)], "x double")
    with pytest.raises(ValueError):
        stats.qcut3(df, "x")


def test_ensemble_weights_must_match(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        ml.ensemble_combine(df, ["a", "b"], [1.0], regression=True)
    out = ml.ensemble_combine(df, ["a", "b"], [3.0, 1.0], regression=True).first()["y_pred"]
    assert out == pytest.approx(1.25)


def test_regressor_has_no_probabilities(spark):
    df = spark.createDataFrame([(float(i), float(i % 7) * 3.0 + i) for i in range(40)], "x double, y double")
    m = ml.TabularModel("linear", "regression").fit(df, ["x"], "y")
    with pytest.raises(ValueError):
        m.predict_proba(df)
    with pytest.raises(ValueError):
        ml.TabularModel("rf").transform(df)   # not fitted


def test_approximate_quantiles_close_to_exact(spark):
    df = spark.range(0, 20001).select((F.col("id") / 10.0).alias("x"))
    exact = stats.profile_table(df, exact=True).first()["median"]
    approx = stats.profile_table(df, exact=False).first()["median"]
    assert exact == pytest.approx(1000.0) and abs(approx - exact) <= 1.0
