"""Searches with fits side by side, models of one's own, and every fitted operator as a stage that saves and loads."""

import time

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from vitalis.operators import ml
from vitalis.operators.estimators import TableEstimator, TableModel


@pytest.fixture(scope="module")
def df(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(240, 3))
    y = 3 * x[:, 0] - x[:, 1] ** 2 + 0.1 * r.normal(size=240)
    rows = [(i, *map(float, v), float(t), "abc"[int(t > -1) + int(t > 1)]) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double, k string").repartition(2).persist()


FEATS = ["a", "b", "c"]


def test_tasks_run_side_by_side_in_order():
    begin = time.monotonic()
    assert ml.side_by_side([lambda i=i: time.sleep(0.3) or i for i in range(8)], 4) == list(range(8))
    assert time.monotonic() - begin < 1.5
    with pytest.raises(ZeroDivisionError):
        ml.side_by_side([lambda: 1, lambda: 1 / 0], 2)


def test_search_equals_one_fit_after_the_other(spark, df):
    grid = {"alpha": [0.001, 5.0], "l1_ratio": [0.2, 0.8]}
    r = ml.search(df, FEATS, "y", "elastic", grid, k=3, task="regression")
    folded = ml.fold_once(df, "y", 3, "regression")
    for row, c in zip(r.results.collect(), ml.combinations_of(grid), strict=True):
        s = ml.cv_summary(ml.cross_validate(df, FEATS, "y", "elastic", 3, ("r2",), "regression", params=c, folded=folded, parallel=1)).first()
        assert row.params == str(sorted(c.items())) and (row.mean_score, row.std_score) == pytest.approx((s["mean"], s["std"]))
    assert r.best["alpha"] == 0.001
    want = ml.TabularModel("elastic", "regression", r.best).fit(df, FEATS, "y").transform(df).orderBy("row_id").select("y_pred").collect()
    assert r.model.transform(df).orderBy("row_id").select("y_pred").collect() == want


def test_boosting_rounds_are_read_off_one_fit(spark, df):
    grid = {"n_estimators": [2, 5], "max_depth": [2], "learning_rate": [0.3]}
    got = ml.search(df, FEATS, "y", "gb", grid, k=2, task="regression", refit=False)
    folded = ml.fold_once(df, "y", 2, "regression")
    for row, c in zip(got.results.collect(), ml.combinations_of(grid), strict=True):
        s = ml.cv_summary(ml.cross_validate(df, FEATS, "y", "gb", 2, ("r2",), "regression", params=c, folded=folded)).first()
        assert row.mean_score == pytest.approx(s["mean"], abs=1e-9)


def test_sizes_of_the_grids():
    assert {k: len(ml.combinations_of(g)) for k, g in ml.GRIDS.items()} == {"rf": 36, "gb": 27}
    some = ml.combinations_of(ml.GRIDS["gb"], 5)
    assert len(some) == 5 and some == ml.combinations_of(ml.GRIDS["gb"], 5) and all(c in ml.combinations_of(ml.GRIDS["gb"]) for c in some)


def test_random_search_with_a_metric_of_ones_own(spark, df):
    def minus_median_error(pred):
        return -pred.select(F.abs(F.col("y") - F.col("y_pred")).alias("e")).approxQuantile("e", [0.5], 0)[0]

    r = ml.random_search(df, FEATS, "y", "rf", {"n_estimators": [2, 10], "max_depth": [1, 6]}, n_iter=3, k=2, metric=minus_median_error, task="regression")
    assert r.results.count() == 3 and r.results.where("mean_score < 0").count() == 3 and r.model.transform(df).count() == 240


def test_estimators_of_ones_own(spark, df, tmp_path):
    own = GeneralizedLinearRegression(family="gaussian")
    m = ml.TabularModel(own, "regression", {"regParam": 0.1}).fit(df, FEATS, "y")
    assert m.evaluate(df).first()["r2"] > 0.5 and own.getRegParam() == 0.0
    m.save(str(tmp_path / "own"))
    again = ml.TabularModel.load(str(tmp_path / "own"))
    assert again.transform(df).orderBy("row_id").collect() == m.transform(df).orderBy("row_id").collect()
    with pytest.raises(ValueError):
        ml.TabularModel(own, "regression", {"nothing": 1}).fit(df, FEATS, "y")
    assert ml.search(df, FEATS, "y", own, {"regParam": [0.0, 50.0]}, k=2, task="regression").best == {"regParam": 0.0}


STAGES = [
    TableEstimator("tabular", FEATS, "y", kind="rf", task="regression", params={"n_estimators": 3}),
    TableEstimator("tabular", FEATS, "k", kind="svm", params={"n_components": 8, "max_iter": 5}),
    TableEstimator("scaled", FEATS, "y", kind="linear", task="regression"),
    TableEstimator("ordinal", FEATS, "k", classes=["a", "b", "c"]),
    TableEstimator("ensemble", FEATS, "y", kinds=["linear", "elastic"], weights=[2.0, 1.0]),
    TableEstimator("stacking", FEATS, "y", base_kinds=["linear", "elastic"], meta_kind="linear", k=2, task="regression"),
    TableEstimator("preprocessor", FEATS, feature_transform="yeo-johnson", outlier_removal="zscore"),
    TableEstimator("preprocessor", FEATS, feature_transform="log", scaling="robust", impute_strategy="median"),
    TableEstimator("preprocessor", FEATS, impute_strategy="knn"),
    TableEstimator("outliers", FEATS, method="isolation_forest", row_id="row_id"),
]


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.getOrDefault(s.operator))
def test_stages_save_and_load_in_a_pipeline(spark, df, tmp_path, stage):
    pipe = Pipeline(stages=[stage])
    pipe.write().overwrite().save(str(tmp_path / "pipe"))
    same = Pipeline.load(str(tmp_path / "pipe")).getStages()[0]
    assert {p.name: v for p, v in same.extractParamMap().items()} == {p.name: v for p, v in stage.extractParamMap().items()}
    fitted = pipe.fit(df)
    want = fitted.transform(df).orderBy("row_id").collect()
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(again.stages[0], TableModel) and again.stages[0].uid == fitted.stages[0].uid
    assert again.transform(df).orderBy("row_id").collect() == want


def test_a_preprocessor_and_a_model_in_one_pipeline(spark, df, tmp_path):
    pipe = Pipeline(stages=[TableEstimator("preprocessor", FEATS), TableEstimator("ensemble", FEATS, "y", kinds=["linear", "elastic"])])
    m = pipe.fit(df)
    m.write().overwrite().save(str(tmp_path / "m"))
    assert PipelineModel.load(str(tmp_path / "m")).transform(df).orderBy("row_id").collect() == m.transform(df).orderBy("row_id").collect()


def test_unknown_operators_and_functions_raise(spark, df, tmp_path):
    with pytest.raises(ValueError):
        TableEstimator("nothing", FEATS).fit(df)
    from vitalis.operators.clean import FunctionStep

    with pytest.raises(ValueError):
        TableModel(FunctionStep(["a"], lambda c: c)).write().overwrite().save(str(tmp_path / "f"))
