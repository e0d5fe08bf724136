"""No operator loses rows over nulls, blanks or equal rows; folds are those of the plain greedy pass."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalis.operators import features, metrics, ml, ordering, sequence, signal_ops, split, stats
from vitalis.operators.clean import OutlierRemover
from vitalis.sources import readers


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 10 == 0 else f"c{i % 3}", None if i % 7 == 0 else f"e{i % 4}", float(i)) for i in range(100)]
    return spark.createDataFrame(data, "id long, label string, entity string, x double")


def test_stratified_split_and_folds_keep_null_labels(rows):
    s = split.split_stratified(rows, "id", "label", 0.2).groupBy("label").agg(F.count_if(F.col("split") == "test").alias("t"), F.count(F.lit(1)).alias("n"))
    assert {r["label"]: (r["t"], r["n"]) for r in s.collect()}[None] == (2, 10)
    f = split.stratified_kfold(rows, "id", "label", 5)
    assert f.count() == 100
    per = Counter((r["label"], r["fold"]) for r in f.collect())
    assert all(per[None, k] == 2 for k in range(5))
    assert sorted(Counter(r["fold"] for r in split.kfold(rows, "id", 7).collect()).values()) == [14] * 5 + [15] * 2


def test_group_folds_of_a_null_group(rows):
    f = split.group_kfold(rows, "entity", 2).collect()
    assert len(f) == 100 and all(r["fold"] is not None for r in f)
    assert len({r["fold"] for r in f if r["entity"] is None}) == 1


def test_fold_runs_are_the_greedy_pass():
    r = random.Random(1)
    for _ in range(200):
        k = r.randrange(1, 7)
        sizes = sorted((r.choice([1, 1, 2, 3, 5, 8, 40, 100]) for _ in range(r.randrange(1, 60))), reverse=True)
        loads, want = [0] * k, []
        for s in sizes:
            f = min(range(k), key=lambda i: (loads[i], i))
            loads[f] += s
            want.append(f)
        got = []
        for _, a, b, folds in split.fold_runs(sorted(Counter(sizes).items(), reverse=True), k):
            got += [folds[i % len(folds)] for i in range(b - a)]
        assert got == want


def test_ranks_prefixes_and_scores_of_null_groups(rows):
    r = ordering.rank_in_group(rows, ["entity"], [F.col("id").asc()])
    assert r.count() == 100 and r.where("entity is null").agg(F.max("rank")).first()[0] == 14
    g = features.grouped_prefix(rows, ["entity"], F.col("id").asc(), ["x"])
    assert g.count() == 100 and g.where("entity is null and id = 7").first()["x_before"] == 0
    p = features.percentile_of_score(rows, "entity", "x")
    assert p.count() == 100 and p.where("label_pct is null").count() == 0


def test_no_frame_stays_cached(spark, rows):
    sc = spark.sparkContext._jsc.sc()
    before = sc.getPersistentRDDs().size()
    split.kfold(rows, "id", 3).count()
    stats.corr_spearman(rows.select("id", "x"), ["id", "x"]).count()
    assert sc.getPersistentRDDs().size() == before


def test_sequences_keep_the_first_windows(spark):
    w = spark.createDataFrame([(1, i, [] if i < 2 else [float(i)]) for i in range(6)] + [(None, 3, [1.0]), (None, 4, [3.0])], "t int, idx int, vec array<double>")
    s = {r["t"]: r["seq_len"] for r in sequence.build_sequences(w, ["t"], "idx", "vec", max_len=3).collect()}
    assert s == {1: 3, None: 2}
    m = sequence.sequence_minmax(w, ["t"], "idx", "vec").where("t is null").orderBy("idx").collect()
    assert [r["value"] for r in m] == [0.0, 1.0]


def test_json_lines_with_blanks_and_nulls(spark, tmp_path):
    (tmp_path / "a.json").write_text(' {"a": 1} \n{"a": 2}\n{"a": null}\n{}\n{"a": \n\n')
    good, bad = readers.scan_json_dir(spark, str(tmp_path), "a long")
    assert sorted((r["a"] for r in good.collect()), key=str) == [1, 2, None, None]
    assert [r["n_bad"] for r in bad.collect()] == [1]


def test_spearman_is_pairwise(spark):
    x, y, z = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.0, 1.0, 4.0, 3.0, 6.0, 5.0], [1.0, None, 2.0, 2.0, None, 7.0]
    df = spark.createDataFrame(list(zip(x, y, z, strict=True)), "x double, y double, z double")
    want = pd.DataFrame({"x": x, "y": y, "z": z}).rank().corr().iloc[0, 1], pd.DataFrame({"x": x, "z": z}).dropna().rank().corr().iloc[0, 1]
    got = {(r["col_a"], r["col_b"]): r["r"] for r in stats.corr_spearman(df, ["x", "y", "z"]).collect()}
    assert len(got) == 9
    assert got["x", "y"] == pytest.approx(want[0]) and got["x", "z"] == pytest.approx(want[1]) and got["z", "z"] == pytest.approx(1)


def test_duplicate_rows_with_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "id int, k string")
    assert sorted(r["id"] for r in stats.duplicate_rows(df, ["k"]).collect()) == [1, 2, 3, 4]
    assert stats.duplicate_summary(df, ["k"]).first()["total_duplicates"] == 4


def test_metrics_of_a_null_group(spark):
    df = spark.createDataFrame([(None, "a", "a"), (None, "b", "b"), ("g", "a", "a"), ("g", "b", "b")], "g string, t string, p string")
    m = {r["value"]: r["accuracy"] for r in metrics.fairness(df, "g", "t", "p").collect()}
    assert m == {None: 1.0, "g": 1.0, "max_gap": 0.0}
    reg = spark.createDataFrame([(1.0, 1.0), (2.0, None)], "y_true double, y_pred double")
    assert metrics.regression_metrics(reg).first()["n"] == 1


def test_quality_of_a_null_condition(spark):
    q = spark.createDataFrame([("s", None, "low", 1.0), ("s", "5", "high", 0.0)], "signal string, c string, cat string, quality_score double")
    got = {(r["dim"], r["value"]) for r in signal_ops.quality_by_condition(q, "signal", "c", "cat").collect()}
    assert got == {("condition", None), ("condition", "5"), ("category", "low"), ("category", "high")}


def test_equal_samples_stay_apart(spark):
    s = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "entity string, t double")
    regions = spark.createDataFrame([("a", 0.0, 2.0)], "entity string, s double, e double")
    got = features.annotate_samples(s, regions, "entity", "t", "s", "e").collect()
    assert sorted((r["entity"], r["n_regions"]) for r in got) == [("a", 1), ("a", 1), ("b", 0)]


def test_zscore_needs_no_quartiles(rows):
    r = OutlierRemover(["x"], "zscore").fit(rows)
    assert r.stats_["x"]["q1"] is None and r.stats_["x"]["std"] > 0


def test_classes_and_null_labels(spark):
    data = [(float(i), float(i % 5), None if i % 9 == 0 else ("yes" if i > 50 else "no")) for i in range(100)]
    df = spark.createDataFrame(data, "a double, b double, y string")
    for kind, params in (("logistic", {}), ("rf", {"n_estimators": 5})):
        m = ml.TabularModel(kind, "classification", params).fit(df, ["a", "b"], "y")
        got = m.transform(df).collect()
        assert m.labels_ == ["no", "yes"] and all(len(r["proba"]) == 2 and r["y_pred"] in m.labels_ for r in got)
    with pytest.raises(ValueError, match="'a'"):
        ml.TabularModel("rf", "classification").fit(df.withColumn("a", F.lit(None).cast("double")), ["a", "b"], "y")
    labels = spark.createDataFrame([(float(i),) for i in range(11)], "y double")
    assert ml.infer_task(labels, "y") == "regression" and ml.infer_task(labels.where("y < 10"), "y") == "classification"


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from vitalis import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session)


def test_nan_is_missing_and_knn_is_a_step(spark):
    from vitalis.operators.clean import Imputer, Preprocessor

    df = spark.createDataFrame([(1, 1.0, 10.0), (2, float("nan"), 20.0), (3, 3.0, None), (4, 2.0, 11.0)], "row_id long, a double, b double")
    assert Imputer(["a"]).fit(df).values_["a"] == 2.0
    assert [r["a"] for r in Imputer(["a"]).fit(df).transform(df).orderBy("row_id").collect()] == [1.0, 2.0, 3.0, 2.0]
    p = Preprocessor(["a", "b"], scaling="none", impute_strategy="knn").fit(df)
    got = p.transform(df).orderBy("row_id").collect()
    assert all(r["a"] is not None and r["b"] is not None for r in got) and got[0]["a"] == 1.0


def test_bootstrap_centre_and_own_metric(spark):
    from vitalis.operators import resample

    df = spark.createDataFrame([(i, float(i), float(i) + (i % 3) - 1) for i in range(90)] + [(99, 1.0, None)], "row_id long, y_true double, y_pred double")
    r = resample.bootstrap_ci(df, metric="mae", n_boot=300).first()
    assert r["mean"] == pytest.approx(2 / 3) and r["lower"] < r["mean"] < r["upper"]
    bias = ({"e": F.col("y_pred") - F.col("y_true")}, lambda: F.col("e") / F.col("w"))
    r = resample.bootstrap_ci(df, metric=bias, n_boot=300).first()
    assert r["mean"] == pytest.approx(0) and r["lower"] < 0 < r["upper"]


def test_models_save_load_and_refuse_unknown_parameters(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 7), "x" if i % 7 > 3 else "y", float(i % 7) + i) for i in range(80)], "a double, b double, y string, z double")
    for kind, label, params in (("rf", "y", {"n_estimators": 5, "max_depth": None, "min_samples_split": 10}), ("svm", "y", {"n_components": 10, "max_iter": 5}), ("elastic", "z", {"alpha": 0.1})):
        m = ml.TabularModel(kind, "regression" if label == "z" else "classification", params).fit(df, ["a", "b"], label)
        m.save(str(tmp_path / kind))
        again = ml.TabularModel.load(str(tmp_path / kind))
        assert again.labels_ == m.labels_ and [r["y_pred"] for r in again.transform(df).collect()] == [r["y_pred"] for r in m.transform(df).collect()]
    with pytest.raises(ValueError, match="max_leaves"):
        ml.TabularModel("rf", "classification", {"max_leaves": 3}).fit(df, ["a", "b"], "y")
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_a_rule_that_raises_is_an_entry(rows):
    rules = {"ok": F.col("x") >= 0, "bad": F.col("x") > 50, "raises": F.raise_error(F.lit("boom")).cast("boolean"), "missing": F.col("nothing") > 0}
    got = {r["rule"]: r for r in stats.validate_rules(rows, rules).collect()}
    assert got["ok"]["ok"] and got["bad"]["violations"] == 51
    assert all(not got[r]["ok"] and got[r]["violations"] is None and got[r]["error"] for r in ("raises", "missing"))
