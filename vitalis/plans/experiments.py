"""Diagnostic experiments composed from the operators (group CV, classification, normalised features)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.operators import features as FE
from vitalis.operators import metrics as M
from vitalis.operators import stats
from vitalis.operators.ml import OrdinalClassifier, TabularModel
from vitalis.operators.split import group_kfold, split_random, split_stratified


def group_cv(df: DataFrame, features: Sequence[str], label: str, group: str, k: int = 5, kind: str = "rf",
             row_id: str = "row_id") -> DataFrame:
    """Per-fold regression metrics for group folds (no group in two folds) next to random k-fold."""
    g = group_kfold(df, group, k).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    for scheme, frame in (("group", g), ("random", _random_folds(df, row_id, k))):
        for i in range(k):
            tr, te = frame.where(F.col("fold") != i), frame.where(F.col("fold") == i)
            m = TabularModel(kind, "regression").fit(tr, features, label)
            r = M.regression_metrics(m.transform(te), label, "y_pred", metrics=("mse", "mae", "r2")).first()
            rows.append((scheme, i, r["n"], r["mse"], r["mae"], r["r2"]))
    g.unpersist()
    return df.sparkSession.createDataFrame(rows, "scheme string, fold int, n long, mse double, mae double, r2 double")


def _random_folds(df, row_id, k):
    from vitalis.operators.split import kfold

    return kfold(df, row_id, k)


def classify_experiment(df: DataFrame, features: Sequence[str], target: str, condition: str, row_id: str = "row_id",
                        classes: Sequence[str] = ("Low", "Medium", "High")) -> DataFrame:
    """Condition-relative features + 3 quantile classes + stratified split; ordinal model vs balanced forest.

    Returns accuracy rows: overall (and adjacent accuracy for the ordinal model) and per condition.
    """
    base = FE.group_baseline(df, condition, {f: f"{f}_resp" for f in features[:2]})
    feats = list(features) + [f"{f}_resp" for f in features[:2]]
    q = stats.qcut3(base, target, labels=classes, out="y_class")
    s = split_stratified(q, row_id, "y_class", 0.2, 42).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    ordm = OrdinalClassifier(list(classes)).fit(train, feats, "y_class")
    po = ordm.transform(test).select(row_id, condition, "y_class", F.col("y_pred").cast("string").alias("y_pred"))
    # class-balanced forest: weight each row by n / (n_classes * n_class)
    counts = {r["y_class"]: r["n"] for r in train.groupBy("y_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    w = F.create_map(*[x for c, cnt in counts.items() for x in (F.lit(c), F.lit(n / (len(counts) * cnt)))])
    rf = TabularModel("rf", "classification", {"weight_col": "_w"}).fit(
        train.withColumn("_w", w[F.col("y_class")]), feats, "y_class")
    pr = rf.transform(test).select(row_id, condition, "y_class", "y_pred")
    out = None
    for name, p in (("ordinal", po), ("forest", pr)):
        overall = M.ordinal_metrics(p, list(classes), "y_class", "y_pred").select(
            F.lit(name).alias("model"), F.lit("all").alias("group"), "accuracy", "adjacent_accuracy")
        by = stats.accuracy_by_group(p, "y_class", "y_pred", condition).select(
            F.lit(name).alias("model"), F.col(condition).cast("string").alias("group"), "accuracy",
            F.lit(None).cast("double").alias("adjacent_accuracy"))
        part = overall.unionByName(by)
        out = part if out is None else out.unionByName(part)
    s.unpersist()
    return out


def normalized_experiment(df: DataFrame, features: Sequence[str], label: str, entity: str, row_id: str = "row_id",
                          top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per-entity z-scored features -> forest -> regression metrics and the top importances."""
    z = FE.entity_zscore(df, entity, features)
    zcols = [f"{f}_pilot_norm" for f in features]
    z = z.na.fill(0.0, subset=zcols)
    s = split_random(z, row_id, 0.2, 42)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    m = TabularModel("rf", "regression").fit(train, zcols, label)
    met = M.regression_metrics(m.transform(test), label, "y_pred", metrics=("mse", "rmse", "mae", "r2"))
    imp = stats.topk(m.importances(), "importance", "feature", top)
    return met, imp
