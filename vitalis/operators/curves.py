"""Threshold curves (ROC, precision-recall), AUC / AP and calibration.

Scores are first collapsed to one row per distinct (class, score) with
positive and negative counts, so ties form one curve point and a hot score
value costs one row.  Cumulative counts in descending score order come from
the distributed prefix-sum helper (no single-task window).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.operators.ordering import prefix_sums


def _score_counts(df: DataFrame, y_true: str, score: str, positive=1, scores_array: bool = False) -> DataFrame:
    """(cls, score, pos, neg) per distinct score; binary uses cls = 0."""
    if scores_array:
        e = df.select(F.col(y_true).alias("_y"), F.posexplode(score).alias("cls", "_s"))
        lab = (F.col("_y") == F.col("cls")).cast("double")
    else:
        e = df.select(F.col(y_true).alias("_y"), F.col(score).cast("double").alias("_s"), F.lit(0).alias("cls"))
        lab = (F.col("_y") == F.lit(positive)).cast("double")
    return e.groupBy("cls", F.col("_s").alias("score")).agg(
        F.sum(lab).alias("pos"), F.sum(1 - lab).alias("neg"))


def _cumulative(counts: DataFrame, per_class: bool) -> DataFrame:
    """Adds cum_pos/cum_neg (inclusive, within class, descending score) and class totals P, N.

    One-vs-rest curves restart the running sums per class (start offsets and
    totals joined on the class); a single binary curve needs neither join: its
    prefix starts at 0 and its totals are two numbers.
    """
    pref = prefix_sums(counts, [F.col("cls").asc(), F.col("score").desc()], ["pos", "neg"])
    if per_class:
        tot = counts.groupBy("cls").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
        start = pref.groupBy("cls").agg(F.min("pos_before").alias("_sp"), F.min("neg_before").alias("_sn"))
        j = pref.join(start, "cls").join(tot, "cls")
    else:
        t = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
        j = pref.select("*", F.lit(0.0).alias("_sp"), F.lit(0.0).alias("_sn"),
                        F.lit(t["P"] or 0.0).alias("P"), F.lit(t["N"] or 0.0).alias("N"))
    return j.select("cls", "score", "pos", "neg", "P", "N",
                    (F.col("pos_before") - F.col("_sp") + F.col("pos")).alias("cum_pos"),
                    (F.col("neg_before") - F.col("_sn") + F.col("neg")).alias("cum_neg"))


def roc_curve(df: DataFrame, y_true: str = "y_true", score: str = "score", positive=1,
              scores_array: bool = False) -> DataFrame:
    """(cls, threshold, fpr, tpr) per distinct score, every threshold kept, and each class's origin (threshold NULL)."""
    counts = _score_counts(df, y_true, score, positive, scores_array)
    c = _cumulative(counts, scores_array).select(
        "cls", F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"))
    return c.union(_end(counts, 0.0, 0.0))


def _end(counts: DataFrame, a: float, b: float) -> DataFrame:
    """The point above every score: one row per class."""
    return counts.select("cls").distinct().select("cls", F.lit(None).cast("double"), F.lit(a), F.lit(b))


def roc_auc(df: DataFrame, y_true: str = "y_true", score: str = "score", positive=1,
            scores_array: bool = False) -> DataFrame:
    """Per class AUC (trapezoid = Mann-Whitney with ties at 1/2) and prevalence.

    ``AUC = sum(pos_s * (neg below s + neg_s / 2)) / (P * N)``.
    """
    c = _cumulative(_score_counts(df, y_true, score, positive, scores_array), scores_array)
    below = F.col("N") - F.col("cum_neg")
    term = F.col("pos") * (below + F.col("neg") / 2)
    return c.groupBy("cls").agg(
        F.try_divide(F.sum(term), F.first("P") * F.first("N")).alias("auc"),
        F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))


def roc_auc_weighted(df: DataFrame, y_true: str = "y_true", scores: str = "scores") -> DataFrame:
    """One-vs-rest AUC averaged with class prevalence weights (classes present in y_true)."""
    per = roc_auc(df, y_true, scores, scores_array=True).where(F.col("n_pos") > 0)
    return per.agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("roc_auc"))


def pr_curve(df: DataFrame, y_true: str = "y_true", score: str = "score", positive=1,
             scores_array: bool = False) -> DataFrame:
    """(threshold, precision, recall) per distinct score and the closing point (NULL, 1, 0); with arrays of scores per cls."""
    counts = _score_counts(df, y_true, score, positive, scores_array)
    c = _cumulative(counts, scores_array).select(
        "cls", F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("P")).alias("recall"))
    c = c.union(_end(counts, 1.0, 0.0))
    return c if scores_array else c.drop("cls")


def average_precision(df: DataFrame, y_true: str = "y_true", score: str = "score", positive=1,
                      scores_array: bool = False) -> DataFrame:
    """AP = sum over thresholds of (recall step) x precision (step sum, not trapezoid); with arrays of scores per cls."""
    c = _cumulative(_score_counts(df, y_true, score, positive, scores_array), scores_array)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    ap = F.try_divide(F.sum(F.col("pos") * prec), F.first("P")).alias("avg_precision")
    return c.groupBy("cls").agg(ap) if scores_array else c.agg(ap)


def calibration_edges(n_bins: int = 10) -> list[float]:
    """Inner bin edges exactly as an evenly spaced grid on [0, 1] produces them."""
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]


def calibration(df: DataFrame, y_true: str = "y_true", prob: str = "score", n_bins: int = 10) -> DataFrame:
    """(bin, prob_true, prob_pred, n) for non-empty uniform bins; bin = inner edges strictly below p."""
    p = F.col(prob).cast("double")
    b = F.lit(0)
    for e in calibration_edges(n_bins):   # number of inner edges strictly below p
        b = b + (F.lit(e) < p).cast("int")
    return df.where(p.isNotNull()).groupBy(b.alias("bin")).agg(
        F.avg(F.col(y_true).cast("double")).alias("prob_true"), F.avg(p).alias("prob_pred"),
        F.count(F.lit(1)).alias("n"))


def calibration_error(df: DataFrame, y_true: str = "y_true", prob: str = "score", n_bins: int = 10) -> DataFrame:
    """ECE (count-weighted mean |prob_true - prob_pred|) and MCE (max) over the same bins."""
    cal = calibration(df, y_true, prob, n_bins)
    gap = F.abs(F.col("prob_true") - F.col("prob_pred"))
    return cal.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


__all__ = ["roc_curve", "roc_auc", "roc_auc_weighted", "pr_curve", "average_precision", "calibration",
           "calibration_error", "calibration_edges"]
