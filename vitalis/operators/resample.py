"""Resampling: Poisson bootstrap confidence intervals.

Each (replicate b, row) gets a Poisson(1) weight (Chamandy et al. 2012), so no
row is copied or shuffled: a metric is a function of weighted sums, and every
task adds up one vector of sums per replicate over its rows (numpy, in Arrow
batches); only these vectors are shuffled.  The uniform behind a weight comes from
one md5 of ``seed|row_id`` per row mixed with the replicate number by integer
steps (``mixed_unit``), so the draws are replayable in SQL and a recomputed task
draws the same weights again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalis import ship_package
from vitalis.functions.columns import md5_int32, mixed_unit_array
from vitalis.operators.stats import quantile

#: Draws made at once in a task.
_DRAWS = 1 << 20


def poisson1_cdf(kmax: int = 12) -> list[float]:
    """CDF of Poisson(1) at k = 0..kmax-1 (the weight is the count of CDF values <= u; weights over 12 have 6e-11 of the mass)."""
    out, acc = [], 0.0
    for k in range(kmax):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def bootstrap_replicates(df: DataFrame, row_id: str, terms: Mapping[str, Column], n_boot: int = 1000,
                         seed: int = 42) -> DataFrame:
    """Weighted sums per replicate: (b, w, one column per term); rows with a NULL term take no part."""
    ship_package(df.sparkSession)
    names = list(terms)
    base = df.select(md5_int32(seed, F.col(row_id)).alias("_h"), *[c.cast("double").alias(n) for n, c in terms.items()])
    cdf = np.array(poisson1_cdf())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_boot, 1 + len(names)))
        step = max(1, _DRAWS // n_boot)
        for pdf in batches:
            h, x = pdf["_h"].to_numpy(np.int64), pdf[names].to_numpy(np.float64)
            for i in range(0, len(h), step):
                w = np.searchsorted(cdf, mixed_unit_array(h[i:i + step], n_boot), side="right").astype(np.float64)
                total[:, 0] += w.sum(0)
                total[:, 1:] += w.T @ x[i:i + step]
        yield pd.DataFrame({"b": np.arange(n_boot, dtype=np.int32), "w": total[:, 0]} | {n: total[:, k + 1] for k, n in enumerate(names)})

    schema = "b int, w double, " + ", ".join(f"{n} double" for n in names)
    return base.dropna().mapInPandas(sums, schema).groupBy("b").agg(*[F.sum(n).alias(n) for n in ["w", *names]])


def _terms(y: Column, p: Column) -> dict[str, Column]:
    e = y - p
    return {"e2": e * e, "ae": F.abs(e), "hit": (y == p).cast("double"), "y": y, "y2": y * y}


#: name -> (terms it needs, value from the sums; ``w`` is the number of rows drawn)
METRICS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "mse": (("e2",), lambda: F.col("e2") / F.col("w")),
    "rmse": (("e2",), lambda: F.sqrt(F.col("e2") / F.col("w"))),
    "mae": (("ae",), lambda: F.col("ae") / F.col("w")),
    "accuracy": (("hit",), lambda: F.col("hit") / F.col("w")),
    "r2": (("e2", "y", "y2"), lambda: F.try_divide(F.lit(-1.0) * F.col("e2"), F.col("y2") - F.col("y") * F.col("y") / F.col("w")) + 1),
}


def bootstrap_ci(df: DataFrame, row_id: str = "row_id", y_true: str = "y_true", y_pred: str = "y_pred",
                 metric: str | tuple[Mapping[str, Column], Callable[[], Column]] = "mse", n_boot: int = 1000,
                 confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(metric, mean, lower, upper): the metric of the sample and its percentiles over Poisson-bootstrap replicates.

    ``metric`` is a name in ``METRICS`` or a pair: columns to add up, and a function that
    returns the metric as an expression over their sums and ``w``.
    """
    if isinstance(metric, str):
        needed, value = METRICS[metric]
        every = _terms(F.col(y_true).cast("double"), F.col(y_pred).cast("double"))
        terms = {n: every[n] for n in needed}
    else:
        terms, value = metric
    reps = bootstrap_replicates(df, row_id, terms, n_boot, seed).where(F.col("w") > 0)
    lo, hi = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    q = reps.select(value().alias("m")).agg(quantile(F.col("m"), [lo, hi]).alias("_q"))  # n_boot numbers
    whole = df.select(*[c.cast("double").alias(n) for n, c in terms.items()]).dropna()
    sample = whole.agg(F.count(F.lit(1)).cast("double").alias("w"), *[F.sum(n).alias(n) for n in terms])
    name = metric if isinstance(metric, str) else "metric"
    centre = sample.where("w > 0").select(value().cast("double")).first()
    mean = F.lit(centre[0] if centre else None).cast("double").alias("mean")
    return q.select(F.lit(name).alias("metric"), mean, F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))
