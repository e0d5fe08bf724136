"""Isolation forest (Liu, Ting & Zhou 2008) on Spark.

* Sampling: one md5 draw per row keeps a candidate pool of about
  ``4 * n_trees * psi`` rows; the pool is exploded over tree ids and each tree
  keeps its ``psi`` rows with the smallest per-tree hash (replayable).
* Building: ``applyInPandas`` per tree id (psi rows each) grows a random
  isolation tree to depth ceil(log2 psi) and returns it as node rows.
* Scoring: the trees (n_trees x (2 psi - 1) nodes, a fixed bound) are shipped
  in the UDF closure; an Arrow UDF walks all trees for a batch of rows at once.
  score = 2 ** (-E[h(x)] / c(psi)).
* Cut: rows whose score is above the (1 - contamination) quantile are outliers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vitalis import ship_package
from vitalis.functions.columns import md5_unit
from vitalis.operators.gram import value
from vitalis.operators.quantiles import exact_quantiles
from vitalis.session import written

EULER_GAMMA = 0.5772156649015329


def c_factor(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(X: np.ndarray, rng: np.random.Generator, limit: int):
    feat, thr, left, right, size, depth = [], [], [], [], [], []

    def node(idx: np.ndarray, d: int) -> int:
        me = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx)), depth.append(d)
        if d >= limit or len(idx) <= 1:
            return me
        sub = X[idx]
        lo, hi = np.nanmin(sub, axis=0), np.nanmax(sub, axis=0)
        cand = np.nonzero(hi > lo)[0]
        if len(cand) == 0:
            return me
        q = int(rng.choice(cand))
        p = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < p
        feat[me], thr[me] = q, p
        left[me] = node(idx[go_left], d + 1)
        right[me] = node(idx[~go_left], d + 1)
        return me

    node(np.arange(len(X)), 0)
    return feat, thr, left, right, size, depth


def fit_isolation_forest(df: DataFrame, features: Sequence[str], row_id: str, n_trees: int = 100,
                         psi: int = 256, seed: int = 42) -> dict:
    """Grow the trees on Spark and return them as numpy arrays (bounded: n_trees x (2 psi - 1) nodes)."""
    feats = list(features)
    ship_package(df.sparkSession)
    n = df.count()
    psi = min(psi, n)
    keep = min(1.0, 4.0 * n_trees * psi / max(n, 1))
    pool = df.select(F.col(row_id).alias("_rid"), *[F.col(f).cast("double").alias(f) for f in feats])
    for f in feats:
        pool = pool.where(value(f).isNotNull())
    pool = pool.where(md5_unit(seed, F.lit("pool"), F.col("_rid")) < keep)
    e = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("_tree"))
    e = e.withColumn("_h", md5_unit(seed, F.col("_tree"), F.col("_rid")))
    # keep ~4 psi candidates per tree before the shuffle; each tree then takes its psi smallest hashes
    per_tree = min(1.0, 4.0 * psi / max(keep * n, 1.0))
    e = e.where(F.col("_h") < per_tree)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    schema = "_tree int, node int, feat int, thr double, left int, right int, size int, depth int"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_tree"].iloc[0])
        pdf = pdf.nsmallest(psi, ["_h", "_rid"])
        X = pdf[feats].to_numpy(np.float64)
        rng = np.random.default_rng([seed, t])
        f, th, le, ri, sz, dp = _grow(X, rng, limit)
        return pd.DataFrame({"_tree": t, "node": np.arange(len(f)), "feat": f, "thr": th, "left": le,
                             "right": ri, "size": sz, "depth": dp})

    nodes = e.groupBy("_tree").applyInPandas(build, schema).toPandas()  # bounded by n_trees * (2 psi - 1)
    trees = []
    for t, g in nodes.groupby("_tree"):
        g = g.sort_values("node")
        trees.append({k: g[k].to_numpy() for k in ("feat", "thr", "left", "right", "size", "depth")})
    return {"trees": trees, "psi": psi, "features": feats, "limit": limit}


def score_isolation_forest(df: DataFrame, forest: dict, out: str = "anomaly_score") -> DataFrame:
    trees, psi, feats = forest["trees"], forest["psi"], forest["features"]
    cpsi = float(c_factor(np.array([psi]))[0]) or 1.0
    limit = forest["limit"]

    @F.pandas_udf(DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(np.float64) for c in cols])
        total = np.zeros(len(X))
        rows = np.arange(len(X))
        for tr in trees:
            node = np.zeros(len(X), dtype=np.int64)
            for _ in range(limit + 1):
                f = tr["feat"][node]
                internal = f >= 0
                if not internal.any():
                    break
                xv = X[rows, np.where(internal, f, 0)]
                go_left = xv < tr["thr"][node]
                nxt = np.where(go_left, tr["left"][node], tr["right"][node])
                node = np.where(internal, nxt, node)
            total += tr["depth"][node] + c_factor(tr["size"][node])
        return pd.Series(np.power(2.0, -(total / len(trees)) / cpsi))

    whole = F.lit(True)
    for f in feats:
        whole = whole & value(f).isNotNull()
    return df.withColumn(out, F.when(whole, score(*[F.coalesce(value(f), F.lit(0.0)) for f in feats])))


def isolation_forest(df: DataFrame, features: Sequence[str], row_id: str, contamination: float = 0.1,
                     n_trees: int = 100, psi: int = 256, seed: int = 42) -> DataFrame:
    """Adds anomaly_score and is_outlier (score above the exact 1 - contamination quantile).

    A row with NULL or NaN in a feature teaches nothing, has no score and is no outlier.
    """
    _check_share(contamination)
    df = written(df, "rows")  # read for the forest and for its scores
    scored = written(score_isolation_forest(df, fit_isolation_forest(df, features, row_id, n_trees, psi, seed)), "scores")
    cut = _cut(scored, contamination)
    return scored.withColumn("is_outlier", F.coalesce(F.col("anomaly_score") > F.lit(cut), F.lit(False)))


def fit_cut(df: DataFrame, features: Sequence[str], row_id: str, contamination: float = 0.1, n_trees: int = 100,
            psi: int = 256, seed: int = 42) -> tuple[dict, float]:
    """The forest and the score beyond which a row is an outlier (infinite without a whole row)."""
    _check_share(contamination)
    forest = fit_isolation_forest(df, features, row_id, n_trees, psi, seed)
    return forest, _cut(written(score_isolation_forest(df, forest).select("anomaly_score"), "scores"), contamination)


def _check_share(contamination: float) -> None:
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")


def _cut(scores: DataFrame, contamination: float) -> float:
    cut = exact_quantiles(scores, {"s": "anomaly_score"}, [1 - contamination])["s"]
    return cut[0] if cut else math.inf
