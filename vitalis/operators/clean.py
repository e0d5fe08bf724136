"""Cleaning and feature transforms with fit / apply semantics.

``fit`` runs one aggregate over all columns and keeps a small dictionary of
statistics (one value per column, like a Spark ML model); ``transform`` turns
those into column expressions, so applying a fitted step never shuffles and
runs the same on a batch or a streaming DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalis import ship_package
from vitalis.functions.columns import log1p_safe, nan_to_null, sqrt_safe
from vitalis.operators.quantiles import exact_quantiles


# ------------------------------------------------------------------ B9 / B10

@dataclass
class OutlierRemover:
    """zscore (keep |z| < t, sample std), iqr (keep q1 - t*iqr <= x <= q3 + t*iqr) or isolation_forest.

    The forest needs ``row_id`` and keeps the rows up to the exact 1 - ``contamination``
    quantile of the training rows' scores.  A missing value drops the row with every method.
    """

    columns: Sequence[str]
    method: str = "zscore"
    threshold: float = 3.0
    stats_: dict = field(default_factory=dict)
    row_id: str | None = None
    contamination: float = 0.1
    seed: int = 42

    def fit(self, df: DataFrame) -> "OutlierRemover":
        if self.method == "isolation_forest":
            from vitalis.operators.isoforest import fit_cut

            if self.row_id is None:
                raise ValueError("isolation_forest needs row_id")
            forest, cut = fit_cut(df, list(self.columns), self.row_id, self.contamination, seed=self.seed)
            self.stats_ = {"forest": forest, "cut": cut}
            return self
        if self.method not in ("zscore", "iqr"):
            raise ValueError(f"Unknown outlier detection method: {self.method}")
        aggs = []
        for i, c in enumerate(self.columns):
            x = _number(c)
            if self.method == "iqr":
                continue
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        row = df.agg(*aggs).first().asDict() if aggs else {}
        edges = exact_quantiles(df, {c: c for c in self.columns}, [0.25, 0.75]) if self.method == "iqr" else {}
        for i, c in enumerate(self.columns):
            q = edges.get(c) or [None, None]
            self.stats_[c] = {"mean": row.get(f"m{i}"), "std": row.get(f"s{i}"), "q1": q[0], "q3": q[1]}
        return self

    def keep_condition(self) -> Column:
        cond = F.lit(True)
        t = self.threshold
        for c in self.columns:
            s, x = self.stats_[c], _number(c)
            if self.method == "zscore":
                z = F.abs(F.try_divide(x - F.lit(s["mean"]), F.lit(s["std"])))
                cond = cond & (z < t)
            else:
                iqr = s["q3"] - s["q1"] if s["q1"] is not None else None
                lo = F.lit(s["q1"] - t * iqr if iqr is not None else None)
                hi = F.lit(s["q3"] + t * iqr if iqr is not None else None)
                cond = cond & (x >= lo) & (x <= hi)
        # a NULL comparison (missing value, NaN, zero std) drops the row; the statistics pass over it
        return F.coalesce(cond, F.lit(False))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.method == "isolation_forest":
            return self.flag(df, "_keep").where("_keep").drop("_keep")
        return df.where(self.keep_condition())

    def flag(self, df: DataFrame, name: str = "is_inlier") -> DataFrame:
        if self.method != "isolation_forest":
            return df.withColumn(name, self.keep_condition())
        from vitalis.operators.isoforest import score_isolation_forest

        ship_package(df.sparkSession)
        scored = score_isolation_forest(df, self.stats_["forest"], "_score")
        return scored.withColumn(name, F.coalesce(F.col("_score") <= F.lit(self.stats_["cut"]), F.lit(False))).drop("_score")


def remove_outliers(df: DataFrame, columns: Sequence[str], method: str = "zscore", threshold: float = 3.0,
                    row_id: str | None = None, contamination: float = 0.1) -> DataFrame:
    """Self-fitted outlier removal (zscore, iqr or isolation_forest)."""
    return OutlierRemover(columns, method, threshold, row_id=row_id, contamination=contamination).fit(df).transform(df)


# ------------------------------------------------------------------ J1

@dataclass
class Imputer:
    """mean / median / most_frequent / constant for numeric columns; most_frequent / constant for strings.

    Ties of most_frequent go to the smallest value.  Exact median (Spark ML's
    ``Imputer`` uses an approximate one and has no string or constant support).
    """

    columns: Sequence[str]
    strategy: str = "mean"
    categorical: Sequence[str] = ()
    categorical_strategy: str = "most_frequent"
    fill_value: float = 0.0
    fill_text: str = "missing_value"
    values_: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Imputer":
        aggs = []
        if self.strategy == "mean":
            aggs = [F.avg(_number(c)).alias(c) for c in self.columns]
        elif self.strategy == "median":
            medians = exact_quantiles(df, {c: c for c in self.columns}, [0.5])
            self.values_.update({c: q[0] if q else None for c, q in medians.items()})
        elif self.strategy == "constant":
            self.values_.update({c: self.fill_value for c in self.columns})
        elif self.strategy != "most_frequent":
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if aggs:
            self.values_.update(df.agg(*aggs).first().asDict())
        modes = list(self.columns) if self.strategy == "most_frequent" else []
        if self.categorical_strategy == "most_frequent":
            modes += list(self.categorical)
        else:
            self.values_.update({c: self.fill_text for c in self.categorical})
        if modes:
            self.values_.update(most_frequent(df, modes))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill NULLs; numeric columns come out as double (a mean is not an integer)."""
        out = df
        for c, v in self.values_.items():
            if v is None:
                continue
            if df.schema[c].dataType.typeName() == "string":
                out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
            else:
                out = out.withColumn(c, F.coalesce(_number(c), F.lit(float(v))))
        return out


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent non-null value per column (ties -> smallest), one (column, value) count pass."""
    typed = {c: df.schema[c].dataType for c in columns}

    def num(c):
        return F.lit(None).cast("double") if typed[c].typeName() == "string" else F.col(c).cast("double")

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"),
                                         num(c).alias("d")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.*").where(F.col("v").isNotNull())
    counts = long.groupBy("c", "v", "d").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("d"), F.col("v"))).alias("b"))
    out = {}
    for r in best.collect():  # one row per column: bounded by the column count
        v = r["b"]["v"]
        out[r["c"]] = v if typed[r["c"]].typeName() == "string" else float(r["b"]["d"])
    return out


# ------------------------------------------------------------------ J2

#: Pairs of a receiver and a donor beyond which near donors are looked at first.
PAIRS = 1 << 28

def _block_topk(rids: np.ndarray, R: np.ndarray, dids: np.ndarray, D: np.ndarray, k: int,
                chunk: int = 1024, rblock: int = 4096, own: bool = True):
    """Exact k nearest donors of every receiver, per missing column, for one (receiver, donor) block.

    nan-euclidean distance ``sqrt(p / |present| * sum((r - d)^2))`` over features
    present in both; donors must have the target column; ties go to the smaller
    donor id; a donor with the receiver's id is none (``own``).  Returns arrays (rid, col, dist, did, val) of the kept candidates.
    """
    p = R.shape[1]
    order = np.argsort(dids, kind="stable")
    dids, D = dids[order], D[order]
    Rm, Dm = ~np.isnan(R), ~np.isnan(D)
    R0, D0 = np.nan_to_num(R), np.nan_to_num(D)
    nr = len(rids)
    big = np.iinfo(np.int64).max
    best_d = np.full((p, nr, k), np.inf)
    best_id = np.full((p, nr, k), big, dtype=np.int64)
    best_v = np.zeros((p, nr, k))
    for s0 in range(0, len(dids), chunk):
        cd_ids, Dc, Dcm, Dc0 = dids[s0:s0 + chunk], D[s0:s0 + chunk], Dm[s0:s0 + chunk], D0[s0:s0 + chunk]
        c = len(cd_ids)
        for r0 in range(0, nr, rblock):
            r1 = min(nr, r0 + rblock)
            cnt = np.zeros((r1 - r0, c))
            ss = np.zeros((r1 - r0, c))
            for f in range(p):   # one feature at a time: 2-D temporaries only
                both = Rm[r0:r1, f][:, None] & Dcm[:, f][None, :]
                d = R0[r0:r1, f][:, None] - Dc0[:, f][None, :]
                ss += np.where(both, d * d, 0.0)
                cnt += both
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = np.sqrt(p / cnt * ss)
            dist[cnt == 0] = np.inf
            if own:
                dist[cd_ids[None, :] == rids[r0:r1, None]] = np.inf
            for j in range(p):
                need = ~Rm[r0:r1, j]
                if not need.any():
                    continue
                rows = np.nonzero(need)[0]
                g = r0 + rows
                dj = np.where(Dcm[None, :, j], dist if need.all() else dist[rows], np.inf)
                # donors come in id order, so one as far as the k-th found never replaces it
                last = best_d[j][g, -1:]
                if not np.isfinite(last).all() and c > k:
                    last = np.minimum(last, np.partition(dj, k - 1, axis=1)[:, k - 1:k])
                    ri, ci = np.nonzero((dj <= last) & np.isfinite(dj))
                else:
                    ri, ci = np.nonzero(dj < last)
                if not len(ri):
                    continue
                # the k found so far and the nearer donors of this chunk, the first k by (distance, id)
                hit = np.unique(ri)
                at = np.concatenate([np.repeat(hit, k), ri])
                md = np.concatenate([best_d[j][g[hit]].ravel(), dj[ri, ci]])
                mi = np.concatenate([best_id[j][g[hit]].ravel(), cd_ids[ci]])
                mv = np.concatenate([best_v[j][g[hit]].ravel(), Dc0[ci, j]])
                o = np.lexsort((mi, md, at))
                begin = np.searchsorted(at[o], hit)
                o = o[begin[:, None] + np.arange(k)]
                best_d[j][g[hit]], best_id[j][g[hit]], best_v[j][g[hit]] = md[o], mi[o], mv[o]
    out = []
    for j in range(p):
        ok = np.isfinite(best_d[j]) & (~Rm[:, j])[:, None]
        ri, kk = np.nonzero(ok)
        out.append((rids[ri], np.full(len(ri), j, np.int32), best_d[j][ri, kk], best_id[j][ri, kk], best_v[j][ri, kk]))
    return [np.concatenate(x) for x in zip(*out)]


def _number(c: str) -> Column:
    """A column as double, NaN as NULL: both are missing."""
    return nan_to_null(F.col(c).cast("double"))


def knn_impute(df: DataFrame, row_id: str, columns: Sequence[str], k: int = 5, block_rows: int = 50000,
               donor_block_rows: int = 50000, donors: DataFrame | None = None) -> DataFrame:
    """KNN imputation with nan-euclidean distance and uniform donor means.

    Distance between a receiver r and a donor d over the features present in
    both: ``sqrt(p / |present| * sum((r - d)^2))``.  For each missing column the
    donors are rows having that column; the k nearest (ties by donor id) are
    averaged; without any donor the column mean is used.  Donors and means come from
    ``donors`` (training rows), by default from ``df`` itself; NaN is missing like NULL.

    Receivers (rows with a NULL) are hashed into blocks of about ``block_rows``
    rows and donors into blocks of about ``donor_block_rows``; every (receiver
    block, donor block) pair is one ``cogroup`` task that keeps only its exact
    k best per (receiver, column), so a task holds two bounded blocks and no
    receiver x donor pair is ever a row.  The global k best come from a
    ``row_number`` over that small candidate set.  Nothing passes through the
    driver except the block counts; the work is the exact O(receivers x donors).

    Beyond ``PAIRS`` such pairs the blocks are first the cells of ``knncells``: a receiver
    meets near donors, those of wider cells while the k found may not be the nearest, and
    only then all donors in the blocks above.  The donors found are the same.
    """
    cols = list(columns)
    ship_package(df.sparkSession)
    feats = number_features(df, row_id, cols)
    source = feats if donors is None else number_features(donors, row_id, cols)
    receivers = feats.where(any_missing(cols))
    if receivers.count() * source.count() > PAIRS:
        from vitalis.operators import knncells

        return knncells.knn_impute_lsh(df, row_id, cols, k, donors, block=min(block_rows, donor_block_rows, knncells.BLOCK))
    means = source.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    cands = block_candidates(receivers, source, cols, k, block_rows, donor_block_rows)
    return filled(df, row_id, cols, nearest(cands, k), means)


def number_features(df: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """(_rid, cols) with the columns as double, NaN as NULL."""
    return df.select(F.col(row_id).alias("_rid"), *[_number(c).alias(c) for c in cols])


def any_missing(cols: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
    return out


def topk_frame(rpdf: pd.DataFrame, dpdf: pd.DataFrame, cols: Sequence[str], k: int, own: bool = True) -> pd.DataFrame:
    """The k nearest donors of each receiver and missing column in two blocks: (_rid, _col, _dist, _did, _val)."""
    if rpdf.empty or dpdf.empty:
        return pd.DataFrame({"_rid": [], "_col": [], "_dist": [], "_did": [], "_val": []})
    r_ids, c_ids, dist, d_ids, vals = _block_topk(
        rpdf["_rid"].to_numpy(np.int64), rpdf[list(cols)].to_numpy(np.float64),
        dpdf["_rid"].to_numpy(np.int64), dpdf[list(cols)].to_numpy(np.float64), k, own=own)
    return pd.DataFrame({"_rid": r_ids, "_col": c_ids.astype(np.int32), "_dist": dist, "_did": d_ids, "_val": vals})


def block_candidates(recv: DataFrame, source: DataFrame, cols: Sequence[str], k: int, block_rows: int = 50000,
                     donor_block_rows: int = 50000, own: bool = True) -> DataFrame:
    """(_rid, _col, _dist, _did, _val): the k nearest donors of every receiver in every block of donors."""
    n_recv = recv.count()
    n_all = source.count()
    b_r = max(1, -(-n_recv // block_rows))
    b_d = max(1, -(-n_all // donor_block_rows), recv.sparkSession.sparkContext.defaultParallelism if n_recv else 1)
    recv = recv.withColumn("_rb", F.pmod(F.xxhash64("_rid"), F.lit(b_r)))
    recv = recv.select("*", F.explode(F.sequence(F.lit(0), F.lit(b_d - 1))).alias("_db"))
    don = source.withColumn("_db", F.pmod(F.xxhash64("_rid"), F.lit(b_d)))
    don = don.select("*", F.explode(F.sequence(F.lit(0), F.lit(b_r - 1))).alias("_rb"))

    def pair(rpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        return topk_frame(rpdf, dpdf, cols, k, own)

    return recv.groupBy("_rb", "_db").cogroup(don.groupBy("_rb", "_db")).applyInPandas(
        pair, "_rid long, _col int, _dist double, _did long, _val double")


def nearest(cands: DataFrame, k: int) -> DataFrame:
    """The k nearest candidates of each receiver and missing column, ties by donor id."""
    w = Window.partitionBy("_rid", "_col").orderBy("_dist", "_did")
    return cands.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def filled(df: DataFrame, row_id: str, cols: Sequence[str], best: DataFrame, means: dict) -> DataFrame:
    """``df`` with its missing values replaced by the means of their donors, or else by the columns' means."""
    p = len(cols)
    fills = best.groupBy("_rid").pivot("_col", list(range(p))).agg(F.avg("_val"))
    fills = fills.select("_rid", *[F.col(str(j)).alias(f"_fill_{j}") for j in range(p)])
    j = df.join(fills, F.col(row_id) == F.col("_rid"), "left")
    for idx, c in enumerate(cols):
        j = j.withColumn(c, F.coalesce(_number(c), F.col(f"_fill_{idx}"), F.lit(means[c])))
    return j.drop("_rid", *[f"_fill_{i}" for i in range(p)])


@dataclass
class KnnImputer:
    """KNN imputation as a step: ``fit`` keeps the training rows as donors, ``transform`` fills from them."""

    columns: Sequence[str]
    row_id: str
    k: int = 5
    donors_: DataFrame | None = None

    def fit(self, df: DataFrame) -> "KnnImputer":
        self.donors_ = df.select(self.row_id, *self.columns)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return knn_impute(df, self.row_id, self.columns, self.k, donors=self.donors_)


# ------------------------------------------------------------------ J3

@dataclass
class Scaler:
    """standard (population std, 0 -> 1), minmax (range 0 -> 1), robust (median / IQR, 0 -> 1), none.  NaN is missing and comes out as NULL."""

    columns: Sequence[str]
    method: str = "standard"
    params_: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Scaler":
        if self.method not in ("standard", "minmax", "robust", "none"):
            raise ValueError(f"Unknown scaling method: {self.method}")
        if self.method == "none":
            return self
        aggs = []
        for i, c in enumerate(self.columns):
            x = _number(c)
            if self.method == "standard":
                aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
            elif self.method == "minmax":
                aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        row = df.agg(*aggs).first() if aggs else None
        edges = exact_quantiles(df, {c: c for c in self.columns}, [0.25, 0.5, 0.75]) if self.method == "robust" else {}
        for i, c in enumerate(self.columns):
            if self.method == "standard":
                loc, sc = row[f"a{i}"], row[f"b{i}"]
            elif self.method == "minmax":
                loc, sc = row[f"a{i}"], (None if row[f"a{i}"] is None else row[f"b{i}"] - row[f"a{i}"])
            else:
                q = edges[c]
                loc, sc = (q[1], q[2] - q[0]) if q else (None, None)
            self.params_[c] = (loc, 1.0 if not sc else sc)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, (loc, sc) in self.params_.items():
            out = out.withColumn(c, (_number(c) - F.lit(loc)) / F.lit(sc))
        return out


# ------------------------------------------------------------------ J4

def boxcox_expr(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def yeojohnson_expr(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def lambda_grid(center: float | None = None) -> list[float]:
    """Coarse grid -2..2 step 0.1, or a fine grid center +- 0.1 step 0.01 (rounded to 2 decimals)."""
    if center is None:
        return [round(-2 + 0.1 * i, 2) for i in range(41)]
    return [round(center - 0.1 + 0.01 * i, 2) for i in range(21)]


@dataclass
class PowerTransformer:
    """Box-Cox (x > 0) or Yeo-Johnson; lambda maximises the profile log-likelihood, then standardised.

    The log-likelihood of every grid lambda of every column is one aggregate: a coarse
    grid, which goes on beyond an end where the best lies until it lies inside, then a
    fine grid around the best (steps of 0.01, no limit to the lambda).  NaN is missing.
    """

    columns: Sequence[str]
    method: str = "yeo-johnson"
    standardize: bool = True
    lambdas_: dict = field(default_factory=dict)
    scale_: dict = field(default_factory=dict)

    def _expr(self, x: Column, lam: float) -> Column:
        return boxcox_expr(x, lam) if self.method == "box-cox" else yeojohnson_expr(x, lam)

    def _best(self, df: DataFrame, grids: dict) -> dict:
        """Best grid lambda per column in one pass: the grid index is exploded into rows and each
        column looks its lambda up by index, so there is one aggregate expression per column whatever
        the grid size (one expression per literal lambda would fall out of whole-stage codegen)."""
        size = max(len(g) for g in grids.values())
        e = df.select(*[_number(c).alias(c) for c in self.columns],
                      F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_g"))
        aggs = []
        for i, c in enumerate(self.columns):
            if c not in grids:
                continue
            lam = F.get(F.array(*[F.lit(float(v)) for v in grids[c]]), F.col("_g"))
            x = F.col(c)
            aggs += [F.count(x).alias(f"n{i}"), F.sum(self._jac(x)).alias(f"j{i}"),
                     F.var_pop(self._expr_col(x, lam)).alias(f"v{i}")]
        rows = e.groupBy("_g").agg(*aggs).collect()   # one row per grid position
        best = {}
        for i, c in enumerate(self.columns):
            if c not in grids:
                continue
            scores = []
            for r in rows:
                g = r["_g"]
                if g >= len(grids[c]):
                    continue
                lv, v, n, jc = grids[c][g], r[f"v{i}"], r[f"n{i}"], r[f"j{i}"]
                ll = -np.inf if not v or not 0 < v < np.inf else -n / 2.0 * np.log(v) + (lv - 1) * jc
                scores.append((ll, -abs(lv), lv))
            best[c] = max(scores)[2]
        return best

    def _jac(self, x: Column) -> Column:
        return F.log(x) if self.method == "box-cox" else F.signum(x) * F.log1p(F.abs(x))

    def _expr_col(self, x: Column, lam: Column) -> Column:
        """Transform with lambda given as a column (grid search)."""
        if self.method == "box-cox":
            return F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)
        pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
        neg = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
        return F.when(x >= 0, pos).otherwise(neg)

    def fit(self, df: DataFrame) -> "PowerTransformer":
        if self.method not in ("box-cox", "yeo-johnson"):
            raise ValueError(f"unknown method {self.method!r}")
        # three passes read the same columns: keep the projection cached for the fit
        df = df.select(*self.columns).persist()
        coarse = self._best(df, {c: lambda_grid() for c in self.columns})
        reach = dict.fromkeys(self.columns, 2.0)
        while open_ := {c for c in self.columns if abs(coarse[c]) >= reach[c] - 1e-9}:
            # the best lies at an end: as many steps again beyond it, and one back
            grids = {c: [round(math.copysign(reach[c] + 0.1 * i, coarse[c]), 2) for i in range(-1, 41)] for c in open_}
            reach.update({c: round(reach[c] + 4.0, 2) for c in open_})
            coarse.update(self._best(df, grids))
        self.lambdas_ = self._best(df, {c: lambda_grid(coarse[c]) for c in self.columns})
        if self.standardize:
            aggs = []
            for i, c in enumerate(self.columns):
                t = self._expr(_number(c), self.lambdas_[c])
                aggs += [F.avg(t).alias(f"m{i}"), F.stddev_pop(t).alias(f"s{i}")]
            row = df.agg(*aggs).first()
            for i, c in enumerate(self.columns):
                s = row[f"s{i}"]
                self.scale_[c] = (row[f"m{i}"], s if s else 1.0)
        df.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            t = self._expr(F.col(c).cast("double"), self.lambdas_[c])
            if self.standardize:
                m, s = self.scale_[c]
                t = (t - F.lit(m)) / F.lit(s)
            out = out.withColumn(c, t)
        return out


# ------------------------------------------------------------------ H1 / H2 / J6

@dataclass
class FunctionStep:
    """Column -> Column transform with an optional inverse (``inverse`` absent -> error)."""

    columns: Sequence[str]
    func: Callable[[Column], Column]
    inverse: Callable[[Column], Column] | None = None

    def fit(self, df: DataFrame) -> "FunctionStep":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            out = out.withColumn(c, self.func(F.col(c)))
        return out

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if self.inverse is None:
            raise ValueError("inverse function not provided")
        out = df
        for c in self.columns:
            out = out.withColumn(c, self.inverse(F.col(c)))
        return out


def _expm1(c: Column) -> Column:
    return F.expm1(c)


def _square(c: Column) -> Column:
    return c * c


def log_step(columns: Sequence[str]) -> FunctionStep:
    return FunctionStep(columns, log1p_safe, _expm1)


def sqrt_step(columns: Sequence[str]) -> FunctionStep:
    return FunctionStep(columns, sqrt_safe, _square)


# ------------------------------------------------------------------ J5

@dataclass
class Preprocessor:
    """outliers -> impute -> transform -> scale; fit on train rows, apply anywhere.

    The outlier filter only runs while fitting (it removes training rows);
    ``transform`` keeps every row of the frame it is given.
    """

    columns: Sequence[str]
    scaling: str = "standard"
    impute_strategy: str = "mean"
    feature_transform: str | None = None
    outlier_removal: str | None = None
    outlier_threshold: float = 3.0
    row_id: str = "row_id"
    steps_: list = field(default_factory=list)
    outliers_: OutlierRemover | None = None

    def fit(self, train: DataFrame) -> "Preprocessor":
        cur = train
        if self.outlier_removal and self.outlier_removal != "none":
            self.outliers_ = OutlierRemover(self.columns, self.outlier_removal, self.outlier_threshold).fit(cur)
            cur = self.outliers_.transform(cur)
        steps = []
        if self.impute_strategy and self.impute_strategy != "none":
            knn = self.impute_strategy == "knn"
            steps.append(KnnImputer(self.columns, self.row_id) if knn else Imputer(self.columns, self.impute_strategy))
        ft = self.feature_transform
        if ft and ft != "none":
            if ft in ("boxcox", "box-cox", "yeo-johnson"):
                steps.append(PowerTransformer(self.columns, "box-cox" if ft.startswith("box") else "yeo-johnson"))
            elif ft == "log":
                steps.append(log_step(self.columns))
            elif ft == "sqrt":
                steps.append(sqrt_step(self.columns))
            else:
                raise ValueError(f"unknown feature transform {ft!r}")
        steps.append(Scaler(self.columns, self.scaling))
        for s in steps:
            s.fit(cur)
            cur = s.transform(cur)
        self.steps_ = steps
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps_:
            df = s.transform(df)
        return df

    def fit_transform(self, train: DataFrame) -> DataFrame:
        self.fit(train)
        base = self.outliers_.transform(train) if self.outliers_ else train
        return self.transform(base)
