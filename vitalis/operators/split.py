"""Reproducible splits and folds as columns (no driver-side index lists; random splits need no shuffle, ranks do).

Every row gets a replayable uniform number ``u = md5_unit(seed, row_id)``.
Random splits compare ``u`` with the fraction; exact-size splits and folds use
the row's rank in ``(stratum, u, row_id)`` order, computed with the
distributed prefix sum (a big stratum is spread over many range partitions,
never sorted inside one task).  Train is always the complement of test in
the same column, never a second anti-join pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import md5_unit
from vitalis.operators.ordering import join_null_safe, prefix_sums, rank_in_group


def split_random(df: DataFrame, row_id: str, test_fraction: float = 0.2, seed: int = 42,
                 out: str = "split") -> DataFrame:
    u = md5_unit(seed, row_id)
    return df.withColumn(out, F.when(u < test_fraction, F.lit("test")).otherwise(F.lit("train")))


def _rank_within(df: DataFrame, strata: Sequence[str], row_id: str, seed: int) -> DataFrame:
    """0-based rank of each row inside its stratum in (u, row_id) order, plus stratum size ``_n`` if there are strata.

    NULL is a stratum like any other.
    """
    strata = list(strata)
    base = df.withColumn("_u", md5_unit(seed, row_id)).withColumn("_one", F.lit(1.0))
    order = [*[F.col(s).asc() for s in strata], F.col("_u").asc(), F.col(row_id).asc()]
    pref = prefix_sums(base, order, ["_one"])
    if strata:
        g = pref.groupBy(*strata).agg(F.min("_one_before").alias("_start"), F.count(F.lit(1)).alias("_n"))
        pref = join_null_safe(pref, g, strata)
    else:
        pref = pref.withColumn("_start", F.lit(0.0))
    return pref.withColumn("_rank", (F.col("_one_before") - F.col("_start")).cast("bigint")).drop(
        "_one", "_one_before", "_start", "_u")


def split_stratified(df: DataFrame, row_id: str, label: str, test_fraction: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Exactly ceil(f * n_c) test rows per class c, chosen in hash order."""
    r = _rank_within(df, [label], row_id, seed)
    is_test = F.col("_rank") < F.ceil(F.col("_n") * F.lit(test_fraction))
    return r.withColumn(out, F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop("_rank", "_n")


def kfold(df: DataFrame, row_id: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Shuffled k-fold: rank in hash order modulo k (fold sizes differ by at most one)."""
    r = _rank_within(df, [], row_id, seed)
    return r.withColumn(out, (F.col("_rank") % k).cast("int")).drop("_rank")


def stratified_kfold(df: DataFrame, row_id: str, label: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    r = _rank_within(df, [label], row_id, seed)
    return r.withColumn(out, (F.col("_rank") % k).cast("int")).drop("_rank", "_n")


def timeseries_split(df: DataFrame, order: Sequence[str], k: int = 5, out_fold: str = "fold",
                     out_role: str = "role") -> DataFrame:
    """Expanding-window folds: test size n // (k + 1); fold i tests the i-th of the last k blocks.

    Returns one row per (row, fold) the row takes part in, with role 'train' or 'test'; k rows or fewer raise.
    """
    n = df.count()
    if n <= k:
        raise ValueError(f"{k} folds need more than {k} rows, there are {n}")
    base = df.withColumn("_one", F.lit(1.0))
    pref = prefix_sums(base, [F.col(c).asc() for c in order], ["_one"])
    ts = n // (k + 1)
    first_test = n - k * ts
    rank = F.col("_one_before")
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    e = pref.select(*df.columns, rank.alias("_r"), F.explode(folds).alias(out_fold))
    start = F.lit(first_test) + F.col(out_fold) * F.lit(ts)
    role = F.when(F.col("_r") < start, F.lit("train")).when(F.col("_r") < start + ts, F.lit("test"))
    return e.withColumn(out_role, role).where(F.col(out_role).isNotNull()).drop("_r")


def fold_runs(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy balancing as runs: groups of ``size`` from rank ``start`` to ``end`` take ``folds`` in turn.

    ``sizes`` is (size, number of groups), largest size first; each group goes to the
    lightest fold, the first of equal ones.  Groups of one size fill the lightest folds
    in turn until these reach the next fold's load, so a size gives ``k`` runs at most.
    """
    loads, out = [0] * k, []
    for size, count in sizes:
        rank = 0
        while rank < count:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            active = [f for f in order if loads[f] < loads[order[0]] + size]
            rest = order[len(active):]
            turns = (loads[rest[0]] - loads[order[0]]) // size if rest else -(-(count - rank) // len(active))
            take = min(count - rank, turns * len(active))
            out.append((size, rank, rank + take, active))
            for i, f in enumerate(active):
                loads[f] += size * (take // len(active) + (i < take % len(active)))
            rank += take
    return out


def group_kfold(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Groups by size (desc, then by id) onto the currently lightest fold; no group spans two folds.

    The greedy pass runs on the number of groups of each size (fewer sizes than the
    square root of twice the rows); groups are ranked within their size on the cluster.
    NULL is a group like any other.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = [(r["_n"], r["_c"]) for r in counts.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).collect()]
    n_groups = sum(c for _, c in sizes)
    if n_groups < k:
        raise ValueError(f"cannot have {k} folds with {n_groups} groups")
    runs = fold_runs(sorted(sizes, reverse=True), k)
    plan = df.sparkSession.createDataFrame(runs, "_size bigint, _from bigint, _to bigint, _folds array<int>")
    ranked = rank_in_group(counts, ["_n"], [F.col(group).asc()], "_rank")
    hit = (F.col("_n") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    turn = ((F.col("_rank") - F.col("_from")) % F.size("_folds")).cast("int")
    folds = ranked.join(plan, hit).select(group, F.get("_folds", turn).alias(out))
    return join_null_safe(df, folds, [group], "left")


def fold_sizes(n: int, k: int) -> list[int]:
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


__all__ = ["split_random", "split_stratified", "kfold", "stratified_kfold", "timeseries_split", "group_kfold",
           "fold_sizes"]
