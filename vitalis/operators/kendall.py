"""Kendall tau-b in O(n log n) work, distributed (Knight's algorithm on Spark), for any number of column pairs at once.

Discordant pairs are the inversions of y when rows are ordered by (x, y).
Distinct (x, y) keys of a column pair get a position; two positions separate at
exactly one bit level l (same prefix pos >> (l + 1), left bit 0, right bit 1),
so the inversions are, summed over levels and prefixes, the number of
(left, right) pairs with y_left > y_right.  All levels are exploded at once
(keys x log2(keys) rows), collapsed by (pair, level, prefix, y), and the "left
weight with a larger y" comes from the distributed prefix sum - no pair of rows is
ever materialised and no group has to sit in one task.  Every step is keyed by
the column pair, so the number of jobs doesn't depend on the number of columns.

tau_b = (P - Q) / sqrt((n0 - n1) (n0 - n2)), P - Q = n0 - n1 - n2 + n3 - 2 Q,
with n1, n2, n3 the pairs tied in x, in y and in both.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.operators.gram import value
from vitalis.operators.ordering import prefix_sums
from vitalis.session import written


#: Rows, keys and cells that one task takes; more of them make more tasks, not larger ones.
ROWS, KEYS, CELLS = 250_000, 50_000, 500_000


def _tasks(df: DataFrame, rows: int, each: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // each))


def kendall_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[tuple[float | None, int]]:
    """(tau, n) of each column pair over the rows that hold both (NaN is missing); tau None where a side has no two values."""
    df = df.select(*[value(c).alias(c) for c in dict.fromkeys(c for p in pairs for c in p)])
    df = df.repartition(_tasks(df, df.count() * len(pairs), ROWS))  # bounds what a task adds up before the shuffle
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("q"), value(x).alias("x"), value(y).alias("y")) for k, (x, y) in enumerate(pairs)]))
    rows = df.select(both.alias("e")).select("e.*").where("x is not null and y is not null")
    keys = written(rows.groupBy("q", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "kendall")
    # ties per x, per y and per (x, y) of each pair in one pass; grouping_id bits: q, x, y
    sets = keys.groupingSets([["q", "x"], ["q", "y"], ["q", "x", "y"]], "q", "x", "y").agg(F.sum("w").alias("t"), F.grouping_id().alias("gid"))
    ties = {(r["q"], r["gid"]): r for r in sets.groupBy("q", "gid").agg(
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("pairs"), F.sum("t").alias("n"), F.count(F.lit(1)).alias("m")).collect()}  # three rows a pair
    most = max((r["m"] for (_, gid), r in ties.items() if gid == 0), default=0)
    total = sum(r["m"] for (_, gid), r in ties.items() if gid == 0)
    inversions: dict[int, float] = {}
    if most > 1:
        pos = prefix_sums(keys.withColumn("one", F.lit(1.0)), [F.col("q"), F.col("x"), F.col("y")], ["one"], num_partitions=_tasks(keys, total, KEYS))
        start = pos.groupBy("q").agg(F.min("one_before").alias("start"))
        pos = pos.join(start, "q").select("q", "y", "w", (F.col("one_before") - F.col("start")).cast("long").alias("pos"))
        levels = max(1, math.ceil(math.log2(most)))
        # a key stands in every level: what a task explodes and adds up is bounded by its keys
        pos = pos.withColumn("block", F.floor(F.col("pos") / KEYS)).repartition(_tasks(keys, total, KEYS), "q", "block")
        e = pos.select("q", "block", "y", "w", "pos", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("l"))
        e = e.select("q", "block", "l", F.expr("shiftright(pos, l + 1)").alias("g"), F.expr("shiftright(pos, l) & 1").alias("side"), "y", "w")
        cells = e.groupBy("q", "block", "l", "g", "y").agg(F.sum(F.when(F.col("side") == 0, F.col("w")).otherwise(0.0)).alias("lw"),
                                                           F.sum(F.when(F.col("side") == 1, F.col("w")).otherwise(0.0)).alias("rw"))
        cells = cells.repartition(_tasks(keys, total * levels, CELLS), "q", "l", "g", "y")
        cells = cells.groupBy("q", "l", "g", "y").agg(F.sum("lw").alias("lw"), F.sum("rw").alias("rw"))
        pref = prefix_sums(cells, [F.col("q"), F.col("l"), F.col("g"), F.col("y").desc()], ["lw"], num_partitions=_tasks(keys, total * levels, CELLS))
        per = pref.groupBy("q", "l", "g").agg(F.sum(F.col("rw") * F.col("lw_before")).alias("s"), F.sum("rw").alias("r"), F.min("lw_before").alias("start"))
        sums = per.groupBy("q").agg(F.sum(F.col("s") - F.col("start") * F.col("r")).alias("inv"))
        inversions = {r["q"]: r["inv"] for r in sums.collect()}  # one row a pair
    out = []
    for k in range(len(pairs)):
        (n3, n), (n2, _), (n1, _) = ((t["pairs"], t["n"]) if (t := ties.get((k, gid))) else (0.0, 0.0) for gid in (0, 2, 1))
        n0 = n * (n - 1) / 2
        den = (n0 - n1) * (n0 - n2)
        tau = (n0 - n1 - n2 + n3 - 2 * inversions.get(k, 0.0)) / math.sqrt(den) if den > 0 else None
        out.append((tau, int(n)))
    return out


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: (tau, n) over rows where both x and y are present."""
    return df.sparkSession.createDataFrame(kendall_pairs(df, [(x, y)]), "tau double, n long")


def kendall_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, tau) for every ordered pair; a column with itself is 1."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    tau = dict(zip(pairs, (t for t, _ in kendall_pairs(df, pairs)), strict=True)) if pairs else {}
    rows = [(a, b, 1.0 if a == b else tau.get((a, b), tau.get((b, a)))) for a in columns for b in columns]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, tau double")
