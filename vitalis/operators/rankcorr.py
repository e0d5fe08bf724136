"""Average ranks of many columns at once, for rank correlations.

Values of all columns go to one shuffle by (column, value), where they are counted and
ranked by distributed prefix sums, and the ranks go back to their rows in one more.  A
column's ranks differ from pair to pair only where the other column is missing, so a
value carries one rank among all rows and one among the rows that hold each column with
missing values: 1 + c numbers, not p of them per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis import ship_package
from vitalis.operators.gram import BLOCK_SCHEMA, CELLS, Gram, added, block_rows, products, value
from vitalis.operators.ordering import join_null_safe, prefix_sums
from vitalis.session import written


def _value_ranks(long: DataFrame, sides: int) -> DataFrame:
    """(_i, _v, _r): for each value of a column its average rank among all rows, and among those with each side column."""
    names = [f"_c{t}" for t in range(1 + sides)]
    sums = [F.count(F.lit(1)).cast("double").alias("_c0"), *[F.sum(F.col("_m")[t].cast("double")).alias(f"_c{1 + t}") for t in range(sides)]]
    counts = long.groupBy("_i", "_v").agg(*sums)
    pref = prefix_sums(counts, [F.col("_i").asc(), F.col("_v").asc()], names)
    start = pref.groupBy("_i").agg(*[F.min(f"{c}_before").alias(f"_s{c}") for c in names])
    j = join_null_safe(pref, start, ["_i"])
    rank = [F.col(f"{c}_before") - F.col(f"_s{c}") + (F.col(c) + 1) / 2 for c in names]
    return j.select("_i", "_v", F.array(*rank).alias("_r"))


def rank_gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    """Sums of the average ranks of every pair of columns, each pair ranked among the rows that hold both.

    NULL and NaN are missing.  Two exchanges whatever the number of columns; the result
    has p x p numbers.
    """
    ship_package(df.sparkSession)
    p = len(columns)
    names = [f"_{k}" for k in range(p)]
    base = written(df.select(F.monotonically_increasing_id().alias("_row"), *[value(c).alias(n) for c, n in zip(columns, names, strict=True)]), "rank-base")
    total, *gaps = base.agg(F.count(F.lit(1)), *[F.count_if(F.col(n).isNull()) for n in names]).first()
    side = [k for k in range(p) if gaps[k]]
    slot = np.zeros(p, np.int64)
    slot[side] = 1 + np.arange(len(side))
    masks = F.array(*[F.col(names[k]).isNotNull().cast("int") for k in side]).cast("array<int>")
    long = base.select("_row", masks.alias("_m"), F.posexplode(F.array(*names)).alias("_i", "_v")).where("_v is not null")
    ranks = written(_value_ranks(long, len(side)), "ranks")
    back = long.select("_row", "_i", "_v").join(ranks, ["_i", "_v"])
    rows = back.groupBy("_row").agg(F.collect_list(F.struct("_i", "_r")).alias("_a")).select("_a")  # p entries at most
    middle, width = (total + 1) / 2, 1 + len(side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = None
        step = max(1, CELLS // (p * p))
        for b in batches:
            for at in range(0, b.num_rows, step):
                a = b.column(0).slice(at, step)
                flat = a.flatten()
                row = np.repeat(np.arange(len(a)), np.asarray(a.value_lengths()))
                x = np.full((len(a), p, width), np.nan)
                x[row, np.asarray(flat.field(0))] = np.asarray(flat.field(1).flatten()).reshape(-1, width) - middle
                new = _pair_sums(x, slot) if side else products(x[:, :, 0], x[:, :, 0])
                sums = new if sums is None else [s + t for s, t in zip(sums, new, strict=True)]
        if sums is not None:
            yield block_rows(sums, TaskContext.get().partitionId())

    got = added(rows.mapInArrow(run, BLOCK_SCHEMA))
    return got if got is not None else Gram(*(np.zeros((p, p)) for _ in range(6)))


def _pair_sums(ranks: np.ndarray, slot: np.ndarray) -> list[np.ndarray]:
    """The six sums over rows of ranks (row, column, slot): column i beside j takes the rank of j's slot."""
    x = ranks[:, :, slot]
    both = ~np.isnan(ranks[:, :, 0])
    both = both[:, :, None] & both[:, None, :]
    x = np.where(both, x, 0.0)
    y = x.transpose(0, 2, 1)
    return [both.sum(0).astype(float), x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)]
