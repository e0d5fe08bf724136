"""Masked Gram matrices: sums, squares and products of column pairs over the rows that hold both.

Each task turns its Arrow batches into numpy matrices and adds up block products of
values, squares and presence masks; only those p x m blocks are shuffled, one row per
column, and added up in two steps, so no row of the data is exploded into pairs and no
task meets more than the blocks of a share of the tasks.  Columns are shifted by one of
their own values near the middle first: a constant column gives exact zeros, and large
offsets don't cancel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalis import ship_package
from vitalis.functions.columns import nan_to_null

#: Blocks of so many tasks are added up first, and the values an Arrow batch brings into a product at once.
SHARES = 64
CELLS = 1 << 22
#: A variance below this share of the squares around the shift is rounding, not spread.
NOTHING = 1e-13

_PARTS = ("n", "sx", "sy", "qx", "qy", "xy")


@dataclass
class Gram:
    """Sums over the rows with both columns: ``n`` rows, ``sx`` and ``sy`` of values, ``qx`` and ``qy`` of squares, ``xy`` of products (shifted)."""

    n: np.ndarray
    sx: np.ndarray
    sy: np.ndarray
    qx: np.ndarray
    qy: np.ndarray
    xy: np.ndarray

    def covariance(self) -> np.ndarray:
        """Population covariance of each pair; NaN without a row."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.xy / self.n - self.sx / self.n * (self.sy / self.n)

    def _variance(self, s: np.ndarray, q: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            v = q / self.n - (s / self.n) ** 2
        return np.where(v > NOTHING * q / np.maximum(self.n, 1), v, np.where(self.n > 0, 0.0, np.nan))

    def correlation(self) -> np.ndarray:
        """Pairwise-complete Pearson correlation; NaN where a side has no spread or the pair no row."""
        var = self._variance(self.sx, self.qx) * self._variance(self.sy, self.qy)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = self.covariance() / np.sqrt(var)
        return np.where(var > 0, np.clip(r, -1, 1), np.nan)


def value(c: str | Column) -> Column:
    """A column as double with NaN as NULL."""
    return nan_to_null((F.col(c) if isinstance(c, str) else c).cast("double"))


def _matrix(b: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """Columns of a batch as a matrix, missing as NaN."""
    return np.column_stack([b.column(first + k).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for k in range(n)])


def products(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The six sums of every pair of a column of ``x`` and one of ``y``, NaN as missing."""
    mx, my = (~np.isnan(v) for v in (x, y))
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(np.float64), my.astype(np.float64)
    return [mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y]


def block_rows(total: list[np.ndarray], task: int) -> pa.RecordBatch:
    """One row per column: its place, the share its task belongs to and its row of every block."""
    p = len(total[0])
    cols = [pa.array(np.arange(p, dtype=np.int32)), pa.array(np.full(p, task % SHARES, np.int32))]
    cols += [pa.array(list(t), pa.list_(pa.float64())) for t in total]
    return pa.RecordBatch.from_arrays(cols, ["i", "share", *_PARTS])


BLOCK_SCHEMA = "i int, share int, " + ", ".join(f"{k} array<double>" for k in _PARTS)


def added(blocks: DataFrame) -> Gram | None:
    """The sum of all blocks: per (column, share), then per column, then p rows of m numbers each; None without a block."""

    def add(t: pa.Table) -> pa.Table:
        rows = [np.stack([np.asarray(v.values) for v in t[k].combine_chunks()]).sum(0) for k in _PARTS]
        cols = [t["i"].slice(0, 1), t["share"].slice(0, 1), *[pa.array([r], pa.list_(pa.float64())) for r in rows]]
        return pa.table(cols, names=["i", "share", *_PARTS])

    part = blocks.groupBy("i", "share").applyInArrow(add, BLOCK_SCHEMA)
    rows = sorted(part.groupBy("i").applyInArrow(add, BLOCK_SCHEMA).collect(), key=lambda r: r["i"])
    return Gram(*(np.array([r[k] for r in rows]) for k in _PARTS)) if rows else None


def gram(df: DataFrame, columns: Sequence[str | Column], against: Sequence[str | Column] | None = None) -> Gram:
    """Sums of every pair of one of ``columns`` and one of ``against`` (the columns themselves by default).

    NULL and NaN are missing; a pair takes the rows that hold both.  The result has
    len(columns) x len(against) numbers, like a fitted model; one pass finds the shifts,
    one the products, whatever the number of columns.
    """
    own = against is None
    names = [*columns, *(against or ())]
    cols = [value(c) for c in names]
    ship_package(df.sparkSession)
    p, m = len(columns), len(columns if own else against)
    base = df.select(*[c.alias(f"_{k}") for k, c in enumerate(cols)])
    middle = base.agg(*[F.percentile_approx(f"_{k}", 0.5, 100).alias(f"_{k}") for k in range(len(names))]).first()
    shift = np.array([0.0 if v is None or not np.isfinite(v) else v for v in middle])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        step = max(1, CELLS // max(1, len(names)))
        for b in batches:
            for at in range(0, b.num_rows, step):
                x = _matrix(b.slice(at, step), 0, len(names)) - shift
                new = products(x[:, :p], x[:, :p] if own else x[:, p:])
                total = new if total is None else [s + t for s, t in zip(total, new, strict=True)]
        if total is not None:
            yield block_rows(total, TaskContext.get().partitionId())

    got = added(base.mapInArrow(run, BLOCK_SCHEMA))
    return got if got is not None else Gram(*(np.zeros((p, m)) for _ in _PARTS))
