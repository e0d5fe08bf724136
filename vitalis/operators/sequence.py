"""Sequence preparation over windowed trials: assemble, normalise, pad, augment, pool.

Input is a long window table ``(trial keys..., idx, vec array<double>)``.  A
trial's sequence is assembled only after truncation to ``max_len`` windows,
so the collected array per trial is bounded; per-dimension statistics use the
long layout (one row per (trial, idx, dim)) and grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalis.functions.columns import md5_unit
from vitalis.operators.ordering import global_row_number, join_null_safe
from vitalis.session import written


def build_sequences(windows: DataFrame, keys: Sequence[str], idx: str, vec: str, label: str | None = None,
                    max_len: int | None = None, out: str = "seq", drop_empty: bool = False) -> DataFrame:
    """keys + (seq array<array<double>> ordered by idx, seq_len, label with missing -> 0).

    ``max_len`` keeps the first windows of a trial by idx, whatever their index begins
    with; empty vectors are windows like any other (the Spark plan keeps the first rows
    of each trial before the shuffle).  ``drop_empty`` leaves them out of what was kept.
    """
    w = windows
    if max_len is not None:
        first = Window.partitionBy(*keys).orderBy(idx)
        w = w.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= max_len).drop("_rn")
    if drop_empty:
        w = w.where(F.size(vec) > 0)
    aggs = [F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(vec).alias("v")))).alias("_s")]
    if label:
        aggs.append(F.first(label, ignorenulls=True).alias("_label"))
    g = w.groupBy(*keys).agg(*aggs)
    g = g.withColumn(out, F.transform("_s", lambda s: s["v"])).withColumn("seq_len", F.size(out))
    cols = [*keys, out, "seq_len"]
    if label:
        g = g.withColumn("label", F.coalesce(F.col("_label").cast("double"), F.lit(0.0)))
        cols.append("label")
    return g.select(*cols)


def to_long(windows: DataFrame, keys: Sequence[str], idx: str, vec: str) -> DataFrame:
    """(keys, idx, dim, value): one row per vector element."""
    return windows.select(*keys, idx, F.posexplode(vec).alias("dim", "value"))


def sequence_minmax(windows: DataFrame, keys: Sequence[str], idx: str, vec: str, eps: float = 1e-8) -> DataFrame:
    """Per (trial, dimension) min-max scaling; a range <= eps uses divisor 1."""
    long = to_long(windows, keys, idx, vec)
    st = long.groupBy(*keys, "dim").agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    j = join_null_safe(long, st, [*keys, "dim"])
    rng = F.col("_mx") - F.col("_mn")
    return j.select(*keys, idx, "dim",
                    ((F.col("value") - F.col("_mn")) / F.when(rng <= eps, F.lit(1.0)).otherwise(rng)).alias("value"))


def pad_sequences(seqs: DataFrame, seq: str = "seq", seq_len: str = "seq_len", dim: int | None = None,
                  max_len: int | None = None, out: str = "padded") -> DataFrame:
    """Pad every sequence with zero vectors to the longest length; rows ordered by length desc.

    An empty sequence becomes zero vectors of the largest dimension found (none at all: empty vectors).
    """
    if max_len is None or dim is None:
        longest, widest = seqs.agg(F.max(seq_len), F.max(F.size(F.get(F.col(seq), 0)))).first()
        max_len = (longest or 0) if max_len is None else max_len
        dim = max(widest or 0, 0) if dim is None else dim
    return _padded(seqs, seq, seq_len, F.lit(max_len), dim, out).orderBy(F.col(seq_len).desc())


def _padded(seqs: DataFrame, seq: str, seq_len: str, to: Column, dim: int, out: str) -> DataFrame:
    own = F.size(F.get(F.col(seq), 0))
    zero = F.array_repeat(F.lit(0.0), F.when(own > 0, own).otherwise(F.lit(dim)))
    return seqs.withColumn(out, F.concat(F.col(seq), F.array_repeat(zero, F.greatest(to - F.col(seq_len), F.lit(0)))))


def pad_batches(seqs: DataFrame, keys: Sequence[str], batch_size: int, seq: str = "seq", seq_len: str = "seq_len",
                out: str = "padded") -> DataFrame:
    """Batches of sequences of like length, each padded to its own longest: adds ``batch`` and ``out``.

    Sequences stand by length (longest first, then keys) in a global order that no task
    holds alone; ``batch`` is the place in it divided by ``batch_size``.  Keys are unique.
    """
    order = global_row_number(seqs.select(*keys, seq_len), [F.col(seq_len).desc(), *[F.col(k).asc() for k in keys]], "_rn")
    order = written(order.select(*keys, seq_len, F.floor((F.col("_rn") - 1) / batch_size).cast("long").alias("batch")), "batches")
    longest = order.groupBy("batch").agg(F.max(seq_len).alias("_to"))
    dim = max(seqs.agg(F.max(F.size(F.get(F.col(seq), 0)))).first()[0] or 0, 0)
    j = join_null_safe(seqs, order.drop(seq_len).join(longest, "batch"), list(keys))
    return _padded(j, seq, seq_len, F.col("_to"), dim, out).drop("_to")


def gaussian_noise(seed: int, *keys: Column | str) -> Column:
    """Replayable N(0, 1) draw from two md5 buckets (Box-Muller)."""
    u1 = 1.0 - md5_unit(seed, *keys, F.lit("a"))
    u2 = md5_unit(seed, *keys, F.lit("b"))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * 3.141592653589793 * u2)


def augment_noise(long: DataFrame, keys: Sequence[str], idx: str = "idx", dim: str = "dim", value: str = "value",
                  factor: float = 0.1, seed: int = 42) -> DataFrame:
    """value + factor * N(0,1), the noise keyed by (trial, idx, dim) so reruns draw the same values."""
    noise = gaussian_noise(seed, *[F.col(k) for k in keys], F.col(idx), F.col(dim))
    return long.withColumn(value, F.col(value) + F.lit(factor) * noise)


def masked_mean_pool(seqs: DataFrame, padded: str = "padded", seq_len: str = "seq_len", dim: int = 2,
                     out: str = "pooled") -> DataFrame:
    """Mean over the valid (unpadded) positions for every dimension: a row-local array expression (NULL without one)."""
    valid = F.slice(F.col(padded), 1, F.col(seq_len))
    pooled = F.array(*[F.try_divide(F.aggregate(valid, F.lit(0.0), _add_dim(d)), F.col(seq_len)) for d in range(dim)])
    return seqs.withColumn(out, F.when(F.col(seq_len) > 0, pooled))


def _add_dim(d: int):
    def merge(acc, v):
        return acc + F.get(v, d)
    return merge
