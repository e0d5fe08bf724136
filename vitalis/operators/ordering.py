"""Global order helpers: exclusive prefix sums and row numbers without a one-task window.

An unpartitioned ``Window.orderBy`` moves every row into one task.  Instead the
(pre-aggregated) frame is range-partitioned on the order key, each partition
computes its local running sums in order (``mapInPandas`` over an iterator, so
a partition never has to fit in memory at once), per-partition totals are
turned into offsets (one row per partition, so broadcasting them has a proven
bound), and the offsets are added back.

Keys must be unique (pre-aggregate ties first): then no tie straddles two
partitions, and hot keys were already collapsed to one row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vitalis import ship_package
from vitalis.session import written


def _partitions(df: DataFrame, n: int | None) -> int:
    """Range partitions: ``n``, else the session's shuffle partitions (set for the data, not for the cores of the moment)."""
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL; the left keys and all other columns of both sides."""
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(r, cond, how).drop(*[f"_k_{k}" for k in keys])


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column],
    sum_cols: Sequence[str],
    suffix: str = "_before",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over all rows strictly before each row.

    ``order`` is a list of sort Columns (e.g. ``[F.col('score').desc()]``) whose
    values are unique per row.  Sums are float64 (exact for counts below 2^53).
    """
    n = _partitions(df, num_partitions)
    spark = df.sparkSession
    ship_package(spark)
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = parts.withColumn("_pid", F.spark_partition_id())
    loc_names = [f"_loc_{c}" for c in sum_cols]
    out_schema = StructType(
        parts.schema.fields + [StructField(x, DoubleType(), False) for x in loc_names]
    )
    cols = list(sum_cols)

    def local(batches):
        carry = {c: 0.0 for c in cols}
        pid = None
        for pdf in batches:
            if pdf.empty:
                continue
            if pid is None:
                pid = pdf["_pid"].iloc[0]
            for c, lname in zip(cols, loc_names):
                v = pdf[c].astype("float64").fillna(0.0).to_numpy()
                cs = np.cumsum(v)
                pdf[lname] = carry[c] + cs - v
                carry[c] += float(cs[-1]) if len(cs) else 0.0
            yield pdf

    local_df = written(parts.mapInPandas(local, out_schema), "prefix")
    totals = local_df.groupBy("_pid").agg(*[F.sum(F.col(c).cast("double")).alias(f"_tot_{c}") for c in cols])
    # one row per partition (at most n numbers): running offsets on the driver, broadcast back
    tot = sorted(totals.collect(), key=lambda r: r["_pid"])
    run = {c: 0.0 for c in cols}
    rows = []
    for r in tot:
        rows.append((int(r["_pid"]), *[run[c] for c in cols]))
        for c in cols:
            run[c] += float(r[f"_tot_{c}"] or 0.0)
    off_schema = "_pid int, " + ", ".join(f"_off_{c} double" for c in cols)
    offsets = spark.createDataFrame(rows, off_schema)
    joined = local_df.join(F.broadcast(offsets), "_pid", "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_loc_{c}") + F.coalesce(F.col(f"_off_{c}"), F.lit(0.0))).alias(f"{c}{suffix}") for c in cols],
    )


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based row number in ``order`` (order values unique), computed without one task."""
    tmp = df.withColumn("_one", F.lit(1.0))
    out = prefix_sums(tmp, order, ["_one"], suffix="_before", num_partitions=num_partitions)
    return out.withColumn(name, (F.col("_one_before") + 1).cast("bigint")).drop("_one", "_one_before")


def average_rank(df: DataFrame, value_col: str, rank_col: str | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """Average (fractional) rank of ``value_col`` among non-null values, ties share the mean rank.

    Values are counted first (a hot value becomes one row), ranks are computed on
    the distinct values, and joined back on the value (AQE broadcasts the
    distinct table when its measured size is small, else sort-merge).
    """
    rank_col = rank_col or f"{value_col}_rank"
    counts = df.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.count(F.lit(1)).cast("double").alias("_cnt"))
    pref = prefix_sums(counts, [F.col(value_col).asc()], ["_cnt"], num_partitions=num_partitions)
    ranks = pref.select(value_col, (F.col("_cnt_before") + (F.col("_cnt") + 1) / 2).alias(rank_col))
    return df.join(ranks, value_col, "left")


__all__ = ["prefix_sums", "join_null_safe", "global_row_number", "average_rank", "rank_in_group"]


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank",
                  num_partitions: int | None = None) -> DataFrame:
    """0-based rank of each row inside its key group by ``order`` (keys + order unique).

    Same result as ``row_number() - 1`` over a window partitioned by the keys,
    but a hot group is spread over several range partitions instead of being
    sorted inside one task.
    """
    keys = list(keys)
    base = df.withColumn("_one", F.lit(1.0))
    pref = prefix_sums(base, [*[F.col(k).asc() for k in keys], *order], ["_one"], num_partitions=num_partitions)
    starts = pref.groupBy(*keys).agg(F.min("_one_before").alias("_start"))
    j = join_null_safe(pref, starts, keys)
    return j.withColumn(name, (F.col("_one_before") - F.col("_start")).cast("bigint")).drop(
        "_one", "_one_before", "_start")
