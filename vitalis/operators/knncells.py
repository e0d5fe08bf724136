"""Exact KNN imputation through locality-sensitive cells with multi-probe and certain radii.

Key features are cut into bins of about equal numbers of donors; a cell is a combination
of bins of two of them.  A receiver probes its own cell, the neighbouring ones and those
of donors that miss a key feature.  What it doesn't probe differs by more than the rest
of a neighbouring bin in a key feature, and the distance is no less than that difference:
a receiver whose k-th donor found lies within that radius has its k nearest for certain.
The others go on to wider bins, and at last to all donors.  Receivers that hold the same
values and miss the same ones have the same donors: they are looked up once.  Nothing is approximate; the
cells only decide how many pairs are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalis import ship_package
from vitalis.operators.clean import any_missing, block_candidates, filled, nearest, number_features, topk_frame
from vitalis.operators.ordering import join_null_safe
from vitalis.session import written

#: Donors that a cell should hold at first, the factor by which cells grow, and how often.
DONORS = 256
WIDER = 8
LEVELS = 3
#: Donors and receivers of a cell that meet in one task; a hot cell is dealt to several.
BLOCK = 20_000


class _Bins:
    """Bins of the features in a common order: the ones with most different edges first."""

    def __init__(self, donors: DataFrame, cols: Sequence[str], bins: int) -> None:
        at = [i / bins for i in range(1, bins)]
        row = donors.agg(*[F.percentile_approx(c, at, 20 * bins).alias(c) for c in cols]).first()  # bins numbers a feature
        edges = {c: np.array(sorted(set(row[c] or [])), float) for c in cols}
        self.order = sorted(cols, key=lambda c: (-len(edges[c]), c))
        self.edges = [edges[c] for c in self.order]

    def added(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        """(_rid, cols, _b, _reach): the bin of each ordered feature (-1: missing), and what neighbouring bins reach at least."""
        edges, places = self.edges, [1 + list(cols).index(c) for c in self.order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.column_stack([b.column(p).to_numpy(zero_copy_only=False).astype(float) for p in places])
                bins, reach = np.full(x.shape, -1, np.int32), np.full(x.shape, np.inf)
                for f, e in enumerate(edges):
                    v = x[:, f]
                    has = ~np.isnan(v)
                    at = np.searchsorted(e, v, side="right")
                    bins[has, f] = at[has]
                    lo, hi = has & (at >= 2), has & (at + 1 < len(e))
                    reach[lo, f] = v[lo] - e[at[lo] - 2]
                    reach[hi, f] = np.minimum(reach[hi, f], e[at[hi] + 1] - v[hi])
                cols_ = [b.column(k) for k in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols_, pa.array(list(bins), pa.list_(pa.int32())), pa.array(list(reach), pa.list_(pa.float64()))], [*b.schema.names, "_b", "_reach"])

        schema = "_rid long, " + ", ".join(f"`{c}` double" for c in cols) + ", _b array<int>, _reach array<double>"
        return df.select("_rid", *cols).mapInArrow(run, schema)


def _keys() -> Column:
    """Places of the first two features that a row has, in the common order (the last of one alone is repeated)."""
    have = F.filter(F.transform("_b", lambda b, i: F.when(b >= 0, i)), lambda i: i.isNotNull())
    two = F.slice(have, 1, 2)
    return F.concat(two, F.slice(two, 1, 2 - F.size(two)))


def _name(x: Column, y: Column, keys: Column) -> Column:
    return F.concat_ws("/", F.array_join(keys, ","), x.cast("string"), y.cast("string"))


def _probes(receivers: DataFrame, bins: _Bins, cols: Sequence[str]) -> DataFrame:
    """(_rid, cols, _radius, _keys, _cells): the cells a receiver looks at, and the radius within which they hold every donor."""
    r = bins.added(receivers, cols).withColumn("_keys", _keys())

    def near(k: int) -> Column:
        b = F.get("_b", F.get("_keys", k))
        return F.array_distinct(F.array(b - 1, b, b + 1, F.lit(-1)))

    keys = F.col("_keys")
    alone = F.get(keys, 0) == F.get(keys, 1)
    cross = F.flatten(F.transform(near(0), lambda x: F.transform(near(1), lambda y: _name(x, y, keys))))
    line = F.transform(near(0), lambda x: _name(x, x, keys))
    radius = F.least(F.get("_reach", F.get(keys, 0)), F.get("_reach", F.get(keys, 1)))
    return r.select("_rid", *cols, radius.alias("_radius"), "_keys", F.when(alone, line).otherwise(cross).alias("_cells"))


def _placed(donors: DataFrame, bins: _Bins, cols: Sequence[str], keysets: Sequence[Sequence[int]]) -> DataFrame:
    """(_rid, cols, _cell): every donor in its cell of each pair of key features in use."""
    names = [_name(F.get("_b", i), F.get("_b", j), F.array(F.lit(i), F.lit(j))) for i, j in keysets]
    return bins.added(donors, cols).select("_rid", *cols, F.explode(F.array(*names)).alias("_cell"))


def meetings(receivers: DataFrame, donors: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to tasks by (_cell, _rb, _db): a cell's receivers and donors in blocks, each meeting each."""
    cells = receivers.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nr"))
    held = donors.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nd"))
    sizes = written(cells.join(held, "_cell"), "cells")

    def dealt(df: DataFrame, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        j = df.join(sizes, "_cell").withColumn(own, F.pmod(F.xxhash64("_rid"), F.col(n_own)).cast("int"))
        return j.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("_nr", "_nd")

    return dealt(receivers, "_rb", "_db", "_nr", "_nd"), dealt(donors, "_db", "_rb", "_nd", "_nr")


def _certain(best: DataFrame, receivers: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Ids of the receivers whose k nearest found lie within their radius for every missing column."""
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    per = best.groupBy("_rid", "_col").agg(F.count(F.lit(1)).alias("n"), F.max("_dist").alias("far"))
    j = per.join(receivers.select("_rid", missing.alias("_missing"), "_radius"), "_rid")
    ok = (F.col("n") == k) & (F.col("far") < F.col("_radius") * (1 - 1e-12))
    return j.groupBy("_rid").agg(F.count_if(ok).alias("sure"), F.max("_missing").alias("need")).where("sure = need").select("_rid")


def _own_donors(receivers: DataFrame, donors: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ids of the receivers that a donor shares, which has a value they miss: it is none of theirs."""
    has = donors.select(F.col("_rid").alias("_did"), *[F.col(c).isNotNull().alias(f"_has{i}") for i, c in enumerate(cols)])
    lent = F.lit(False)
    for i, c in enumerate(cols):
        lent = lent | (F.col(c).isNull() & F.col(f"_has{i}"))
    return receivers.join(has, F.col("_rid") == F.col("_did")).where(lent).select("_rid").distinct()


def knn_impute_lsh(df: DataFrame, row_id: str, columns: Sequence[str], k: int = 5, donors: DataFrame | None = None,
                   cell: int = DONORS, wider: int = WIDER, levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """KNN imputation with the same result as ``clean.knn_impute``, looking at the donors of few cells.

    ``cell`` donors are wanted in a cell at first, ``wider`` times as many at each of
    ``levels`` levels; receivers without k certain donors then meet all donors.  Donors
    stand once in the cells of every pair of key features that receivers use.
    """
    cols = list(columns)
    ship_package(df.sparkSession)
    feats = number_features(df, row_id, cols)
    source = written(feats if donors is None else number_features(donors, row_id, cols), "donors")
    means = source.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    number = source.count()
    some = F.lit(False)
    for c in cols:
        some = some | F.col(c).isNotNull()
    # a row without any value has no distance to others: its columns get the means
    receivers = written(feats.where(any_missing(cols) & some), "receivers")
    alone = written(_own_donors(receivers, source, cols), "alone")
    rows = receivers.join(alone, "_rid", "left_anti")
    left = groups = written(rows.select(*cols).distinct().select(F.monotonically_increasing_id().alias("_rid"), *cols), "groups")
    best = None

    def pair(rpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        return topk_frame(rpdf, dpdf, cols, k, own=False)

    for level in range(levels):
        bins = int(np.sqrt(number / (cell * wider**level)))
        if bins < 6 or left.limit(1).count() == 0:  # most cells would be probed
            break
        b = _Bins(source, cols, bins)
        recv = written(_probes(left, b, cols), "probes")
        keysets = [tuple(r[0]) for r in recv.select("_keys").distinct().collect()]  # pairs of features
        r, d = meetings(recv.select("_rid", *cols, F.explode("_cells").alias("_cell")), _placed(source, b, cols, keysets), block)
        by = ["_cell", "_rb", "_db"]
        cands = r.groupBy(*by).cogroup(d.groupBy(*by)).applyInPandas(pair, "_rid long, _col int, _dist double, _did long, _val double")
        found = written(nearest(cands, k), "nearest")
        sure = written(_certain(found, recv, cols, k), "certain")
        done = found.join(sure, "_rid", "left_semi")
        best = done if best is None else best.unionByName(done)
        left = written(left.join(sure, "_rid", "left_anti"), "receivers")
    rest = nearest(block_candidates(left, source, cols, k, own=False), k)
    best = rest if best is None else best.unionByName(rest)
    members = join_null_safe(rows, groups.withColumnRenamed("_rid", "_group"), cols).select("_rid", "_group")
    every = members.join(best.withColumnRenamed("_rid", "_group"), "_group").drop("_group")
    every = every.unionByName(block_candidates(receivers.join(alone, "_rid", "left_semi"), source, cols, k))
    return filled(df, row_id, cols, nearest(every, k), means)
