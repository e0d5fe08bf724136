"""SimHash near-duplicates: pigeonhole blocks, joins on blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.llm.common import components, discard, drop_rows, saved, table, text_key

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: The fingerprint is cut into so many blocks; pairs within DISTANCE agree on BLOCKS - DISTANCE of them.
BLOCKS = 5
#: A block value shared by more fingerprints is split again on the bits it leaves free, while those are more than FREE.
BUCKET = 1024
FREE = 10


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles (unsigned); 0 if there is no word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([h64(b" ".join(words), seed)], np.uint64)
    else:
        parts = zip(*(words[i:] for i in range(shingle)), strict=False)
        h = np.fromiter((h64(b" ".join(p), seed) for p in parts), np.uint64, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        votes += np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, tkey, fp long) per row; bytes are lower-cased and split as ASCII only."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tkey"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "tkey", "fp"])

    return src.mapInArrow(run, T.StructType([src.schema["doc_id"], src.schema["tkey"], T.StructField("fp", T.LongType())]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], n: int) -> list[int]:
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits, int), n)]


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks such that two fingerprints within ``distance`` agree on at least one of them."""
    return [sum(c) for c in combinations(_cut(list(range(64)), blocks), blocks - distance)]


def finer(mask: int, distance: int = DISTANCE) -> list[int]:
    """Masks that hold ``mask`` and a further part of the free bits; close pairs within a block agree on one."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | p for p in _cut(free, distance + 1)]


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``distance``, one per fingerprint at most."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    odd = label != np.arange(len(fps))
    return fps[odd], fps[label[odd]]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            off = np.asarray(col.offsets, np.int64)
            val = np.asarray(col.values, np.int64).view(np.uint64)
            n = np.diff(off)
            two = off[:-1][n == 2]
            x, y = val[two], val[two + 1]
            ok = np.bitwise_count(x ^ y) <= distance
            got = [(x[ok], y[ok]), *(_forest(val[off[i] : off[i + 1]], distance) for i in np.flatnonzero(n > 2))]
            a, c = (np.concatenate([g[k] for g in got]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return run


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fps`` (fp) within ``distance``.

    Fingerprints meet where they share a block combination.  A block shared by more
    than ``bucket`` of them is not paired out: its members go on to finer masks, which
    still bring every close pair together, until the free bits alone bound its size.
    Per block only links that keep its close members connected are returned.
    """
    spark = fps.sparkSession
    masks = block_masks(blocks, distance)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    out = None
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        wide = F.bit_count("mask") < 64 - FREE  # else 2 ** FREE members at most
        big = saved(rows.where(wide).groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("mask", "key"), "blocks")
        some = big.limit(1).count() > 0
        rest = rows.join(big, ["mask", "key"], "left_anti") if some else rows
        groups = rest.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        found = saved(groups.mapInArrow(_links(distance), "a long, b long"), "links")
        out = found if out is None else out.union(found)
        if not some:
            return out
        steps = [(_signed(m), _signed(s)) for m in masks for s in finer(m, distance)]
        masks = [s for m in masks for s in finer(m, distance)]
        step = F.broadcast(spark.createDataFrame(steps, "mask long, sub long"))  # 4 rows a mask
        rows = saved(rows.join(big, ["mask", "key"], "left_semi").join(step, "mask").select("fp", F.col("sub").alias("mask")), "finer")
        discard(big)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, tkey (its text's key), fp, component_id, root (the component's smallest fp).

    component_id is the smallest id that links of at most ``distance`` bits lead to.
    A null or empty text has fingerprint 0 and links like any other; repeated rows
    stay; a null id is passed over in the minimum (a component of null ids only has
    component_id null).  Other columns of ``docs`` are not read.
    """
    fp = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = saved(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    comp = components(links(groups.select("fp"), distance, blocks))
    g = groups.join(comp, groups["fp"] == comp["node"], "left").select(groups["fp"], "low", F.coalesce("root", groups["fp"]).alias("root"))
    lows = saved(g.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    label = saved(g.join(lows, "root").select("fp", "component_id", "root"), "labels")
    return fp.join(label, "fp").select("doc_id", "tkey", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the smallest (doc_id, text key), nulls last."""
    r = saved(near_duplicates(docs, shingle=shingle, distance=distance), "near")
    rows = saved(r.groupBy("root", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("first")
    best = saved(rows.groupBy("root").agg(first).select("first.doc_id", "first.tkey"), "kept")
    cond = rows["doc_id"].eqNullSafe(best["doc_id"]) & (rows["tkey"] == best["tkey"])
    out = drop_rows(docs, saved(rows.join(best, cond, "left_anti").select("doc_id", "tkey"), "dropped"))
    twice = saved(rows.where("n > 1").join(best, cond, "left_semi").select("doc_id", "tkey"), "repeated")
    if twice.limit(1).count() == 0:
        return out
    again = docs.withColumn("__t", text_key()).join(twice, F.col("__t").eqNullSafe(twice["tkey"]) & docs["doc_id"].eqNullSafe(twice["doc_id"]), "left_semi")
    return drop_rows(out, twice).unionByName(again.dropDuplicates(["doc_id", "__t"]).drop("__t"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    r = near_duplicates(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
