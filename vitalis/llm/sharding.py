"""Shards by proportional stratified interleaving of seeded-shuffled sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.llm.common import ranked, saved, table

SHARDS = 8
SEED = 20240601
#: Ranks are taken over so many ranges of the shuffle's and the order's keys (a power of two).
SPREAD = 1024


def shards(docs: DataFrame, n: int = SHARDS, source: str = "source", seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place of every row: doc_id, source, size, text_crc32, shard, slot.

    Rows of a source are ranked in a seeded shuffle; row ``r`` of ``m`` gets the
    fractional rank ``(r + u) / m`` with ``u`` in [0, 1) seeded by the source; all rows
    are sorted by it and cut into ``n`` runs whose sizes differ by one at most, so every
    shard holds each source in its share, within a row or two.  ``u`` spreads sources of few rows.
    Law ``rows``.  A null source is a source of its own; a null text has size 1 and the
    crc32 of no bytes; repeated rows are places of their own.  Only narrow columns move.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    base = saved(narrow.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")), "rows")
    bits = 64 - SPREAD.bit_length() + 1
    order = ["key", "doc_id", "text_crc32", "size"]
    in_source = ranked(base, ["source"], F.shiftrightunsigned("key", bits), order, "rank")
    sizes = base.groupBy("source").agg(F.count(F.lit(1)).alias("m"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull()), 11) / F.lit(float(1 << 53))
    placed = in_source.join(sizes.withColumnRenamed("source", "__source").withColumnRenamed("m", "__m"), F.col("source").eqNullSafe(F.col("__source")))
    placed = placed.withColumn("at", (F.col("rank") + u) / F.col("__m")).drop("__source", "__m", "rank")
    placed = saved(placed, "placed")
    got = ranked(placed, [], F.floor(F.col("at") * SPREAD), ["at", "source", *order], "place")
    total = placed.count()
    shard = F.expr(f"int((place * {n}) div {max(total, 1)})")
    first = F.expr(f"(shard * {total}L + {n - 1}) div {n}")
    return got.withColumn("shard", shard).withColumn("slot", F.col("place") - first).select("doc_id", "source", "size", "text_crc32", "shard", "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    r = shards(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
