"""Token-id files: blocks of ids transposed into bit or byte planes, each plane compressed with zstandard.

A file set is a folder with two tables that Spark's writers commit as a whole:

* ``chunks``: one row per chunk of whole documents: ``shard``, ``chunk`` (its number in the
  shard), ``doc_ids``, ``sizes`` (ids of each document), ``n_ids``, ``unit`` (``byte`` or ``bit``),
  ``block`` (ids of a block), ``sizes_of_planes`` and ``planes`` (the compressed planes in a row,
  lowest first).  The ids are padded with zeros to whole blocks; within a block plane p holds byte
  (or bit) p of each id in turn.
* ``index``: ``shard``, ``chunk``, ``n_docs``, ``n_ids``, ``start`` (ids in all chunks before it).

Shards are ranges of doc_id, and chunks and their documents stand in ascending doc_id order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.llm.common import new_folder, table, text_key
from vitalis.llm.encode import encoder, tokenizer_path, with_end

END_ID = 2
#: Ids of a block, and ids from which on a chunk is closed.
BLOCK = 4096
CHUNK = 1 << 18
LEVEL = 3


def to_planes(ids: np.ndarray, unit: str = "byte", block: int = BLOCK, level: int = LEVEL) -> list[bytes]:
    """The compressed planes of ``ids`` (uint32); as many as the largest id needs, none for no id."""
    if not len(ids):
        return []
    x = np.zeros(-(-len(ids) // block) * block, "<u4")
    x[: len(ids)] = ids
    squeeze = zstandard.ZstdCompressor(level=level).compress
    width = max(int(ids.max()).bit_length(), 1)
    if unit == "byte":
        rows = x.view(np.uint8).reshape(-1, block, 4).transpose(2, 0, 1)[: -(-width // 8)]
    else:
        rows = [np.packbits((x >> np.uint32(p)).astype(np.uint8) & 1, bitorder="little") for p in range(width)]
    return [squeeze(np.ascontiguousarray(r).tobytes()) for r in rows]


def from_planes(planes: list[bytes], n: int, unit: str, block: int) -> np.ndarray:
    """The first ``n`` ids of compressed planes."""
    x = np.zeros(-(-n // block) * block, "<u4")
    for p, raw in enumerate(planes):
        got = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        if unit == "byte":
            x |= got.astype("<u4") << np.uint32(8 * p)
        else:
            x |= np.unpackbits(got, bitorder="little").astype("<u4") << np.uint32(p)
    return x[:n]


_CHUNK = "shard int, chunk long, doc_ids array<{0}>, sizes array<long>, n_ids long, unit string, block int, sizes_of_planes array<long>, planes binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, unit: str = "byte", block: int = BLOCK, chunk: int = CHUNK) -> None:
    """Writes the ids of every text of ``docs`` (doc_id, text), each followed by ``end_id``, in ascending doc_id order.

    A null or empty text is the end id alone.  Null doc_ids come first; rows of one
    doc_id stand in the order of their texts' keys, repeated rows each for itself.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_key().alias("tkey"))
    src = src.repartitionByRange("doc_id", "tkey").sortWithinPartitions("doc_id", "tkey").select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    id_type = pa.int64() if kind == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        docs_, sizes, ids, shard, number = [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal number
            flat = np.concatenate([np.zeros(0, np.uint32), *ids])
            planes = to_planes(flat, unit, block)
            lists = pa.ListArray.from_arrays(pa.array([0, sum(map(len, docs_))], pa.int32()), pa.concat_arrays(docs_))
            n = np.concatenate(sizes)
            row = [pa.array([shard], pa.int32()), pa.array([number]), lists, pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([len(flat)]), pa.array([unit]), pa.array([block], pa.int32()), pa.array([[len(p) for p in planes]], pa.list_(pa.int64())), pa.array([b"".join(planes)], pa.binary())]
            number += 1
            docs_.clear(), sizes.clear(), ids.clear()
            return pa.RecordBatch.from_arrays(row, ["shard", "chunk", "doc_ids", "sizes", "n_ids", "unit", "block", "sizes_of_planes", "planes"])

        for b in batches:
            if b.num_rows:
                shard = b.column(0)[0].as_py()
            for first, rows, *got in enc.batches(b.column(2).to_pylist()):
                flat, to = with_end(*got, end_id)
                docs_.append(b.column(1).slice(first, rows) if id_type is None else b.column(1).slice(first, rows).cast(id_type))
                sizes.append(np.diff(to))
                ids.append(flat)
                if sum(map(len, ids)) >= chunk:
                    yield closed()
        if docs_:
            yield closed()

    src.mapInArrow(run, _CHUNK.format(kind)).write.parquet(f"{path}/chunks")
    c = spark.read.schema(T._parse_datatype_string(_CHUNK.format(kind))).parquet(f"{path}/chunks").select("shard", "chunk", F.size("sizes").cast("long").alias("n_docs"), "n_ids")
    shards = c.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    c.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard").select("shard", "chunk", "n_docs", "n_ids", (F.col("base") + F.col("own")).alias("start")).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """The documents of a file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids).

    ``ids_crc32`` is the unsigned crc32 of a document's ids as little-endian unsigned 32-bit integers.
    """
    chunks = spark.read.parquet(f"{path}/chunks")
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["shard", "chunk", "doc_id", "own", "n_tokens", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}
                n = np.array(c["sizes"].as_py(), np.int64)
                cut = np.concatenate([np.zeros(1, np.int64), np.cumsum(c["sizes_of_planes"].as_py(), dtype=np.int64)])
                raw = c["planes"].as_py()
                ids = from_planes([raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], c["n_ids"].as_py(), c["unit"].as_py(), c["block"].as_py())
                to = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
                cols = [pa.array(np.full(len(n), c["shard"].as_py(), np.int32)), pa.array(np.full(len(n), c["chunk"].as_py(), np.int64)), c["doc_ids"].values, pa.array(to[:-1]), pa.array(n), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    docs = chunks.mapInArrow(run, f"shard int, chunk long, doc_id {kind}, own long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)
    index = spark.read.parquet(f"{path}/index").select("shard", "chunk", "start")
    out = docs.join(index, ["shard", "chunk"])
    return out.select("doc_id", (F.col("start") + F.col("own")).alias("start"), *names[4:])


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents in the shared folder and reads them back."""
    path = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
