"""Best-fit packing of token sequences, bulk-synchronous over size classes."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.llm.common import ranked, saved, table
from vitalis.llm.encode import encoder, tokenizer_path, with_end

CAPACITY = 2048
END_ID = 0
#: Ranks within a length are split over so many hash ranges (a power of two).
SPREAD = 256


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids with ``keep_ids``).

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, the
    last piece may be shorter.  A null or empty text is the end id alone.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    fields = [src.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32"))]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for first, rows, *got in enc.batches(b.column(1).to_pylist()):
                ids, to = with_end(*got, end_id)
                n = np.diff(to)
                cuts = -(-n // capacity)
                row = np.repeat(np.arange(rows), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                a = to[row] + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(a.tolist(), length.tolist(), strict=True)), np.int64, len(row))
                cols = [b.column(0).slice(first, rows).take(pa.array(row)), *(pa.array(x.astype(np.int64)) for x in (piece, start, length, crc))]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, to[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))


def best_fit(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where best-fit decreasing puts ``counts`` pieces of each length, as runs of ranks.

    One superstep per length, longest first.  The gaps of open sequences are kept as
    classes (gap, first sequence, sequences), sorted; the successor sweep takes the
    smallest gap that holds the length, then the next, while pieces are left, and the
    rest open new sequences.  A sequence with the smallest fitting gap gets pieces
    until its gap is too small, as its gap then stays the smallest that fits; pieces of
    a length get sequences in the order of their ranks.  So each sweep places all pieces
    of a length at once and yields what placing them one by one would.  Returns rows
    (length, rank, sequence, each, offset): piece r of the run that begins at ``rank``
    goes to ``sequence + (r - rank) // each`` at ``offset + (r - rank) % each * length``.
    There are as many lengths and gaps as ``capacity`` at most, however many pieces.
    """
    gaps: list[tuple[int, int, int]] = []
    used = 0
    out: list[tuple[int, int, int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        at = bisect_left(gaps, (length,))
        taken, changed = at, []
        while left:
            if taken < len(gaps):
                gap, seq, n = gaps[taken]
                taken += 1
            else:
                gap, seq, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = gap // length
            out.append((length, rank, seq, each, capacity - gap))
            k = min(left, n * each)
            full, rest = divmod(k, each)
            changed += [(gap - each * length, seq, full), (gap - rest * length, seq + full, int(rest > 0)), (gap, seq + full + (rest > 0), n - full - (rest > 0))]
            left -= k
            rank += k
        del gaps[at:taken]
        for g in changed:
            if g[0] and g[2]:
                insort(gaps, g)
    cols = np.array(sorted(out), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), cols, strict=True))


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``items`` (a saved table with a long ``length`` of 1 to ``capacity``) plus sequence_id and offset.

    Counts per length and the rank of each row in its length are distributed (a length
    that holds a third of the rows is ranked in parts); the sweeps run over the counts.
    The runs they yield are sent to the tasks; their number depends on the capacity.
    """
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # as many as the capacity at most
    if counts and not (1 <= min(counts) and max(counts) <= capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    runs = spark.sparkContext.broadcast(best_fit(counts, capacity))
    key = F.xxhash64(F.lit("pack"), *items.columns)
    keyed = items.withColumn("__key", key)
    got = ranked(keyed, [length], F.shiftrightunsigned("__key", 64 - SPREAD.bit_length() + 1), ["__key", *items.columns], "__rank").drop("__key")
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = runs.value
        place = t["length"] << 40 | t["rank"]
        for b in batches:
            n, rank = np.asarray(b.column(names.index(length))), np.asarray(b.column(len(names)))
            i = np.searchsorted(place, n << 40 | rank, "right") - 1
            r = rank - t["rank"][i]
            seq, off = t["sequence"][i] + r // t["each"][i], t["offset"][i] + r % t["each"][i] * n
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return got.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack(saved(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
