"""Benchmark decontamination by winnowing: minimum k-gram hashes, a join of fingerprints, extended hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalis.llm.common import drop_rows, saved, table, text_key

#: Words of a window; every shared span of so many words shares a fingerprint as WINDOW = GRAM + SLIDE - 1.
WINDOW = 13
GRAM = 7
SLIDE = WINDOW - GRAM + 1
#: Words kept on either side of a fingerprint: enough for every window that holds it.
SIDE = WINDOW - GRAM
CTX = GRAM + 2 * SIDE
#: Bits of the filter that tasks get of the benchmark's fingerprints (2 MiB whatever the benchmark's size).
FILTER_BITS = 24
#: Bytes of text hashed at once.
STEP = 1 << 19

_MIX = np.random.default_rng(20240601).integers(1, 1 << 63, 257, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    size = 1 << max(n - 1, STEP).bit_length()
    if size not in _powers:
        _powers.clear()
        inv = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, inv))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], kind: np.ndarray, change: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one more at the end).

    Words are runs of bytes of one ``kind`` (by byte; 0 parts words); ``change`` maps bytes before they are hashed.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    low = raw if change is None else change[raw]
    k = np.concatenate([kind[:1] * 0, kind[low], kind[:1] * 0])
    edge = np.flatnonzero(k[1:] != k[:-1])
    a = edge[k[edge + 1] != 0]
    e = edge[k[edge] != 0]
    power, inverse = _pow(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX[low] * power[: len(raw)])])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mix((sums[e] - sums[a]) * inverse[a]), np.searchsorted(a, np.concatenate([[0], ends]))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the contract, A-Z in lower case."""
    return word_hashes(texts, _WORD, _LOWER)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    m = max(len(h) - n + 1, 0)
    g = np.full(m, _MIX[n], np.uint64)
    for i in range(n):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m]
    return mix(g)


def _extreme(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each n neighbours."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def winnow(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are the least of a window lying in one text (all of equal ones)."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, GRAM)
    least = _extreme(g, SLIDE, np.minimum)
    least[doc[: len(least)] != doc[WINDOW - 1 :]] = 0
    pad = np.zeros(SLIDE - 1, np.uint64)
    most = _extreme(np.concatenate([pad, least, pad]), SLIDE, np.maximum)
    pos = np.flatnonzero(most == g)
    return pos, g[pos]


def _context(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, pad: int) -> np.ndarray:
    """Hashes of the words around each position, within its text; outside it ``pad``."""
    at = pos[:, None] + np.arange(-SIDE, GRAM + SIDE)
    ok = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(ok, h[np.clip(at, 0, max(len(h) - 1, 0))], np.uint64(pad)) if len(h) else np.zeros((0, CTX), np.uint64)


_FP = "array<struct<kind:int,fp:long,pos:long,ctx:binary>>"


def text_slices(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of slices of about STEP bytes; a null text is empty."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= STEP or i == len(texts) - 1:
            yield first, [x or b"" for x in texts[first : i + 1]]
            first, size = i + 1, 0


def _scan(n_keys: int, item: bool, seen=None, short: list[int] | None = None):
    """Python side of the text scan: keys, number of words and fingerprints (those in the filter only) per row."""
    kind_t = pa.list_(pa.struct([("kind", pa.int32()), ("fp", pa.int64()), ("pos", pa.int64()), ("ctx", pa.binary())]))

    def picked(kind, pos, fp, h, off, doc):
        if seen is not None:
            bit = fp >> np.uint64(64 - FILTER_BITS)
            ok = np.frombuffer(seen.value, np.uint8)[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
            pos, fp = pos[ok], fp[ok]
        d = doc[pos]
        return d, np.full(len(pos), kind, np.int32), fp, pos - off[d], _context(h, off[d], off[d + 1], pos, int(item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_slices(b.column(n_keys).to_pylist()):
                h, off = words(texts)
                n = np.diff(off)
                doc = np.repeat(np.arange(len(texts)), n)
                parts = [picked(0, *winnow(h, doc), h, off, doc)]
                if item:
                    sizes = np.unique(n[(n > 0) & (n < WINDOW)])
                    for s in sizes:
                        pos = off[:-1][n == s]
                        parts.append(picked(int(s), pos, grams(h, int(s))[pos], h, off, doc))
                for s in short or ():
                    pos = np.arange(max(len(h) - s + 1, 0))
                    pos = pos[doc[pos] == doc[pos + s - 1]]
                    parts.append(picked(s, pos, grams(h, s)[pos], h, off, doc))
                d, kind, fp, pos, ctx = (np.concatenate([p[i] for p in parts]) for i in range(5))
                o = np.argsort(d, kind="stable")
                raw = np.ascontiguousarray(ctx[o]).astype("<u8").tobytes()
                w = CTX * 8
                flat = pa.StructArray.from_arrays([pa.array(kind[o]), pa.array(fp[o].view(np.int64)), pa.array(pos[o]), pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary())], ["kind", "fp", "pos", "ctx"])
                at = np.searchsorted(d[o], np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), flat).cast(kind_t)
                keys = [b.column(i).slice(first, len(texts)) for i in range(n_keys)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n), lists], [*b.schema.names[:n_keys], "n_words", "fps"])

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        bits[np.asarray(b.column(0)).view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bits"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extends each joined fingerprint over equal words; keeps runs of a whole window."""
    for b in batches:
        c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        x, y = (np.frombuffer(b"".join(c[n].to_pylist()), "<u8").reshape(-1, CTX) for n in ("ctx", "ctx2"))
        eq = x == y
        kind = np.asarray(c["kind"])
        left = np.cumprod(eq[:, :SIDE][:, ::-1], 1).sum(1)
        right = np.cumprod(eq[:, SIDE + GRAM :], 1).sum(1)
        size = np.where(kind == 0, GRAM, kind)
        col = np.arange(CTX)
        core = (eq | (col < SIDE) | (col >= SIDE + size[:, None])).all(1)
        left, right = (np.where(kind == 0, v, 0) for v in (left, right))
        ok = core & ((kind > 0) | (left + GRAM + right >= WINDOW))
        pos = np.asarray(c["pos"])
        start, end = (pos - left)[ok], (pos + size + right)[ok]
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([c["rid"].filter(mask), c["kind"].filter(mask), c["fp"].filter(mask), c["ctx2"].filter(mask), pa.array(start), pa.array(end)], ["rid", "kind", "fp", "ctx2", "start", "end"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) against ``items`` (item_id, text): doc_id, tkey, n_words, n_hit, item_ids.

    n_hit counts the words of ``docs`` inside any occurrence of a window of an item;
    item_ids is the sorted, comma-joined list of items with such windows.  Null and
    empty texts have no words and no hits, items without words have no windows, a null
    item_id counts as an empty string; repeated rows are counted each for itself.
    Items of fewer words than a window are one window, found by the hash of all their
    words.  The filter that tasks get has a fixed size; what passes it is joined exactly.
    """
    spark = docs.sparkSession
    it = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    marks = it.mapInArrow(_scan(1, True), f"item string, n_words long, fps {_FP}")
    marks = saved(marks.select("item", F.explode("fps").alias("f")).select("item", "f.kind", "f.fp", "f.ctx").distinct(), "items")
    short = sorted(r[0] for r in marks.select("kind").distinct().collect() if r[0])  # 12 values at most
    maps = marks.select("fp").repartition(4).mapInArrow(_bitmap, "bits binary").collect()  # 4 of fixed size
    seen = spark.sparkContext.broadcast(np.bitwise_or.reduce([np.frombuffer(r[0], np.uint8) for r in maps]).tobytes())

    src = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_key().alias("tkey"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scan = saved(src.mapInArrow(_scan(3, False, seen, short), f"rid long, doc_id {kind}, tkey long, n_words long, fps {_FP}"), "scan")
    cand = scan.where(F.size("fps") > 0).select("rid", F.explode("fps").alias("f")).select("rid", "f.*")
    ctxs = marks.select("kind", "fp", F.col("ctx").alias("ctx2")).distinct()
    joined = cand.join(ctxs, ["kind", "fp"]).select("rid", "kind", "fp", "pos", "ctx", "ctx2")
    hits = saved(joined.mapInArrow(_extend, "rid long, kind int, fp long, ctx2 binary, start long, end long"), "hits")

    before = F.max("end").over(Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, "start")))
    n_hit = hits.select("rid", "start", "end").distinct().withColumn("new", new).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    of = marks.select("kind", "fp", F.col("ctx").alias("ctx2"), "item")
    found = hits.select("rid", "kind", "fp", "ctx2").distinct().join(of, ["kind", "fp", "ctx2"]).select("rid", "item").distinct()
    ids = found.groupBy("rid").agg(F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("item_ids"))
    per = saved(n_hit.join(ids, "rid"), "per_row")
    zero = F.lit(0).cast("long")
    out = scan.select("rid", "doc_id", "tkey", "n_words").join(per, "rid", "left")
    return out.select("doc_id", "tkey", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"))


#: Contaminated: a twentieth of the words at least are hit.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows."""
    bad = contamination(docs, items).where(CONTAMINATED).select("doc_id", "tkey").distinct()
    return drop_rows(docs, saved(bad, "contaminated"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items in every document."""
    r = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


# Windows of 13 consecutive words by position; a shorter item is one window.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, md5(array_to_string(w[i : i + n - 1], ' ')) AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
hit AS (SELECT doc_id, i, n, item_id
        FROM (SELECT doc_id, n, i, md5(array_to_string(w[i : i + n - 1], ' ')) AS g
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) x
        JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
