"""Language identification by nearest clustered centroids of normalised TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.llm.common import bounded_batches, saved, small, table

#: Hashed dimensions of the n-grams.
DIM = 4096
#: Lengths of the byte n-grams.
GRAMS = (2, 3)
#: Centroids of a language, and labelled rows (about) that they are clustered from.
CLUSTERS = 4
SAMPLE = 2000
#: A document is rejected whose best cosine falls below this share of what rows of its number of n-grams have,
#: if it has so many n-grams: of fewer the distance tells little.
NEAR = 0.25
ENOUGH = 32
SEED = 20240601
#: Bytes of text hashed at once.
STEP = 1 << 19

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ASCII = re.compile("[A-Za-z]")


class Model(NamedTuple):
    """``centroids`` (normalised rows) of ``langs``; ``idf`` by dimension; ``floor`` by bit length of the n-gram count."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII.search(text) is not None or not text.isascii() and any(map(str.isalpha, text)))


def counts(texts: list[bytes]) -> np.ndarray:
    """Counts (texts, DIM) of hashed n-grams of the letters; anything else is one space, ASCII letters in lower case."""
    sep = b"\n" * max(GRAMS)
    raw = _LETTER[np.frombuffer(sep + sep.join(texts) + sep, np.uint8)]
    doc = np.repeat(np.arange(len(texts) + 1), [len(sep), *(len(t) + len(sep) for t in texts)]) - 1
    doc[: len(sep)] = 0
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    x, doc = raw[keep].astype(np.uint32), doc[keep]
    out = np.zeros(len(texts) * DIM, np.int64)
    for n in GRAMS:
        m = max(len(x) - n + 1, 0)
        g = np.full(m, n, np.uint32)
        for i in range(n):
            g = (g ^ x[i : i + m]) * np.uint32(0x01000193)
        g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        g ^= g >> np.uint32(13)
        # a gram that a space joins to the next text has no letter of both: runs of spaces are one
        same = doc[:m] == doc[n - 1 :][:m]
        out += np.bincount(doc[:m][same] * DIM + (g[same] % DIM).astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), DIM)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows (float32); a row without n-grams is zero."""
    v = np.log1p(c).astype(np.float32) * idf.astype(np.float32)
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= STEP or i - first >= 255 or i == len(texts) - 1:
            yield first, [x or b"" for x in texts[first : i + 1]]
            first, size = i + 1, 0


def _bits(c: np.ndarray) -> np.ndarray:
    """Bit lengths of the rows' n-gram counts."""
    return np.array([int(x).bit_length() for x in c.sum(1)], np.int64)


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df = 0, np.zeros(DIM, np.int64)
    for b in batches:
        for _, texts in _slices(b.column(0).to_pylist()):
            df += (counts(texts) > 0).sum(0)
            n += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([np.array([n]), df]))], ["dim", "n"])


def _cluster(v: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means of normalised rows, from a farthest-first start."""
    c = [v.mean(0)]
    for _ in range(k - 1):
        c.append(v[np.argmin(np.max(v @ np.array(c).T, 1))])
    c = np.array(c[:k])
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(v @ c.T, 1)
        c = np.array([v[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(rows: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS, text: str = "text", lang: str = "lang") -> Model:
    """Learns from ``rows`` (text, lang); rows without a text, a letter or a language teach nothing.

    Document frequencies come from all rows.  Centroids are clustered, a language in a
    task, from about ``sample`` texts of each language, taken by a seeded hash of the
    text (all texts of a language that has fewer; copies count once).  The driver gets ``clusters`` vectors
    a language and one number a dimension.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    spread = src.select(F.col("text").cast("binary").alias("text")).mapInArrow(_df, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    got = {r[0]: r[1] for r in spread.collect()}  # DIM + 1 rows
    total = got.get(-1, 0)
    idf = np.log((total + 1) / (np.array([got.get(d, 0) for d in range(DIM)]) + 1)) + 1
    key = F.xxhash64(F.lit(SEED), "text")
    sizes = saved(src.select(F.col("lang").alias("l"), key.alias("k")).distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n")), "langs")
    part = F.pmod(key, F.lit(1 << 40)) < F.lit(float(sample << 40)) / F.col("n")
    some = src.join(small(sizes), F.col("lang") == F.col("l")).where(part).select("lang", "text").distinct().select("lang", F.col("text").cast("binary").alias("text"))

    def centroids(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in got["text"] if has_letter(t.decode("utf-8", "replace"))]
        if not texts:
            return pd.DataFrame({"lang": [key[0]], "centroid": [None], "low": [None]})
        parts = [(vectors(c, idf), _bits(c)) for c in (counts(x) for _, x in _slices(texts))]
        v, bits = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        k = _cluster(v, min(clusters, len(v)))
        best = (v @ k.T).max(1)
        low = np.array([np.median(best[bits == i]) if (bits == i).any() else np.inf for i in range(64)], np.float64)
        return pd.DataFrame({"lang": key[0], "centroid": [x.tobytes() for x in k.astype(np.float32)], "low": low.tobytes()})

    found = some.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, low binary").where("centroid is not null").collect()
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    low = np.array([np.frombuffer(r[2]) for r in found]).reshape(-1, 64).min(0, initial=np.inf)
    for i in range(64):  # lengths that no row has: as of the next shorter
        low[i] = low[i] if np.isfinite(low[i]) else low[i - 1] if i else 0
    low[: ENOUGH.bit_length()] = 0
    return Model([r[0] for r in found], np.array([np.frombuffer(r[1], np.float32) for r in found]).reshape(-1, DIM), idf, NEAR * low)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` plus the language of each text, its score and whether it is rejected.

    The language is that of the nearest centroid, the score its cosine (0 to 1).
    Rejected: null texts, texts without a letter (language ``und``, score 0) and texts
    farther from every centroid than rows of like length are (a share of their usual cosine).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters x languages x DIM numbers
    bounded_batches(docs.sparkSession)
    cols = docs.columns
    plain = isinstance(docs.schema[text].dataType, T.StringType)
    src = docs if plain else docs.withColumn("__text", F.col(text).cast("string"))
    at_text = cols.index(text) if plain else len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = np.array([*m.langs, "und"], object)
        for b in batches:
            texts = b.column(at_text).to_pylist()
            best, score, bad = np.full(len(texts), len(m.langs)), np.zeros(len(texts)), np.ones(len(texts), bool)
            for first, part in _slices([None if t is None else t.encode() for t in texts]):
                at = slice(first, first + len(part))
                ok = np.array([has_letter(t) for t in texts[at]], bool)
                if not ok.any() or not len(m.langs):
                    continue
                c = counts(part)
                cos = vectors(c, m.idf) @ m.centroids.T
                near = cos.argmax(1)
                top = np.clip(cos[np.arange(len(part)), near].astype(np.float64), 0, 1)
                best[at], score[at] = np.where(ok, near, len(m.langs)), np.where(ok, top, 0)
                bad[at] = ~ok | (top < m.floor[_bits(c)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(langs[best], pa.string()), pa.array(score), pa.array(bad)], [*cols, *names])

    new = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())]
    return src.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as no text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def identify(docs: DataFrame, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` (doc_id, text, lang) with predictions learned from its rows outside of fold 2 of 4."""
    return predict(docs, fit(docs.where(fold("doc_id", 4) != 2)), names=names)


def known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that language identification rejects; all columns stay."""
    names = ("__lang", "__score", "__rejected")
    return identify(docs, names).where("not __rejected").drop(*names)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    r = identify(docs.select("doc_id", "text", "lang"))
    return r.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
