"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.llm.common import table
from vitalis.llm.decontam import text_slices, word_hashes
from vitalis.llm.langid import fold

#: Words are hashed into so many vectors; all tables of words have this size whatever the vocabulary.
WORDS = 1 << 14
#: Entries of a vector; of an index vector NONZERO are +1 and as many -1.
DIM = 64
NONZERO = 2
#: Neighbours on either side that make up a word's context.
NEIGHBOURS = 2
#: Vectors that move together when the tasks' sums are added up.
BLOCK = 256
#: Labelled rows (about) that the network is fitted on, taken by a hash of the id; a fifth calibrate it.
TRAIN = 20_000
HIDDEN = 32
EPOCHS = 40
#: Steps of the optimiser at least, for few rows.
STEPS = 2000
#: Score from which on label 1 is predicted.
THRESHOLD = 0.3
SEED = 20240601

# letters, digits and bytes above ASCII make words, other visible characters words of their own kind
_KIND = np.zeros(256, np.int8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places of the +1 and of the -1 entries of each word's index vector."""
    r = np.random.default_rng(SEED)
    places = r.permuted(np.tile(np.arange(DIM), (WORDS, 1)), axis=1)[:, : 2 * NONZERO].astype(np.int32)
    return places[:, :NONZERO], places[:, NONZERO:]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The vector numbers of all words (case counts, a run of punctuation is a word), and where each text's begin."""
    h, to = word_hashes(texts, _KIND)
    return (h % np.uint64(WORDS)).astype(np.int64), to


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of the neighbours' index vectors, per word: whole numbers, so their order doesn't matter."""
    plus, minus = _index()
    sums = np.zeros(WORDS * DIM, np.int64)
    some = False
    for b in batches:
        for _, texts in text_slices(b.column(0).to_pylist()):
            w, to = _words(texts)
            doc = np.repeat(np.arange(len(texts)), np.diff(to))
            up, down = [], []
            for o in range(1, NEIGHBOURS + 1):
                near = doc[o:] == doc[: len(doc) - o]
                for me, other in ((w[o:][near], w[: len(w) - o][near]), (w[: len(w) - o][near], w[o:][near])):
                    up.append((me[:, None] * DIM + plus[other]).ravel())
                    down.append((me[:, None] * DIM + minus[other]).ravel())
            if up and len(w):
                sums += np.bincount(np.concatenate(up), minlength=len(sums)) - np.bincount(np.concatenate(down), minlength=len(sums))
                some = True
    if some:
        blocks = sums.reshape(-1, BLOCK * DIM)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([x.tobytes() for x in blocks], pa.binary())], ["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(raw.as_buffer(), np.int64)
            total[k] = total[k] + x if k in total else x.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(WORDS, 2 * DIM) float32 from all of ``docs``: normalised context vectors beside the index vectors.

    Each task adds up whole-number contexts in a table of fixed size, and blocks of the
    tables are added up where they meet; the driver gets one such table.
    """
    parts = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(_contexts, "block int, sums binary")
    got = parts.repartition("block").mapInArrow(_added, "block int, sums binary").collect()  # WORDS * DIM numbers
    sums = np.zeros((WORDS // BLOCK, BLOCK * DIM), np.int64)
    for block, raw in got:
        sums[block] = np.frombuffer(raw, np.int64)
    context = sums.reshape(WORDS, DIM).astype(np.float64)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1.0)
    index = np.zeros((WORDS, DIM))
    rows = np.arange(WORDS)[:, None]
    index[rows, _index()[0]], index[rows, _index()[1]] = 1, -1
    return np.hstack([context, index / np.sqrt(2 * NONZERO)]).astype(np.float32)


#: Numbers that follow the mean vector in a pooled row.
EXTRA = 5


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """One row per text: the mean vector of its words, the lengths of both halves of the mean, the mean
    product of a word's index vector with that of the next and the next but one, the log of the words.

    The mean of unit vectors is long where a text repeats few words, the products are
    near 1 where it repeats them at once.  A text without words is zero.
    """
    w, to = _words(texts)
    n = np.diff(to)
    d = vectors.shape[1]
    out = np.zeros((len(texts), d + EXTRA))
    full = np.flatnonzero(n)
    if len(full):
        v = vectors[w]
        out[full, :d] = np.add.reduceat(v, to[full]) / n[full, None]
        out[:, d], out[:, d + 1] = np.linalg.norm(out[:, : d // 2], axis=1), np.linalg.norm(out[:, d // 2 : d], axis=1)
        doc = np.repeat(np.arange(len(texts)), n)
        for lag in (1, 2):
            same = doc[lag:] == doc[: len(doc) - lag]
            near = np.einsum("ij,ij->i", v[lag:, d // 2 :], v[: len(v) - lag, d // 2 :])
            out[:, d + 1 + lag] = np.bincount(doc[lag:], near * same, len(texts)) / np.maximum(n - lag, 1)
        out[:, d + 4] = np.log1p(n)
    return out


class Network(NamedTuple):
    """Two layers over standardised inputs; scores are sigmoid(output / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, decay: float = 1e-3) -> Network:
    """Fits by Adam on four fifths of the rows, and a temperature on the rest by the log loss."""
    if not len(x):
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1), 1.0)
    r = np.random.default_rng(SEED)
    by = r.permutation(len(x))
    keep = by[len(x) // 5 :]
    epochs = max(epochs, -(-STEPS // max(1, len(keep) // 128)))
    mean, scale = x[keep].mean(0), np.maximum(x[keep].std(0), 1e-6)
    xs = (x - mean) / scale
    p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        for part in np.array_split(r.permutation(keep), max(1, len(keep) // 128)):
            a, b = xs[part], y[part]
            h = np.tanh(a @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - b) / len(part)
            back = np.outer(e, p[2]) * (1 - h * h)
            t += 1
            for i, g in enumerate((a.T @ back + decay * p[0] / len(p[0]), back.sum(0), h.T @ e + decay * p[2], np.array([e.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, *p, 1.0)
    z, held = net.logits(x[by[: len(x) // 5]]), y[by[: len(x) // 5]]
    options = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    return net._replace(temperature=float(min(options, key=lambda c: _loss(z / c, held))) if len(z) else 1.0)


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = TRAIN) -> Network:
    """Learns ``labels`` (doc_id, quality 0 or 1) of ``docs`` (doc_id, text); null ids and labels teach nothing.

    About ``sample`` labels are taken by a hash of their id, all if there are fewer;
    their pooled vectors come to the driver.
    """
    spark = docs.sparkSession
    have = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("__y")).distinct()
    n = have.count()
    some = have.where(F.pmod(F.xxhash64(F.lit(SEED), "__id"), F.lit(1 << 40)) < int(min(1.0, sample / max(n, 1)) * (1 << 40)))
    rows = docs.join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("doc_id", "__y", F.col("text").cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_slices(b.column(2).to_pylist()):
                x = pooled(texts, shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    got = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("y", T.DoubleType()), T.StructField("x", T.BinaryType())]))
    got = sorted((r[0], r[1], bytes(r[2])) for r in got.collect())  # about ``sample`` rows
    x = np.array([np.frombuffer(r[2]) for r in got]).reshape(-1, vectors.shape[1] + EXTRA)
    return train(x, np.array([r[1] for r in got]))


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """``doc_id`` and score (0 to 1) of every row; null and empty texts are scored as having no words."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    src = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        for b in batches:
            for first, texts in text_slices(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(m.score(pooled(texts, v)))], ["doc_id", "score"])

    return src.mapInArrow(run, T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    net = fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0), vectors)
    r = score(docs, vectors, net)
    return r.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
