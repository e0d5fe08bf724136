"""Nearest neighbours by inner product in vantage-point trees, one per shard.

Inner products become distances by one more coordinate: with M the largest norm of a
shard, x gets sqrt(M^2 - |x|^2) and a query 0, so that |q - x|^2 = |q|^2 + M^2 - 2 q.x and
the triangle inequality holds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalis.llm.common import saved, small, table

K = 20
#: Distinct vectors of a shard (about), of a leaf, and queries that meet a tree in one task (about).
SHARD = 8192
LEAF = 64
QUERIES = 8192
#: Prunes a subtree whose least possible distance times FACTOR exceeds the k-th found; 1 is exact, more is faster.
FACTOR = 1.0
#: Distances are rounded: subtrees this near the bound are searched as well.
SLACK = 1e-6


def build(vectors: np.ndarray, leaf: int = LEAF, seed: int = 0) -> dict:
    """Vantage-point tree of the rows of ``vectors`` (float64).

    ``order`` permutes the rows; a node is (first, end, vantage row, near child, far child, and the
    least and largest distance from the vantage point to the rows of each child).
    """
    big = float(np.max(np.einsum("ij,ij->i", vectors, vectors), initial=0.0))
    x = np.hstack([vectors, np.sqrt(np.maximum(big - np.einsum("ij,ij->i", vectors, vectors), 0))[:, None]])
    order = np.random.default_rng(seed).permutation(len(x))
    links: list[list[int]] = []
    bounds: list[tuple[float, float, float, float]] = []

    def node(a: int, b: int) -> int:
        at = len(links)
        links.append([a, b, -1, -1, -1])
        bounds.append((0.0, 0.0, 0.0, 0.0))
        if b - a > leaf:
            v, rest = order[a], order[a + 1 : b].copy()
            d = np.sqrt(((x[rest] - x[v]) ** 2).sum(1))
            half = len(rest) // 2
            by = np.argpartition(d, half)
            order[a + 1 : b], d = rest[by], d[by]
            bounds[at] = (d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max())
            links[at][2] = v
            links[at][3] = node(a + 1, a + 1 + half)
            links[at][4] = node(a + 1 + half, b)
        return at

    node(0, len(x))
    return {"x": x, "order": order, "links": np.array(links, np.int64), "bounds": np.array(bounds), "big": big}


def search(tree: dict, queries: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
    """(query row, vector row) of every vector at least as near as the k-th nearest of its query in the tree.

    A first descent to one leaf per query bounds the k-th distance, a pruned traversal
    makes it exact (with ``factor`` 1), and a last one lists what lies within it, ties included.
    """
    x, order, links, bounds, big = (tree[n] for n in ("x", "order", "links", "bounds", "big"))
    q = np.hstack([queries, np.zeros((len(queries), 1))])
    norm = np.einsum("ij,ij->i", q, q) + big
    top = np.full((len(q), k), -np.inf)

    def radius(rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th found so far."""
        return np.sqrt(np.maximum(norm[rows] - 2 * top[rows].min(1), 0))

    def add(rows: np.ndarray, points: np.ndarray) -> None:
        s = np.hstack([top[rows], q[rows] @ x[points].T])
        top[rows] = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k :]

    def from_vantage(rows: np.ndarray, v: int) -> np.ndarray:
        return np.sqrt(((q[rows] - x[v]) ** 2).sum(1))

    def least(d: np.ndarray, lo: float, hi: float) -> np.ndarray:
        return np.maximum(np.maximum(lo - d, d - hi), 0)

    stack = [(0, np.arange(len(q)))]
    while stack:
        n, rows = stack.pop()
        a, b, v, near, far = links[n]
        if not len(rows):
            continue
        if near < 0:
            add(rows, order[a:b])
            continue
        d = from_vantage(rows, v)
        inner = least(d, *bounds[n][:2]) <= least(d, *bounds[n][2:])
        stack += [(near, rows[inner]), (far, rows[~inner])]
    first = top.min(1)  # a bound only: these points come again
    top[:] = -np.inf
    limit = np.sqrt(np.maximum(norm - 2 * first, 0))

    found_q, found_x = [], []
    for last in (False, True):
        if last:
            limit = radius(np.arange(len(q)))
        stack = [(0, np.arange(len(q)))]
        while stack:
            n, rows = stack.pop()
            if not len(rows):
                continue
            a, b, v, near, far = links[n]
            points = order[a:b] if near < 0 else order[a : a + 1]
            if last:
                s = q[rows] @ x[points].T
                i, j = np.nonzero(np.sqrt(np.maximum(norm[rows, None] - 2 * s, 0)) <= limit[rows, None] + SLACK)
                found_q.append(rows[i])
                found_x.append(points[j])
            else:
                add(rows, points)
            if near < 0:
                continue
            d = from_vantage(rows, v)
            r = limit[rows] if last else np.minimum(limit[rows], radius(rows))
            for child, lo, hi in ((far, *bounds[n][2:]), (near, *bounds[n][:2])):
                stack.append((child, rows[factor * least(d, lo, hi) <= r + SLACK]))
    return np.concatenate(found_q), np.concatenate(found_x)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with an id and a vector of finite components that are not all zero, the vector as doubles in bytes."""
    for b in batches:
        ids, dims, raw = [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = np.asarray(v.values, np.float64) + 0.0
            if np.isfinite(x).all() and x.any():
                ids.append(i), dims.append(len(x)), raw.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "dim", "vec"])


def prepare(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, dim, vec) of the rows that take part: null ids and null, empty, zero, null-holding or non-finite vectors don't."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec")).mapInArrow(_valid, "id long, dim int, vec binary")


def build_index(points: DataFrame, k: int = K, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """One vantage-point tree per shard of ``points`` (id, dim, vec): dim, shard, tree; a saved table.

    Equal vectors are one point with the ``k + 1`` smallest ids, which is all that a
    search for ``k`` can return of them; every vector is in one tree.  Shards are hash
    ranges of the vectors, sized by their number; vectors of different length never meet.
    """
    low = points.withColumn("r", F.dense_rank().over(Window.partitionBy("dim", "vec").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = saved(low.groupBy("dim", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    sizes = small(saved(classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).alias("n")), "dims"))
    cut = classes.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("vec"), F.col("n")).alias("shard"), "n", "vec", "ids")

    def tree(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("vec")
        t = build(np.array([np.frombuffer(v) for v in got["vec"]]), leaf)
        t["ids"] = [np.asarray(i, np.int64) for i in got["ids"]]
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "shards": [got["n"].iloc[0]], "tree": [pickle.dumps(t)]})

    return saved(cut.groupBy("dim", "shard").applyInPandas(tree, "dim int, shard long, shards long, tree binary"), "trees")


def _search(k: int, factor: float):
    def one(tree: dict, ids: np.ndarray, vecs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The k nearest in the tree of each query, by score on the original vectors, then by id."""
        qi, xi = search(tree, vecs, k + 1, factor)  # its own may be among them
        for lo in range(0, len(qi), 1 << 16):
            hi = slice(lo, lo + (1 << 16))
            score = np.cumsum(vecs[qi[hi]] * tree["x"][xi[hi], :-1], 1)[:, -1]  # one term after the other
            size = np.array([len(tree["ids"][i]) for i in xi[hi]], np.int64)
            f = pd.DataFrame({"q": np.repeat(qi[hi], size), "vec_id": np.concatenate([tree["ids"][i] for i in xi[hi]]), "score": np.repeat(score, size)})
            parts.append(f[f["vec_id"].to_numpy() != ids[f["q"].to_numpy()]])
        f = pd.concat(parts).sort_values(["q", "score", "vec_id"], ascending=[True, False, True]).groupby("q").head(k)
        parts.clear()
        q = f["q"].to_numpy()
        raw = [v.tobytes() for v in vecs]
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array([raw[i] for i in q], pa.binary()), pa.array(f["vec_id"].to_numpy()), pa.array(f["score"].to_numpy())], ["query_id", "query", "vec_id", "score"])

    parts: list[pd.DataFrame] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            kind = np.asarray(b.column(0))
            at = np.flatnonzero(kind == 0)
            for x, y in zip(np.concatenate([[-1], at]), np.concatenate([at, [b.num_rows]]), strict=True):
                if x >= 0:
                    tree = pickle.loads(b.column(2)[int(x)].as_py())
                if y - x > 1:
                    part = b.slice(int(x) + 1, int(y - x - 1))
                    vecs = np.array([np.frombuffer(v) for v in part.column(2).to_pylist()])
                    yield from one(tree, np.asarray(part.column(1)), vecs)

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, block: int = QUERIES) -> DataFrame:
    """The ``k`` nearest of each query (id, dim, vec) but its own id: query_id, rank, vec_id, score.

    Queries go to every tree of their length in blocks; each (tree, block) is a task's
    work: the tree, then its queries, in batches.  Ties go to the smaller id.  A query
    id with several different vectors is answered for each of them.
    """
    q = saved(queries.distinct(), "queries")
    blocks = max(1, -(-q.count() // block))
    trees = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("tree").alias("body"))
    dims = small(saved(index.select("dim", "shards").distinct(), "shards"))
    asked = q.join(dims, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "id", F.col("vec").alias("body"))
    met = trees.join(asked.select("dim", "shard", "block").distinct(), ["dim", "shard", "block"], "left_semi").union(asked)
    met = met.repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "kind", "id").select("kind", "id", "body")
    found = met.mapInArrow(_search(k, factor), "query_id long, query binary, vec_id long, score double")
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20, against all others."""
    points = prepare(table(spark, sf_dir, "embeddings"))
    return nearest(build_index(points), points.where("id % 20 = 0"))


OP9_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
           AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
