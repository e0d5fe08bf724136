"""Helpers of the training-data operators: shared tables, row keys, ranks, components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalis import ship_package
from vitalis.session import ensure_checkpoint_dir

#: Rows of a narrow key table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


#: Bytes of an Arrow batch that a Python worker gets: texts are long, and a worker holds a batch and what it makes of it.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to BATCH bytes (smaller ones stay)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        spark.conf.set(key, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also makes the package importable in the Python workers."""
    ship_package(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/vitalis-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there, executors can be lost."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of ``saved`` tables that no later plan reads."""
    for t in tables:
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()} if t is not None else ():
            if "/vitalis-" in f:
                jvm = t.sparkSession._jvm
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a saved table) with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    """Null-safe equality of columns of one name in two frames."""
    cond = a[cols[0]].eqNullSafe(b[cols[0]])
    for c in cols[1:]:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def text_key(col: str = "text") -> Column:
    """64-bit key of a text; with an id it names a row by its content alone (null: a key of its own)."""
    return F.when(F.col(col).isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit("text"), F.col(col)))


def drop_rows(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text) is in ``bad`` (doc_id, tkey; a saved table)."""
    d = docs.withColumn("__t", text_key())
    b = small(bad.select(F.col("doc_id").alias("__bid"), F.col("tkey").alias("__bt")))
    cond = d["__t"].eqNullSafe(b["__bt"]) & d["doc_id"].eqNullSafe(b["__bid"])
    return d.join(b, cond, "left_anti").drop("__t")


def ranked(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column | str], out: str) -> DataFrame:
    """Adds the rank (long, from 0) of each row in its group by (bucket, order).

    ``bucket`` is a coarse form of the order, spread evenly over a fixed number of
    values: only the rows of one (group, bucket) are sorted together, and counts per
    bucket give the offsets, so a group that holds a third of all rows is split.
    ``df`` must be a saved table or a plain scan (it is read twice).
    """
    d = df.withColumn("__b", bucket)
    c = d.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    c = c.withColumn("__off", F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).drop("__n")
    r = d.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__b").orderBy(*order)))
    joined = r.join(c, same(r, c, [*group, "__b"]))
    return joined.select(*[r[x] for x in df.columns], (c["__off"] + r["__r"] - 1).alias(out))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of ``edges`` (a, b long): one row (node, root) per node, root its smallest node.

    Alternating large and small stars (Kiveris et al., 2014) on tables in the shared
    folder; minima are written before they are joined back, so that adaptive
    execution can split the rows of a hub.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        wide = saved(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        low2 = saved(wide.groupBy("u").agg(F.min("v").alias("m")), "stars")
        near = wide.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(near.union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e, low, wide, low2)
        e, last, seen = new, seen, mark(new)
        if seen == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("v").distinct()
    return saved(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v")), "components")
