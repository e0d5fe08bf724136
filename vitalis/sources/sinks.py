"""Sinks and durable caching: CSV / JSON results, materialised datasets, fitted models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from vitalis.sources.readers import cache_key


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def materialize(df: DataFrame, identifier: str, directory: str) -> DataFrame:
    """Write ``df`` once to ``directory/md5(identifier)`` and read it back; reuse it when present.

    A folder without ``_SUCCESS`` (an interrupted write) or one that cannot be
    read counts as a miss and is rewritten.  The written table also cuts the
    lineage (a durable, shared copy, unlike ``localCheckpoint``).
    """
    spark = df.sparkSession
    path = f"{directory.rstrip('/')}/{cache_key(identifier)}"
    if path_exists(spark, f"{path}/_SUCCESS"):
        try:
            cached = spark.read.parquet(path)
            cached.schema  # noqa: B018 - forces the footer read
            return cached
        except Exception:  # noqa: BLE001 - damaged entry -> miss
            pass
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear_cache(spark: SparkSession, directory: str, identifier: str | None = None) -> None:
    """Remove one cached dataset, or the whole cache folder."""
    target = directory.rstrip("/") + ("" if identifier is None else f"/{cache_key(identifier)}")
    fs, p = _fs(spark, target)
    if fs.exists(p):
        fs.delete(p, True)


def save_model(model, path: str, metadata: dict | None = None) -> None:
    """Save a fitted Spark ML model with a small JSON metadata record next to it."""
    model.write().overwrite().save(f"{path}/model")
    if metadata is not None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(metadata, default=str),)], "metadata string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str, cls=None):
    """Load a model saved by ``save_model`` (``cls`` defaults to PipelineModel); returns (model, metadata)."""
    from pyspark.ml import PipelineModel

    spark = SparkSession.getActiveSession()
    model = (cls or PipelineModel).load(f"{path}/model")
    meta = None
    if path_exists(spark, f"{path}/metadata"):
        rows = spark.read.text(f"{path}/metadata").collect()
        meta = json.loads(rows[0][0]) if rows else None
    return model, meta
