"""Readers: parquet / CSV / TSV / JSON by extension, JSON directories, nested segment files.

Everything is a lazy ``spark.read`` (column pruning and filter pushdown reach
the scan); multi-file loads are one read over a directory or glob, so
Spark's scan tasks replace the reference's thread pool.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vitalis.session import ensure_checkpoint_dir

FORMATS = {".json": "json", ".csv": "csv", ".tsv": "csv", ".parquet": "parquet"}
# microsecond precision: the default JSON timestamp format keeps milliseconds only
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"
JSON_OPTIONS = {"timestampNTZFormat": TS_NTZ_FORMAT, "timestampFormat": TS_FORMAT}


def detect_format(path: str) -> str:
    """Format from the extension ('unknown' when not supported)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    return FORMATS.get(ext, "unknown")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, sep: str | None = None, schema: StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV/TSV with a header; '.tsv' forces tab; blank lines skipped; utf-8.

    Without a schema the types are inferred (one extra pass over the data);
    pass a schema in production.
    """
    if sep is None:
        sep = "\t" if path.rstrip("/").lower().endswith(".tsv") else ","
    r = spark.read.option("header", header).option("sep", sep).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None,
              multiline: bool = False) -> DataFrame:
    """JSON lines, or whole JSON documents (``multiline``: an array gives one row per element)."""
    r = spark.read.option("multiLine", multiline).option("encoding", "UTF-8").options(**JSON_OPTIONS)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    """Dispatch on ``fmt`` or the extension; unknown formats raise ValueError."""
    fmt = fmt or detect_format(path)
    if fmt == "parquet":
        return read_parquet(spark, path, kw.get("columns"))
    if fmt in ("csv", "tsv"):
        return read_csv(spark, path, kw.get("sep", "\t" if fmt == "tsv" else None), kw.get("schema"))
    if fmt == "json":
        return read_json(spark, path, kw.get("schema"), kw.get("multiline", False))
    raise ValueError(f"Unsupported file format: {fmt}")


def list_files(spark: SparkSession, directory: str, suffix: str = ".json", pattern: str | None = None) -> DataFrame:
    """(path, file_name, modification_time, length) of files in a directory, optional unanchored regex on the name.

    Only file metadata is read (``binaryFile`` with the content column pruned).
    """
    df = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
          .option("recursiveFileLookup", "true").load(directory)
          .select("path", "modificationTime", "length"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    df = df.select("path", name.alias("file_name"), F.col("modificationTime").alias("modification_time"), "length")
    return df.where(F.col("file_name").rlike(pattern)) if pattern else df


def scan_json_dir(spark: SparkSession, directory: str, schema: StructType | str, pattern: str | None = None,
                  suffix: str = ".json") -> tuple[DataFrame, DataFrame]:
    """Load every JSON-lines file of a directory tree; broken lines are dropped and counted.

    Returns ``(rows, bad)`` where ``bad`` has (file_name, n_bad) for files with
    lines that did not parse (the reference logs a failed file and goes on).
    """
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
           .text(directory).select("value", F.col("_metadata.file_name").alias("file_name")))
    if pattern:
        raw = raw.where(F.col("file_name").rlike(pattern))
    raw = raw.where(F.trim("value") != "")
    kind = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    wide = StructType([*kind.fields, StructField("_broken", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", **JSON_OPTIONS}
    parsed = raw.select("file_name", F.from_json(F.trim("value"), wide, options).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r._broken").isNull()
    good = parsed.where(ok)
    bad = parsed.where(~ok).groupBy("file_name").agg(F.count(F.lit(1)).alias("n_bad"))
    return good.select("file_name", *[F.col("r").getField(f.name).alias(f.name) for f in kind.fields]), bad


# ------------------------------------------------------------------ nested segment files

WINDOW_SCHEMA = ("struct<timestamp:double, ppg_input:array<array<double>>, eda_input:array<array<double>>, "
                 "tonic_input:array<array<double>>, accel_input:array<array<double>>, "
                 "temp_input:array<array<double>>, eng_features_input:array<double>, "
                 "raw_eng_features_input:array<double>>")
TRIAL_SCHEMA = f"struct<label:double, turbulence:string, windowed_features:array<{WINDOW_SCHEMA}>>"


def load_segment_files(spark: SparkSession, directory: str, pattern: str | None = None) -> DataFrame:
    """One JSON array of trials per entity file -> (entity, trial_idx, label, condition, windows).

    The entity id is the file name before the first '.'; the trial index is the
    array position.  Each file is one row (``wholetext``) so a file must stay
    well below 2 GB; a file that fails to parse is dropped (NULL parse).
    """
    raw = (spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(directory)
           .select("value", F.col("_metadata.file_name").alias("file_name")))
    if pattern:
        raw = raw.where(F.col("file_name").rlike(pattern))
    parsed = raw.select(F.split_part("file_name", F.lit("."), F.lit(1)).alias("entity"),
                        F.from_json("value", f"array<{TRIAL_SCHEMA}>").alias("trials"))
    e = parsed.where(F.col("trials").isNotNull()).select("entity", F.posexplode("trials").alias("trial_idx", "t"))
    return e.select("entity", F.col("trial_idx").cast("bigint").alias("trial_idx"), F.col("t.label").alias("label"),
                    F.coalesce(F.col("t.turbulence"), F.lit("unknown")).alias("condition"),
                    F.coalesce(F.col("t.windowed_features"), F.array()).alias("windows"))


def load_segment_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Scalable layout: JSON lines of (entity, trial_idx, window_idx, label, turbulence, window).

    One line per window, so no record grows with a trial or an entity.
    """
    schema = (f"entity string, trial_idx bigint, window_idx bigint, label double, turbulence string, "
              f"window {WINDOW_SCHEMA}")
    df = spark.read.options(**JSON_OPTIONS).schema(schema).json(directory)
    return df.withColumn("condition", F.coalesce("turbulence", F.lit("unknown"))).drop("turbulence")


def explode_segments(trials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All windows of the trials as rows (keys..., window_idx, window); a trial without windows gives none."""
    keys = keys or ["entity", "trial_idx"]
    return trials.select(*keys, F.posexplode("windows").alias("window_idx", "window"))


def segment_features(windows: DataFrame, window: str = "window", kind: str = "eng_features",
                     n_features: int = 22) -> DataFrame:
    """Feature vector of each window: engineered -> first ``n_features`` values; a signal kind (ppg, eda, tonic,
    accel, temp; raw is ppg) -> element 0 of its input; any other kind falls back to the engineered vector."""
    w = F.col(window)
    if kind in ("raw", "ppg", "eda", "tonic", "accel", "temp"):
        feat = F.get(w["ppg_input" if kind == "raw" else f"{kind}_input"], 0)
    elif kind == "raw_eng_features":
        feat = F.slice(w["raw_eng_features_input"], 1, n_features)
    else:
        feat = F.slice(w["eng_features_input"], 1, n_features)
    return windows.withColumn("features", feat)


def limit_entities(df: DataFrame, entity: str, n: int) -> DataFrame:
    """Keep the first ``n`` entities by id (deterministic, unlike a directory listing order).

    Up to 100,000 ids are broadcast into a left-semi join, more are joined by a shuffle.
    """
    ids = df.select(entity).distinct().orderBy(entity).limit(n)
    return df.join(F.broadcast(ids) if n <= 100_000 else ids, entity, "left_semi")


# ------------------------------------------------------------------ fingerprint / scratch

def fingerprint(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = (".json", ".parquet")) -> DataFrame:
    """(n_files, fingerprint) over relpath:mtime of the data files; content is never read.

    Each file contributes md5('relpath:mtime'); the per-file digests are combined
    with an order-independent sum in one aggregate, so the listing never has to
    be sorted or gathered in one place.
    """
    base = directory.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
             .select("path", "modificationTime"))
    name_ok = F.lit(False)
    for s in suffixes:
        name_ok = name_ok | F.col("path").endswith(s)
    rel = F.regexp_replace("path", r"^.*?" + _escape(os.path.basename(base)) + "/", "")
    tag = F.concat_ws(":", rel, F.unix_micros(F.col("modificationTime")).cast("string"))
    part = F.conv(F.substring(F.md5(tag), 1, 12), 16, 10).cast("decimal(38,0)")
    agg = files.where(name_ok).agg(F.count(F.lit(1)).alias("n_files"), F.sum(part).alias("_s"))
    return agg.select("n_files", F.md5(F.concat_ws(":", F.col("n_files").cast("string"),
                                                    F.col("_s").cast("string"))).alias("fingerprint"))


def _escape(s: str) -> str:
    import re

    return re.escape(s)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/vitalis-scratch/{name}-{uuid.uuid4().hex[:12]}"


def cache_key(identifier: str) -> str:
    return hashlib.md5(identifier.encode("utf-8")).hexdigest()
