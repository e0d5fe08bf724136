"""Source/sink round trips: each query writes a driver table in a format, reads it back with our reader.

Scratch folders live under the session's checkpoint directory (a shared file
system on a cluster).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalis.plans import roles
from vitalis.plans.registry import register
from vitalis.plans.roles import with_ctes
from vitalis.sources import readers, sinks


@register("scan_csv", "SELECT * FROM customer")
def q_scan_csv(spark, d):
    c = roles.table(spark, d, "customer")
    path = readers.scratch_dir(spark, "customer") + ".csv"
    sinks.write_csv(c, path)
    return readers.read_any(spark, path, schema=c.schema)


@register("scan_tsv", "SELECT * FROM part")
def q_scan_tsv(spark, d):
    p = roles.table(spark, d, "part")
    path = readers.scratch_dir(spark, "part") + ".tsv"
    p.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return readers.read_any(spark, path, schema=p.schema)


@register("scan_json", "SELECT * FROM orders")
def q_scan_json(spark, d):
    o = roles.table(spark, d, "orders")
    path = readers.scratch_dir(spark, "orders") + ".json"
    sinks.write_json(o, path)
    return readers.read_any(spark, path, schema=o.schema)


@register("scan_json_dir", "SELECT * FROM events")
def q_scan_json_dir(spark, d):
    """A directory of JSON-lines files plus one broken file: good rows come back, the broken one is counted."""
    e = roles.table(spark, d, "events")
    path = readers.scratch_dir(spark, "events")
    sinks.write_json(e.repartition(4), path)
    fs, p = sinks._fs(spark, f"{path}/broken.json")
    stream = fs.create(p, True)
    stream.write(bytearray(b'{"event_id": 1, "ts": \n not json at all'))
    stream.close()
    good, bad = readers.scan_json_dir(spark, path, e.schema)
    return good.select(*e.columns)


_SEG_SQL = """win AS (SELECT entity, condition, row_number() OVER (PARTITION BY entity, condition ORDER BY ts, row_id) - 1 AS idx,
                label, k FROM trials),
tix AS (SELECT entity, condition, dense_rank() OVER (PARTITION BY entity ORDER BY condition) - 1 AS trial_idx
        FROM (SELECT DISTINCT entity, condition FROM trials) x)"""


def _write_segments(spark, d) -> str:
    """Windowed trials as JSON lines, one line per window (entity, trial_idx, window_idx, label, turbulence, window)."""
    from pyspark.sql import Window

    from vitalis.plans.q_signal import windows_view

    w = windows_view(spark, d)
    trials = w.select("entity", "condition").distinct()
    tix = trials.withColumn("trial_idx", (F.dense_rank().over(Window.partitionBy("entity").orderBy("condition")) - 1)
                            .cast("bigint"))
    j = w.join(tix, ["entity", "condition"])
    window = F.struct(F.col("idx").cast("double").alias("timestamp"), F.col("vec").alias("eng_features_input"),
                      F.array(F.col("vec")).alias("ppg_input"))
    rows = j.select("entity", "trial_idx", F.col("idx").alias("window_idx"), F.col("trial_label").alias("label"),
                    F.col("condition").alias("turbulence"), window.alias("window"))
    path = readers.scratch_dir(spark, "segments")
    rows.write.mode("overwrite").json(path)
    return path


@register("load_segments", with_ctes(f"""WITH {_SEG_SQL}
SELECT w.entity, CAST(t.trial_idx AS BIGINT) AS trial_idx, w.condition,
       max(CASE WHEN w.condition = 'error' THEN NULL ELSE CAST(length(w.condition) AS DOUBLE) END) AS label,
       count(*) AS n_windows
FROM win w JOIN tix t USING (entity, condition) GROUP BY w.entity, t.trial_idx, w.condition""", "trials"))
def q_load_segments(spark, d):
    seg = readers.load_segment_lines(spark, _write_segments(spark, d))
    return seg.groupBy("entity", "trial_idx", "condition").agg(F.max("label").alias("label"),
                                                              F.count(F.lit(1)).alias("n_windows"))


@register("segment_features", with_ctes(f"""WITH {_SEG_SQL}
SELECT w.entity, CAST(t.trial_idx AS BIGINT) AS trial_idx, CAST(w.idx AS BIGINT) AS window_idx,
       [w.label, CAST(w.k AS DOUBLE)] AS features, [w.label, CAST(w.k AS DOUBLE)] AS raw
FROM win w JOIN tix t USING (entity, condition)""", "trials"))
def q_segment_features(spark, d):
    seg = readers.load_segment_lines(spark, _write_segments(spark, d))
    eng = readers.segment_features(seg, "window", "eng_features", 22)
    raw = readers.segment_features(eng.withColumnRenamed("features", "_eng"), "window", "raw").withColumnRenamed(
        "features", "raw")
    return raw.select("entity", "trial_idx", "window_idx", F.col("_eng").alias("features"), "raw")


@register("limit_entities", with_ctes("""SELECT * FROM trials
WHERE entity IN (SELECT DISTINCT entity FROM trials ORDER BY entity LIMIT 10)""", "trials"))
def q_limit_entities(spark, d):
    return readers.limit_entities(roles.trials_view(spark, d), "entity", 10)


@register("fingerprint")
def q_fingerprint(spark, d):
    """Order-independent digest of relpath:mtime over the data folder (metadata only)."""
    return readers.fingerprint(spark, d)


@register("list_files")
def q_list_files(spark, d):
    """Parquet files of the data folder whose name matches an unanchored regex."""
    return readers.list_files(spark, d, ".parquet", "^e").select("file_name", "length")
