"""Streaming use of the operators.

The reference has no streaming.  What carries over unchanged: every fitted
step (``transform`` of OutlierRemover / Imputer / Scaler / PowerTransformer /
FunctionStep / Preprocessor), the scalar and array functions, and the signal
UDFs are stateless column expressions, so they apply to a streaming
DataFrame as they are.  Time-stamped windows take a watermark so that state
for closed windows is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from vitalis.operators.signal_ops import time_windows


def apply_fitted(stream: DataFrame, steps: Sequence) -> DataFrame:
    """Apply already-fitted steps (fit on a batch) to a streaming frame; each step must be stateless."""
    out = stream
    for s in steps:
        out = s.transform(out)
    return out


def windowed_stream(stream: DataFrame, ts: str, size: str, step: str, watermark: str,
                    keys: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """Hopping-window counts / means with a watermark (append mode emits each window once)."""
    return time_windows(stream, ts, size, step, keys, value, watermark=watermark)


def run_to_memory(spark: SparkSession, df: DataFrame, name: str, mode: str = "append",
                  checkpoint: str | None = None) -> DataFrame:
    """Drive a streaming query to completion over the available input (tests / back-fills)."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
