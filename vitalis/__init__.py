"""vitalis: Spark-native operators for trial tables and windowed signals."""

from __future__ import annotations

import os

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package(spark) -> None:
    """Make this package importable by the Python workers of ``spark`` (idempotent).

    Arrow / pandas UDFs reference functions of this package, which the workers
    import by name.  Locally the package root is added to the workers'
    PYTHONPATH; on a cluster ship the package with ``--py-files`` as usual.
    """
    env = spark.sparkContext.environment
    cur = env.get("PYTHONPATH", "")
    parts = [p for p in cur.split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT] + parts)
