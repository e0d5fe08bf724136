"""Selection by sketches gives the exact quantiles, and no plan keeps a count per value."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("accuracy,keep", [(10_000, 100_000), (10_000, 0), (50, 0)])
def test_quantiles_are_exact(spark, accuracy, keep):
    r = random.Random(1)
    x = [r.gauss(0, 1) for _ in range(3000)]
    y = [float(r.randrange(5)) for _ in range(3000)]  # ties
    z = [None if i % 3 else float(i) for i in range(3000)]
    w = [float("nan") if i % 2 else 7.0 for i in range(3000)]
    df = spark.createDataFrame(list(zip(x, y, z, w, strict=True)), "x double, y double, z double, w double").withColumn("e", F.lit(None).cast("double"))
    got = exact_quantiles(df, {c: c for c in "xyzwe"}, PROBS, accuracy, keep)
    for c, v in (("x", x), ("y", y), ("z", [a for a in z if a is not None]), ("w", [7.0])):
        assert got[c] == pytest.approx(list(np.quantile(v, PROBS)), abs=1e-12)
    assert got["e"] is None


def test_quantiles_of_few_rows(spark):
    for n in (1, 2, 3, 7):
        v = [float(i * i) for i in range(n)]
        got = exact_quantiles(spark.createDataFrame([(a,) for a in v], "x double"), {"x": F.col("x") + 1}, PROBS)
        assert got["x"] == pytest.approx([a + 1 for a in np.quantile(v, PROBS)])
