"""KNN imputation through cells: the same result as over all donors, with fewer pairs looked at."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalis.operators import clean, knncells

COLS = ["a", "b", "c", "d"]


def frame(seed: int, n: int, hot: bool = False) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    x[:, 2] = np.floor(x[:, 2] * 2)  # ties
    if hot:
        x[: n // 2] = x[0]  # a third of all rows and more in one cell
    x[r.random(x.shape) < 0.08] = np.nan
    x[-1] = np.nan
    t = pd.DataFrame(x, columns=COLS)
    t.insert(0, "id", np.arange(n))
    return t


def filled(df) -> pd.DataFrame:
    return df.toPandas().sort_values("id").reset_index(drop=True)[["id", *COLS]]


@pytest.mark.parametrize("n, hot, cell, block", [(600, False, 4, 20_000), (600, True, 4, 50), (40, False, 4, 20_000), (3, False, 4, 20_000)])
def test_cells_give_the_same_donors(spark, n, hot, cell, block):
    df = spark.createDataFrame(frame(n, n, hot)).withColumn("_cell", F.lit("x"))
    got = knncells.knn_impute_lsh(df.drop("_cell"), "id", COLS, 3, cell=cell, wider=3, block=block)
    pd.testing.assert_frame_equal(filled(got), filled(clean.knn_impute(df.drop("_cell"), "id", COLS, 3)))


def test_donors_from_training_rows_and_rare_columns(spark):
    train, new = frame(5, 500), frame(6, 200)
    train.loc[4:, "d"] = np.nan  # fewer donors than k
    a, b = spark.createDataFrame(train), spark.createDataFrame(new)
    pd.testing.assert_frame_equal(filled(knncells.knn_impute_lsh(b, "id", COLS, 5, donors=a, cell=4)), filled(clean.knn_impute(b, "id", COLS, 5, donors=a)))


def test_no_row_and_nothing_missing(spark):
    df = spark.createDataFrame(frame(7, 50))
    assert knncells.knn_impute_lsh(df.limit(0), "id", COLS).count() == 0
    whole = df.dropna()
    pd.testing.assert_frame_equal(filled(knncells.knn_impute_lsh(whole, "id", COLS)), filled(whole))


def test_cells_meet_few_pairs_and_are_certain_for_most(spark):
    """Work below receivers x donors: pairs that meet at the first level, and the share of receivers it settles."""
    r = np.random.default_rng(9)
    t = pd.DataFrame(r.normal(size=(6000, 4)), columns=COLS)
    t.loc[r.random(6000) < 0.1, "c"] = np.nan
    t.loc[r.random(6000) < 0.1, "d"] = np.nan
    t.insert(0, "id", np.arange(6000))
    t["c"] *= 0.05
    t["d"] *= 0.05
    f = clean.number_features(spark.createDataFrame(t), "id", COLS)
    left = f.where(clean.any_missing(COLS))
    b = knncells._Bins(f, COLS, int(np.sqrt(6000 / 16)))
    recv = knncells._probes(left, b, COLS)
    keys = [tuple(x[0]) for x in recv.select("_keys").distinct().collect()]
    probes = recv.select("_rid", *COLS, F.explode("_cells").alias("_cell"))
    placed = knncells._placed(f, b, COLS, keys)
    met = probes.groupBy("_cell").agg(F.count(F.lit(1)).alias("r")).join(placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("d")), "_cell").agg(F.sum(F.col("r") * F.col("d"))).first()[0]
    assert met < 0.1 * left.count() * 6000
    rs, ds = knncells.meetings(probes, placed)
    by = ["_cell", "_rb", "_db"]
    found = clean.nearest(rs.groupBy(*by).cogroup(ds.groupBy(*by)).applyInPandas(lambda x, y: clean.topk_frame(x, y, COLS, 3), "_rid long, _col int, _dist double, _did long, _val double"), 3)
    assert knncells._certain(found, recv, COLS, 3).count() > 0.5 * left.count()


def test_many_pairs_go_through_cells(spark, monkeypatch):
    """Beyond PAIRS the exact result with near donors looked at first; ids repeated, and a row without any value."""
    t = frame(11, 3000)
    t.loc[:99, "id"] = t.loc[100:199, "id"].to_numpy()
    df = spark.createDataFrame(t)
    want = clean.knn_impute(df, "id", COLS, 3)
    monkeypatch.setattr(clean, "PAIRS", 1000)
    left = []
    meet = knncells.block_candidates
    monkeypatch.setattr(knncells, "block_candidates", lambda recv, *a, **k: left.append(recv.count()) or meet(recv, *a, **k))
    monkeypatch.setattr(knncells.knn_impute_lsh, "__defaults__", (5, None, 8, 3, 3, knncells.BLOCK))
    got = clean.knn_impute(df, "id", COLS, 3)
    order = lambda x: x.toPandas().sort_values(["id", *COLS]).reset_index(drop=True)[["id", *COLS]]
    pd.testing.assert_frame_equal(order(got), order(want))
    assert sum(left) < t[COLS].isna().any(axis=1).sum()
