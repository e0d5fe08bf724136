"""Physical-plan properties that matter at scale (checked on the small tables)."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from vitalis.operators import stats
from vitalis.plans import roles

QUERIES = E.queries()
SQL = E.oracle_sql()
#: Their frames are a model's answers or a few facts; what they fit has tests of its own.
FITTED = set("""rf gbt rf_classifier svm mlp elastic logistic model_evaluate pipeline_model importance select_features
permutation_importance cross_validate grid_search random_search learning_curve ordinal_fit ensemble_fit stacking
isolation_forest group_cv classify_experiment normalized_experiment op13_setsketch op11_spelling""".split())


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(SQL) - FITTED))
def test_no_cartesian_and_no_unpartitioned_window(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    phys, logical = _physical(df), _optimized(df)
    assert "CartesianProduct" not in phys and "BroadcastNestedLoopJoin" not in phys, name
    assert "Join Cross" not in logical, name
    assert not re.search(r"Window \[.*\], \[\], \[", phys), f"{name}: window without partition keys"


def test_scan_pushdown_and_pruning(spark):
    df = QUERIES["scan_parquet"](spark, SF_SMALL)
    text = df._sc._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(l_discount), IsNotNull(l_returnflag), GreaterThan(l_discount,0.05)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_shipdate" not in schema and "l_partkey" not in schema


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_explode_no_pairs(spark, monkeypatch, method):
    """What is added up comes straight from the tasks' matrices: no row per pair of columns is made."""
    from vitalis.operators import gram, rankcorr

    seen = []
    for module in (gram, rankcorr):
        monkeypatch.setattr(module, "added", lambda blocks, f=gram.added: seen.append(blocks) or f(blocks))
    o = roles.ofeat_view(spark, SF_SMALL)
    cols = ["qty", "price", "disc", "tax", "o_totalprice"]
    (stats.corr_pearson if method == "pearson" else stats.corr_spearman)(o, cols)
    plan = _physical(seen[0])
    assert "MapInArrow" in plan
    # the ranks go back to their rows from one row per (row, column); products need no such step
    assert plan.count("Generate") == (1 if method == "spearman" else 0)
    assert plan.count("Exchange hashpartitioning") <= 6


@pytest.mark.parametrize("name", ["entity_zscore", "group_baseline", "percentile_of_score", "normalize_label_zscore"])
def test_group_statistics_use_aggregate_and_join(spark, name):
    plan = _physical(QUERIES[name](spark, SF_SMALL))
    assert "Window" not in plan
    assert "HashAggregate" in plan or "ObjectHashAggregate" in plan


@pytest.mark.parametrize("name", ["first_n_per_group"])
def test_group_limit_is_applied_before_the_shuffle(spark, name):
    plan = _physical(QUERIES[name](spark, SF_SMALL))
    assert plan.count("WindowGroupLimit") >= 2   # partial (map side) and final
