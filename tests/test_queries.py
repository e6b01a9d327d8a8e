"""Every registered query with SQL equals DuckDB on the smallest shared tables."""

import os

import pytest

import __spark_entry__ as entry_points
from oracle_check import compare, duck

SF = os.environ.get("TABLEWISE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")

# One per family; set TABLEWISE_TEST_ALL=1 for every query.
SAMPLE = (
    "cross_tab", "numeric_profile", "duplicate_sample", "corr_kendall", "trend_stats", "activation_profile", "detect_all", "business_extremes",
    "column_semantics", "run_diff", "kg_dimensions", "recurring_patterns", "decision_rank", "feedback_summary", "text_tagging", "catalog_profile",
    "src_excel", "rca_components_keyed", "rca_rank_keyed", "rca_related_keyed", "top_anomalies",
    "rate_breach_sliding", "parity_rows", "table_parity", "fk_by_value", "graph_store", "graph_from_run",
)


def names():
    return list(entry_points.oracle_sql()) if os.environ.get("TABLEWISE_TEST_ALL") else list(SAMPLE)


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_registry():
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(queries)
    plain = {name for name in set(queries) - set(sql) if queries[name].__module__.startswith("tablewise.plans")}
    assert plain == set()


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["step", "item", "value"] and df.count() > 0


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, connection, name):
    assert compare(entry_points.queries()[name](spark, SF), connection, entry_points.oracle_sql()[name]) == ""
