"""The driver contract, and a choice of queries against their SQL."""

import pytest

import __spark_entry__ as entry
from gapwright.bindings.catalog import ORACLE, QUERIES
from gapwright.bindings.check import compare, database

FOLDER = "/root/testdata/sf0.001"
CHOSEN = (
    "inline_values", "scenario_rows", "sparse_row_filter", "region_label", "edit_validate", "join_full_outer", "fuzzy_pairs",
    "contains_join", "median_exact", "dense_rank_share", "pivot_top3", "district_centroid", "curate_facility", "curation_audit",
    "correct_typos", "dq_metrics", "dq_gaps", "merge_gaps", "resync_bridge", "scenario_replace", "gap_table", "gap_table_scenario",
    "scenario_impact", "infer_labels", "udf_classify", "edit_stream", "latest_status", "suggest_labels", "category_profile",
    "category_exploration", "district_detail", "scenario_compare", "dq_refresh", "distinct_counts", "ordered_labels", "udf_parse",
)


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert "desert_risk_score" in df.columns and 0 < df.count() <= 25


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, name):
    assert name in QUERIES and name in ORACLE
    assert compare(spark, con, FOLDER, name) is None


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["topk"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "o_orderpriority" not in plan.split("ReadSchema", 1)[1]
    plan = QUERIES["param_echo"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,250000.0)" in plan
