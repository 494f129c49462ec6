"""Plans that must hold at scale: filters and columns reach the scan, joins are equi-joins, top-k is bounded."""

import pytest

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "findings_list")
    assert "GreaterThanOrEqual(ts" in p and "value" not in p.split("ReadSchema")[1]
    p = plan(spark, "tautology")
    assert "GreaterThan(l_quantity" in p and "l_extendedprice" not in p.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["log_tail", "prefix_search", "reservoir_sample", "semantic_search", "bm25_search"])
def test_top_k_is_bounded(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["degree", "coupling", "grpc_link", "http_link", "topic_link", "def_use", "span_coverage", "same_as", "tests_walkup", "mention_link", "longest_prefix_module", "diff_join", "payload_drift"])
def test_no_nested_loops(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["histograms", "degree", "module_aggregate", "activity_rollup"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    assert "partial_count" in plan(spark, name)


def test_native_queries_run_no_python(spark):
    for name in ("bm25_search", "semantic_search", "http_link", "def_use", "community_names", "tokenize", "coupling"):
        assert "Python" not in plan(spark, name) and "Arrow" not in plan(spark, name)


def test_migrations_of_equal_names_come_in_order_of_id(spark, tmp_path):
    from datetime import datetime

    rows = [(k * 1_000_000 + j, datetime(2024, 1, 1 + j)) for k in (5, 4, 3, 2, 1) for j in (2, 1, 3)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.id: r.precedes for r in catalog.queries()["migration_order"](spark, str(tmp_path)).collect()}
    order = [i for _, _, i in sorted((d, k % 1_000_000, k) for k, d in rows)]
    assert got == dict(zip(order, [None, *order[:-1]], strict=True))
