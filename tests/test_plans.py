"""Structural plan properties the design relies on (guards against regressions)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF0001


def plan(spark, name):
    return entry.queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["log_normalise", "redact", "error_signatures", "detect_all", "pod_status"])
def test_no_row_python_udfs(spark, name):
    p = plan(spark, name)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_search_is_one_tiled_plan(spark):
    p = plan(spark, "memory_search_relaxed")
    assert "FlatMapCoGroupsInPandas" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_prefixes_meet_by_an_equi_join(spark):
    assert "BroadcastNestedLoopJoin" not in plan(spark, "k8s_events")


def test_sections_need_no_shuffle(spark):
    assert "Exchange" not in plan(spark, "split_sections")


def test_citations_take_one_join(spark):
    p = plan(spark, "ground_hypotheses")
    # the other join makes the hypotheses out of the test tables
    assert p.count("SortMergeJoin") + p.count("BroadcastHashJoin") + p.count("ShuffledHashJoin") == 2 and "Generate" not in p


def test_replay_has_no_pair_joins(spark):
    p = plan(spark, "replay")
    assert "CartesianProduct" not in p
    # the only nested-loop join is the one-row replay-end broadcast
    assert p.count("BroadcastNestedLoopJoin") <= 1


def test_filters_reach_the_scan(spark):
    p = plan(spark, "log_search")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p
    p = plan(spark, "order_lookup")
    assert "EqualTo(o_orderkey,4242)" in p


def test_partition_pruning_on_label_partitions(spark):
    q = entry.queries()["sink_log_labels"](spark, SF0001).filter("namespace = 'prod' AND level = 'error'")
    p = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in p and "(namespace#" in p
