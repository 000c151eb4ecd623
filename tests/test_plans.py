"""Plans: no pairwise joins anywhere, filters and columns reach the scan."""

import re

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from pactframe.plans.registry import all_queries
from pactframe.operators import jobs, ops
from pactframe.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"
# Streams write something while they are built, so their plan is only a read.
EAGER = {k for k in all_queries() if k.startswith("stream_")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# One row of totals joined to another would be the only harmless use; there is none.
@pytest.mark.parametrize("key", sorted(set(all_queries()) - EAGER))
def test_no_pairwise_join(spark, key):
    plan = plan_of(all_queries()[key](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan


def test_time_bound_reaches_the_scan(spark):
    plan = plan_of(ops.ops_health(Tables(spark, FOLDER)("dom_telemetry"), "2024-01-20"))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThan\(ts,", plan)
    assert "props" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_top_jobs_do_not_sort_everything(spark):
    plan = plan_of(jobs.claimable_jobs(Tables(spark, FOLDER)("dom_jobs"), "2024-01-20", n=3))
    assert "TakeOrderedAndProject" in plan


def test_rank_limits_before_the_shuffle(spark):
    plan = plan_of(all_queries()["claimable_per_account"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") == 2


# Shuffles in the plan before it runs, with what was stored on the way left out; one of fk_orphans groups the lines of the audit binding.
@pytest.mark.parametrize("key, most", [("analysis_policy_snapshot", 15), ("consent_asof", 12), ("fk_orphans", 5), ("erase_accounts", 40)])
def test_few_shuffles(spark, key, most):
    plan = plan_of(all_queries()[key](spark, FOLDER))
    assert len(re.findall(r"^[ :+|*()0-9-]*Exchange ", plan, re.M)) <= most, plan


def test_points_are_read_without_a_window(spark):
    plan = plan_of(all_queries()["tiered_points"](spark, FOLDER))
    assert "Window" not in plan and "Exchange" not in plan


def test_search_reads_postings_and_no_text(spark):
    plan = plan_of(all_queries()["search_match"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^]]*In\(term", plan) and "extracted_text" not in plan and "Python" not in plan


def test_newest_rows_are_limited_before_the_shuffle(spark):
    plan = plan_of(all_queries()["latest_analysis"](spark, FOLDER))
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") == 2
