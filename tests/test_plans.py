"""Physical plans: what is read, shuffled and kept per task."""

import re

import pytest

from batchloom import schemas
from batchloom.operators.aggregate import summarise
from batchloom.operators.enrich import enrich
from batchloom.plans.queries import QUERIES
from batchloom.sinks import tables as sink
from batchloom.sources.generate import generate_batch
from tests.conftest import TESTDATA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def planned(spark, name):
    return plan_of(QUERIES[name](spark, str(TESTDATA / "sf0.001")))


def exchanges(plan):
    return re.findall(r"Exchange (\w+)", plan)


def read_columns(plan):
    return [re.findall(r"(\w+):", schema) for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan)]


def test_summary_has_one_small_exchange(spark):
    plan = planned(spark, "summary_by_band")
    assert exchanges(plan) == ["hashpartitioning"]
    assert "partial_sum" in plan.split("Exchange")[1]
    assert read_columns(plan) == [["l_quantity", "l_extendedprice", "l_returnflag"]]


def test_batch_filter_is_pushed_down(spark, database, location):
    table = f"{database}.events"
    sink.ensure_table(spark, table, schemas.EVENTS, f"{location}/events")
    batch_id = sink.append_batch(generate_batch(spark, 100), table)
    plan = plan_of(summarise(enrich(sink.read_batch(spark, table, batch_id))))
    assert f"EqualTo(batch_id,{batch_id})" in plan
    assert read_columns(plan) == [["batch_id", "category", "quantity", "unit_price"]]


def test_batch_partition_is_pruned(spark):
    plan = planned(spark, "partitioned_readback")
    assert re.search(r"PartitionFilters: \[isnotnull\(batch_id#\d+\), \(batch_id#\d+ = b2\)\]", plan)


def test_generated_rows_are_not_shuffled(spark):
    assert exchanges(plan_of(enrich(generate_batch(spark, 1000)))) == []


def test_top_k_sorts_no_whole_input(spark):
    plan = planned(spark, "top_k")
    assert "TakeOrderedAndProject" in plan and exchanges(plan) == []


def test_count_reads_no_column(spark):
    assert read_columns(planned(spark, "row_count")) == [[]]


@pytest.mark.parametrize("name", ["tail_n", "tail_one_source", "latest_line"])
def test_tail_drops_lines_before_each_shuffle(spark, name):
    plan = planned(spark, name)
    # One round per input partition, one per part of a source, one per source.
    assert exchanges(plan) == ["hashpartitioning"] * 3
    assert re.findall(r"row_number\(\), \d+, (\w+)", plan) == ["Final", "Partial"] * 3


def test_failed_worker_tail_joins_only_tails(spark):
    plan = planned(spark, "failed_worker_tail")
    assert plan.index("LeftSemi") < plan.index("WindowGroupLimit")


def test_resource_summary_scans_once(spark):
    plan = planned(spark, "resource_summary")
    assert plan.count("FileScan") == 1 and len(exchanges(plan)) == 2


def test_streak_guard_never_groups_polls_by_run_alone(spark):
    plan = planned(spark, "streak_guard_one_run")
    keys = re.findall(r"Exchange \w+\((.*?), 8\)", plan)
    # By run alone meet only merged rows and the summaries of stretches.
    by_run = [key for key in keys if len(re.findall(r"#\d+", key)) == 1]
    assert by_run and all("run_id" in key for key in by_run)
    for below in re.findall(r"Exchange hashpartitioning\(run_id#\d+, 8\).*\n(.*)", plan):
        assert "HashAggregate(keys=[run_id" in below or "partial" in below or "Aggregate" in below
    # Polls are neither gathered into arrays nor sorted by run.
    assert "collect_list" not in plan
