"""Whole runs: results, audits before publishing, repeated batches."""

import pytest
from pyspark.sql import functions as F

from batchloom.operators.checks import CheckFailed
from batchloom.plans.batch_run import RunTables, audit, run_batch, run_generated
from batchloom.plans.sales_run import run_sales
from batchloom.sinks.tables import append_batch
from batchloom.sources.generate import generate_batch
from tests.test_batches import GENERATED


@pytest.fixture(params=[False, True], ids=["flat", "by_batch"])
def tables(request, database, location):
    return RunTables(
        f"{database}.events",
        f"{database}.summary",
        f"{location}/events",
        f"{location}/summary",
        partition_events_by_batch=request.param,
    )


def test_generated_run(spark, tables):
    report = run_generated(spark, tables)
    assert (report.input_rows, report.groups) == (100000, 4)
    assert [tuple(row)[1:] for row in report.summary.collect()] == GENERATED
    assert audit(report.summary).first() == (100000, 4)
    # A second run adds its own batch and leaves the first alone.
    second = run_generated(spark, tables, 3, 2)
    assert (second.input_rows, second.groups) == (3, 3)
    assert second.batch_id != report.batch_id
    assert report.summary.count() == 4
    assert spark.table(tables.summary).count() == 7


@pytest.mark.parametrize("expected", [{"expected_rows": 99}, {"expected_groups": 5}])
def test_failed_check_publishes_nothing(spark, tables, expected):
    with pytest.raises(CheckFailed):
        run_batch(spark, generate_batch(spark, 100), tables, **expected)
    assert spark.table(tables.summary).count() == 0
    assert spark.table(tables.events).count() == 0


def test_repeated_batch_id_is_refused(spark, tables):
    """The same id twice would double the batch; it is refused before a row is written."""
    batch = generate_batch(spark, 100)
    run_batch(spark, batch, tables, batch_id="b1")
    with pytest.raises(CheckFailed, match="already holds batch b1"):
        run_batch(spark, batch, tables, batch_id="b1")
    with pytest.raises(CheckFailed, match="already holds batch b1"):
        append_batch(batch, tables.events, "b1")
    assert spark.table(tables.events).count() == 100
    assert spark.table(tables.summary).agg(F.sum("event_count")).first()[0] == 100


def test_empty_batch(spark, tables):
    report = run_batch(spark, generate_batch(spark, 10).limit(0), tables)
    assert (report.input_rows, report.groups) == (0, 0)


def test_sales_run(spark, database, location):
    table = f"spark_catalog.{database}.sales"
    run_sales(spark, table, f"{location}/sales")
    report = run_sales(spark, table, f"{location}/sales")
    assert [row["product_id"] for row in report.large.collect()] == [102, 101, 301]
    assert [row["product_id"] for row in report.lines.collect()] == [102, 101, 301, 202, 201]
    assert [tuple(row) for row in report.summary.collect()] == [
        ("electronics", 2, 3, 9997.0, 3749.0),
        ("household", 1, 4, 1800.0, 450.0),
        ("grocery", 2, 8, 1350.0, 185.0),
    ]
    products = [row["product_id"] for row in report.all_rows.collect()]
    assert products == [101, 101, 102, 102, 201, 201, 202, 202, 301, 301]


def test_rerun_replaces_what_a_dead_run_left(spark, database, location):
    tables = RunTables(
        f"{database}.events", f"{database}.summary", f"{location}/events", f"{location}/summary",
        partition_summary_by_batch=True,
    )
    rows = generate_batch(spark, 1_000, 4)
    run_batch(spark, rows.where("event_id < 10"), tables, batch_id="b")
    run_batch(spark, rows, tables, batch_id="other")
    with pytest.raises(CheckFailed):
        run_batch(spark, rows, tables, batch_id="b")
    for _ in range(2):
        report = run_batch(spark, rows, tables, batch_id="b", rerun=True)
        assert (report.input_rows, report.groups) == (1_000, 4)
    assert spark.table(tables.events).count() == 2_000
    assert spark.table(tables.summary).count() == 8
    with pytest.raises(ValueError):
        run_batch(spark, rows, tables, rerun=True)
    flat = RunTables(*(f"{database}.{t}" for t in ("e2", "s2")), f"{location}/e2", f"{location}/s2")
    with pytest.raises(ValueError):
        run_batch(spark, rows, flat, batch_id="b", rerun=True)
