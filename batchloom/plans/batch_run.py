"""The whole run: append, read back, enrich, summarise, audit, publish, read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from batchloom import fixed_values as fixed
from batchloom import schemas
from batchloom.operators.aggregate import summarise
from batchloom.operators.checks import expect_count, expect_schema
from batchloom.operators.enrich import enrich, tag_batch
from batchloom.plans.staging import stage
from batchloom.sinks.tables import (
    DEFAULT_FORMAT,
    append,
    ensure_table,
    expect_new_batch,
    new_batch_id,
    partitions_last,
    read_batch,
    read_summary,
    replace_batch,
)
from batchloom.sources.catalog import resolve_tables
from batchloom.sources.generate import generate_batch


@dataclass(frozen=True)
class RunTables:
    """The input and the summary table of a run, with their locations."""

    events: str
    summary: str
    events_location: str
    summary_location: str
    fmt: str = DEFAULT_FORMAT
    partition_events_by_batch: bool = True
    partition_summary_by_batch: bool = False


@dataclass(frozen=True)
class RunReport:
    batch_id: str
    input_rows: int
    groups: int
    summary: DataFrame


def audit(summary: DataFrame, count: str = "event_count") -> DataFrame:
    """Rows that went into a summary and its number of groups, as one row.

    Grouping drops no row, so the sum of the group counts is the input row count and the
    input need not be read again.
    """
    return summary.agg(
        F.coalesce(F.sum(count), F.lit(0)).alias("input_rows"),
        F.count("*").alias("group_count"),
    )


def run_batch(
    spark: SparkSession,
    events: DataFrame,
    tables: RunTables,
    *,
    batch_id: str | None = None,
    expected_rows: int | None = None,
    expected_groups: int | None = None,
    rerun: bool = False,
) -> RunReport:
    """Append ``events`` as a batch, publish its audited summary and read that back.

    ``rerun`` runs a batch again whose earlier run died: rows and summary take the place of what
    that one has left under the id. Both tables must be partitioned by batch for that.

    The batch is written once to the shared folder, counted on the way and summarised there.
    Only when its id is new, its rows and groups are as many as expected and the summary
    accounts for every row does it reach the input table, and its summary the summary table.
    So a rejected run leaves both tables as they were.
    """
    by_batch = ["batch_id"] if tables.partition_events_by_batch else []
    input_schema = partitions_last(schemas.EVENTS, by_batch)
    ensure_table(spark, tables.events, input_schema, tables.events_location, tables.fmt, by_batch)
    by_batch = ["batch_id"] if tables.partition_summary_by_batch else []
    saved_schema = partitions_last(schemas.SUMMARY, by_batch)
    ensure_table(spark, tables.summary, saved_schema, tables.summary_location, tables.fmt, by_batch)
    resolve_tables(spark, [tables.events, tables.summary])

    if rerun and batch_id is None:
        raise ValueError("a rerun needs the id of its batch")
    if rerun and not (tables.partition_events_by_batch and tables.partition_summary_by_batch):
        raise ValueError("a rerun needs tables that are partitioned by batch")
    if batch_id is not None and not rerun:
        expect_new_batch(spark, tables.events, batch_id)
    batch_id = batch_id or new_batch_id()
    written = Observation()
    counted = events.observe(written, F.count(F.lit(1)).alias("rows"))
    batch = stage(tag_batch(counted, batch_id))
    rows = written.get["rows"]
    if expected_rows is not None:
        expect_count("rows written", rows, expected_rows)

    enriched = expect_schema(enrich(batch), fixed.ENRICHED_TYPES)
    summary = stage(summarise(enriched))
    found = audit(summary).first()
    expect_count("rows summarised", found["input_rows"], rows)
    if expected_groups is not None:
        expect_count("summary groups", found["group_count"], expected_groups)

    _put(batch, tables.events, batch_id, rerun)
    kept = read_batch(spark, tables.events, batch_id)
    expect_count("rows appended", kept.count(), rows)
    _put(summary, tables.summary, batch_id, rerun)
    saved = read_summary(spark, tables.summary, batch_id)
    expect_count("saved summary rows", saved.count(), found["group_count"])
    return RunReport(batch_id, rows, found["group_count"], saved)


def _put(rows: DataFrame, table: str, batch_id: str, rerun: bool) -> None:
    if rerun:
        replace_batch(rows, table, batch_id)
    else:
        append(rows, table)


def run_generated(
    spark: SparkSession,
    tables: RunTables,
    rows: int = fixed.DEFAULT_ROWS,
    partitions: int | None = None,
) -> RunReport:
    """The run on a generated batch, with its row and category counts checked."""
    return run_batch(
        spark,
        generate_batch(spark, rows, partitions),
        tables,
        expected_rows=rows,
        expected_groups=min(rows, len(fixed.CATEGORIES)),
    )
