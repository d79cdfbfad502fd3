"""The registered queries: each runs operators over whole given tables.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame. ``oracles.py`` holds the SQL
that must give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom import fixed_values as fixed
from batchloom import schemas
from batchloom.functions import expressions as X
from batchloom.functions.phases import is_success, is_terminal, phase_or_pending
from batchloom.operators import logs, ordering, status
from batchloom.operators.aggregate import count_rows, summarise
from batchloom.operators.enrich import current_batch, enrich, large_lines, tag_batch
from batchloom.operators.hot_keys import repartition_hot
from batchloom.operators.selection import top_k as top_k_rows
from batchloom.plans import stand_ins as given
from batchloom.plans.batch_run import RunReport, RunTables, audit, run_batch
from batchloom.plans.sales_run import SalesReport, report_sales
from batchloom.plans.staging import scratch_location
from batchloom.sinks import tables as sink
from batchloom.sources import catalog
from batchloom.sources.generate import events_from_ids, generate_batch, sales_batch
from batchloom.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _fresh_database(spark: SparkSession) -> tuple[str, str]:
    """A new database in the shared folder: its name and location."""
    name = f"batches_{uuid.uuid4().hex}"
    location = scratch_location(spark, name)
    sink.ensure_database(spark, name, location)
    return name, location


def _fresh_table(spark: SparkSession, schema, partitioned_by=(), bloom_filters=None) -> str:
    database, location = _fresh_database(spark)
    table = f"{database}.rows"
    sink.ensure_table(
        spark, table, schema, f"{location}/rows",
        partitioned_by=partitioned_by, bloom_filters=bloom_filters,
    )
    return table


def _run(spark: SparkSession, sf_dir: str, *, partitioned: bool = False) -> RunReport:
    database, location = _fresh_database(spark)
    tables = RunTables(
        f"{database}.events",
        f"{database}.summary",
        f"{location}/events",
        f"{location}/summary",
        partition_events_by_batch=partitioned,
    )
    run_batch(spark, given.order_rows(spark, sf_dir), tables, batch_id="b2")
    return run_batch(spark, given.event_rows(spark, sf_dir), tables, batch_id="b1")


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(given.event_batch(spark, sf_dir))


# Sources


@query
def external_table_scan(spark, sf_dir):
    """A table over files that already exist, read by its three-part name."""
    database, _ = _fresh_database(spark)
    schema = given.read(spark, sf_dir, "lineitem").schema
    table = f"spark_catalog.{database}.lineitem"
    sink.ensure_table(spark, table, schema, f"{sf_dir}/lineitem.parquet")
    resolved = catalog.resolve_tables(spark, [table])
    return catalog.scan(spark, resolved[table].name)


@query
def sql_table_scan(spark, sf_dir):
    """Projection, CASE and parametrised filter in SQL over a two-part table name."""
    table = _fresh_table(spark, schemas.EVENTS)
    sink.append_batch(given.event_rows(spark, sf_dir), table, "b1")
    sink.append_batch(given.order_rows(spark, sf_dir), table, "b2")
    return spark.sql(
        """
        SELECT event_id, category, CAST(quantity AS DOUBLE) * unit_price AS line_total,
               CASE WHEN quantity >= :limit THEN :above ELSE :below END AS quantity_band
        FROM IDENTIFIER(:t) WHERE batch_id = :b
        """,
        args={
            "t": table, "b": "b1",
            "limit": fixed.BULK_FROM, "above": fixed.BULK, "below": fixed.STANDARD,
        },
    )


@query
def zero_row_probe(spark, sf_dir):
    """A registered table resolved by name, without reading a row."""
    database, _ = _fresh_database(spark)
    schema = given.read(spark, sf_dir, "lineitem").schema
    sink.ensure_table(spark, f"{database}.lineitem", schema, f"{sf_dir}/lineitem.parquet")
    return catalog.probe(spark, f"{database}.lineitem")


def _generated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated rows whose ids are order keys."""
    orders = given.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    last = orders.agg(F.max("event_id")).first()[0]
    return generate_batch(spark, (last or 0) + 1).join(orders, "event_id", "left_semi")


@query
def generate_rows(spark, sf_dir):
    """Generated rows up to the last order key, kept where an order has the id."""
    return _generated_orders(spark, sf_dir)


@query
def generate_summary(spark, sf_dir):
    """Summary of the generated rows that are orders."""
    batch = tag_batch(_generated_orders(spark, sf_dir), "b1")
    return summarise(enrich(batch), average=True, exact=True)


@query
def events_from_keys(spark, sf_dir):
    """The generator's columns from the keys of a table instead of a range."""
    orders = given.read(spark, sf_dir, "orders")
    return events_from_ids(orders, F.col("o_orderkey"), "b1")


@query
def literal_rows_append(spark, sf_dir):
    """The sample rows inserted as literals behind a large batch; all batches summarised."""
    table = _fresh_table(spark, schemas.SALES)
    products = given.event_batch(spark, sf_dir).withColumnRenamed("event_id", "product_id")
    sink.append(products, table)
    sample = [("b2", *row, Decimal(f"{price:.2f}")) for *row, price in fixed.SALES_ROWS]
    sink.insert_values(spark, table, sample)
    return summarise(
        enrich(spark.table(table)), count_as="product_count", average=True, exact=True
    )


# Sinks


@query
def append_readback(spark, sf_dir):
    """Two batches appended; the summary of the first one read back."""
    table = _fresh_table(spark, schemas.EVENTS)
    sink.append_batch(given.event_rows(spark, sf_dir), table, "b1")
    sink.append_batch(given.order_rows(spark, sf_dir), table, "b2")
    return summarise(enrich(sink.read_batch(spark, table, "b1")))


@query
def append_two_batches(spark, sf_dir):
    """Two batches appended; both summarised side by side."""
    table = _fresh_table(spark, schemas.EVENTS)
    sink.append_batch(given.event_rows(spark, sf_dir), table, "b1")
    sink.append_batch(given.order_rows(spark, sf_dir), table, "b2")
    return summarise(enrich(spark.table(table)))


@query
def partitioned_readback(spark, sf_dir):
    """The rows of one batch from a table partitioned by batch."""
    schema = sink.partitions_last(schemas.EVENTS, ["batch_id"])
    table = _fresh_table(spark, schema, ["batch_id"])
    sink.append_batch(given.event_rows(spark, sf_dir), table, "b1")
    sink.append_batch(given.order_rows(spark, sf_dir), table, "b2")
    return sink.read_batch(spark, table, "b2")


@query
def replaced_batch_readback(spark, sf_dir):
    """A batch of which a part was left behind, written again; the other batch stays."""
    schema = sink.partitions_last(schemas.EVENTS, ["batch_id"])
    table = _fresh_table(spark, schema, ["batch_id"])
    rows = given.event_rows(spark, sf_dir)
    sink.append_batch(given.order_rows(spark, sf_dir), table, "b2")
    sink.append_batch(rows.where("quantity < 20"), table, "b1")
    sink.replace_batch(rows, table, "b1")
    return summarise(enrich(spark.table(table)))


@query
def mixed_files_readback(spark, sf_dir):
    """One of many batches that lie in the same files of a flat table, found by its filter."""
    table = _fresh_table(spark, schemas.EVENTS, bloom_filters={"batch_id": 1_000})
    orders = given.read(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("batch_id"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderpriority").alias("category"),
        F.lit(1).alias("quantity"),
        F.col("o_totalprice").alias("unit_price"),
    )
    sink.append(orders, table)
    return sink.read_batch(spark, table, "c77")


@query
def insert_select(spark, sf_dir):
    """Positional INSERT of a query result; the inserted batch read back."""
    table = _fresh_table(spark, schemas.EVENTS)
    orders = given.read(spark, sf_dir, "orders")
    sink.append_batch(given.event_rows(spark, sf_dir), table, "b2")
    sink.insert_select(events_from_ids(orders, F.col("o_orderkey"), "b1"), table)
    return sink.read_batch(spark, table, "b1")


# Projections and filters


@query
def select_columns(spark, sf_dir):
    """Named columns, a constant and a renamed expression of a table."""
    lineitem = given.read(spark, sf_dir, "lineitem")
    return tag_batch(
        lineitem.select(
            F.col("l_orderkey").alias("event_id"),
            "l_linenumber",
            (F.col("l_quantity") * F.col("l_extendedprice")).alias("line_total"),
        ),
        "b1",
    )


@query
def enrich_batch(spark, sf_dir):
    return _enriched(spark, sf_dir)


@query
def filter_line_total(spark, sf_dir):
    large = large_lines(_enriched(spark, sf_dir), 1_000_000)
    return large.select("event_id", "line_total")


@query
def filter_large_sales(spark, sf_dir):
    """The fixed limit of the sales report, on five selected columns."""
    large = large_lines(_enriched(spark, sf_dir))
    return large.select("event_id", "category", "quantity", "unit_price", "line_total")


@query
def filter_batch(spark, sf_dir):
    """One batch by a stored column, from the rows of two tables."""
    lines = given.read(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "batch_id")
    orders = given.read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "batch_id")
    both = lines.select("batch_id", F.col("l_orderkey").alias("event_id")).unionByName(
        orders.select("batch_id", F.col("o_orderkey").alias("event_id"))
    )
    return current_batch(both, "F")


# Aggregates


@query
def summary_by_category(spark, sf_dir):
    return summarise(_enriched(spark, sf_dir), average=True, ordered=True)


@query
def category_summary(spark, sf_dir):
    return summarise(
        _enriched(spark, sf_dir), ["category"], count_as="product_count", average=True
    )


@query
def summary_by_band(spark, sf_dir):
    """Both bands of each category, with exact sums."""
    keys = ["batch_id", "category", "quantity_band"]
    return summarise(_enriched(spark, sf_dir), keys, average=True, exact=True)


@query
def summary_by_part(spark, sf_dir):
    """Many groups, with exact sums and averages."""
    lineitem = given.read(spark, sf_dir, "lineitem").select(
        F.lit("b1").alias("batch_id"),
        F.col("l_partkey").cast("string").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("unit_price"),
    )
    return summarise(enrich(lineitem), average=True, exact=True)


@query
def row_count(spark, sf_dir):
    return count_rows(given.read(spark, sf_dir, "lineitem"))


@query
def audit_counts(spark, sf_dir):
    return audit(summarise(_enriched(spark, sf_dir)))


# Sorts, top-k, repartitioning


@query
def sort_asc(spark, sf_dir):
    return ordering.sort_rows(_enriched(spark, sf_dir), "event_id")


@query
def sort_desc(spark, sf_dir):
    return ordering.sort_rows(_enriched(spark, sf_dir), "line_total", descending=True)


@query
def top_k(spark, sf_dir):
    lines = _enriched(spark, sf_dir).select("event_id", "line_total")
    return top_k_rows(lines, 20, "line_total")


@query
def top_k_large(spark, sf_dir):
    """The 100,000 dearest units, each sold item of a line being one; no task holds them all."""
    units = given.sold_units(spark, sf_dir)
    return top_k_rows(units, 100_000, "unit_price")


@query
def top_k_large_text(spark, sf_dir):
    """The first 20,000 lines by their comment-like label, a text with many ties."""
    lines = given.event_rows(spark, sf_dir)
    label = F.concat_ws("-", "category", F.col("quantity").cast("string")).alias("label")
    return top_k_rows(lines.select("event_id", label), 20_000, "label", descending=False)


@query
def repartition_rows(spark, sf_dir):
    """All rows spread by category; only categories that would fill a partition are split."""
    return repartition_hot(_enriched(spark, sf_dir), None, "category")


@query
def repartition_summary(spark, sf_dir):
    """The summary in a fixed number of partitions by category, pre-aggregated first."""
    summary = summarise(_enriched(spark, sf_dir))
    return ordering.repartition_by(summary, fixed.DEFAULT_PARTITIONS, "category")


# Scalar expressions


@query
def pmod_case_round(spark, sf_dir):
    """Residue, simple CASE and rounding on exact decimals."""
    key = F.col("l_orderkey")
    per_unit = X.money(F.col("l_extendedprice")) / F.col("l_quantity").cast("decimal(4,0)")
    return given.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.pmod(key, F.lit(4)).alias("bucket"),
        F.pmod(-key, F.lit(7)).alias("negative_bucket"),
        X.category_of(key).alias("label"),
        X.round_money(per_unit).cast("double").alias("price_per_unit"),
    )


@query
def casts_and_arithmetic(spark, sf_dir):
    key, quantity = F.col("l_orderkey"), F.col("l_quantity")
    return given.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (key * 37 + 50).alias("scaled"),
        X.decimal_quotient(F.pmod(key * 37, F.lit(10000)), Decimal("10.0")).alias("tenths"),
        quantity.cast("int").alias("as_int"),
        quantity.cast("long").alias("as_long"),
        F.col("l_linenumber").cast("double").alias("as_double"),
        (F.col("l_linenumber") * F.col("l_extendedprice")).alias("promoted"),
        (quantity >= 25).alias("at_least"),
        (F.col("l_returnflag") == "R").alias("equal"),
        F.lit("constant").alias("text"),
    )


# Whole runs


@query
def batch_run_summary(spark, sf_dir):
    """Append, read back, enrich, summarise, audit, publish and read back."""
    return _run(spark, sf_dir).summary


@query
def batch_run_partitioned(spark, sf_dir):
    """The same run on an input table partitioned by batch."""
    return _run(spark, sf_dir, partitioned=True).summary


@query
def batch_run_report(spark, sf_dir):
    """What the run reports: rows of the batch and groups saved."""
    report = _run(spark, sf_dir)
    return audit(report.summary)


def _reported_sales(spark: SparkSession, sf_dir: str) -> SalesReport:
    table = _fresh_table(spark, schemas.SALES)
    products = given.event_rows(spark, sf_dir).withColumnRenamed("event_id", "product_id")
    batch_id = sink.append_batch(products, table, "b1")
    sink.append(sales_batch(spark, "b2", schemas.SALES), table)
    return report_sales(spark, table, batch_id, 1_000_000)


@query
def sales_report(spark, sf_dir):
    """Large lines of a saved batch by total, highest first."""
    return _reported_sales(spark, sf_dir).large


@query
def sales_all_rows(spark, sf_dir):
    """All batches of the sales table by product."""
    return _reported_sales(spark, sf_dir).all_rows


@query
def sales_category_summary(spark, sf_dir):
    """Summary of one batch of the sales table."""
    return _reported_sales(spark, sf_dir).summary


# Run status and logs


@query
def status_rollup(spark, sf_dir):
    return status.status_rollup(given.hourly_status(spark, sf_dir))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = given.read(spark, sf_dir, "events").schema
    # As a pattern the name may be that of a file or of a folder of part files.
    return monitor.file_stream(spark, f"{sf_dir}/{{events.parquet}}", schema, files_per_batch=4)


def _status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.as_hourly_status(_event_stream(spark, sf_dir))


@query
def status_rollup_stream(spark, sf_dir):
    """The roll-up kept by a stream, over all batches it has taken in."""
    stream, location = _status_stream(spark, sf_dir), scratch_location(spark, "rollup")
    monitor.drain_rollup(stream, f"{location}/rows", f"{location}/checkpoint")
    return monitor.rollup_so_far(spark, given.hourly_status(spark, sf_dir), f"{location}/rows")


@query
def failed_workers_stream(spark, sf_dir):
    stream, location = _status_stream(spark, sf_dir), scratch_location(spark, "failed")
    monitor.drain_failed_workers(stream, f"{location}/rows", f"{location}/checkpoint")
    return monitor.failed_so_far(spark, given.hourly_status(spark, sf_dir), f"{location}/rows")


@query
def distinct_workers_stream(spark, sf_dir):
    """The exact count kept by a stream."""
    stream, location = _status_stream(spark, sf_dir), scratch_location(spark, "workers")
    monitor.drain_workers(stream, f"{location}/rows", f"{location}/checkpoint")
    return monitor.workers_so_far(spark, given.hourly_status(spark, sf_dir), f"{location}/rows")


@query
def resource_summary_stream(spark, sf_dir):
    """Peaks and distinct workers kept by two streams."""
    location, rows = scratch_location(spark, "resources"), given.hourly_status(spark, sf_dir)
    polls, workers = f"{location}/polls", f"{location}/workers"
    day = 24 * 3600
    stream = _status_stream(spark, sf_dir)
    monitor.drain_stretches(stream, polls, f"{location}/checkpoint-polls", seconds=day)
    stream = _status_stream(spark, sf_dir)
    monitor.drain_workers(stream, workers, f"{location}/checkpoint-workers")
    return monitor.resources_so_far(spark, rows, polls, workers, 2, seconds=day)


def _guard_stream(spark: SparkSession, sf_dir: str, shape: Callable, limit: int) -> DataFrame:
    stream, location = shape(_event_stream(spark, sf_dir)), scratch_location(spark, "guard")
    week = 7 * 24 * 3600
    monitor.drain_stretches(stream, f"{location}/rows", f"{location}/checkpoint", limit, seconds=week)
    rows = shape(given.read(spark, sf_dir, "events"))
    return monitor.guard_so_far(spark, rows, f"{location}/rows", limit, seconds=week)


@query
def streak_guard_stream(spark, sf_dir):
    """The guard on one run per user, kept by a stream."""
    return _guard_stream(spark, sf_dir, given.as_user_status, fixed.FAILED_POLLS_LIMIT)


@query
def streak_guard_one_run_stream(spark, sf_dir):
    """The guard on one run that holds all polls, kept by a stream."""
    return _guard_stream(spark, sf_dir, given.as_single_run_status, 4)


@query
def tail_n_stream(spark, sf_dir):
    """The log tails kept by a stream."""
    stream, location = given.as_log_lines(_event_stream(spark, sf_dir)), scratch_location(spark, "tails")
    order = ["ts", "event_id"]
    monitor.drain_tails(stream, f"{location}/rows", f"{location}/checkpoint", 3, order)
    log = given.log_lines(spark, sf_dir)
    return monitor.tails_so_far(spark, log, f"{location}/rows", 3, order)


@query
def distinct_workers(spark, sf_dir):
    return status.distinct_workers(given.hourly_status(spark, sf_dir))


@query
def resource_summary(spark, sf_dir):
    return status.resource_summary(given.hourly_status(spark, sf_dir), 2)


@query
def first_failure(spark, sf_dir):
    return status.first_failure(given.user_status(spark, sf_dir))


@query
def streak_guard(spark, sf_dir):
    """One run per user."""
    return status.streak_guard(given.user_status(spark, sf_dir))


@query
def streak_guard_one_run(spark, sf_dir):
    """One run that holds all polls."""
    return status.streak_guard(given.single_run_status(spark, sf_dir), 4)


@query
def tail_n(spark, sf_dir):
    return logs.tail_lines(given.log_lines(spark, sf_dir), 3, ["ts", "event_id"])


@query
def latest_line(spark, sf_dir):
    lines = given.log_lines(spark, sf_dir)
    return logs.tail_lines(lines, fixed.DRIVER_TAIL, ["ts", "event_id"])


@query
def tail_one_source(spark, sf_dir):
    """The last lines of one source that holds all lines."""
    lines = given.log_lines(spark, sf_dir).withColumn("source", given.year_run())
    return logs.tail_lines(lines, fixed.WORKER_TAIL, ["ts", "event_id"])


@query
def object_events(spark, sf_dir):
    return logs.object_events(given.object_event_rows(spark, sf_dir))


@query
def one_object_events(spark, sf_dir):
    """The events of the object that comes first by name."""
    rows = given.object_event_rows(spark, sf_dir)
    return logs.object_events(rows, rows.agg(F.min("object")).first()[0])


@query
def failed_object_events(spark, sf_dir):
    """Events of all workers that failed in the hourly run."""
    rows = given.object_event_rows(spark, sf_dir)
    failed = logs.of_failed_workers(rows, given.hourly_status(spark, sf_dir), "object")
    return failed.select("object", "type", "reason", "message")


@query
def failed_worker_tail(spark, sf_dir):
    """The last lines of all workers that failed in the hourly run."""
    lines = given.log_lines(spark, sf_dir)
    status_rows = given.hourly_status(spark, sf_dir)
    return logs.failed_worker_tail(lines, status_rows, order=["ts", "event_id"])


@query
def phase_default(spark, sf_dir):
    """Order states as run phases; an open order has no phase yet."""
    state = F.col("o_orderstatus")
    phase = X.case_of(state, {"F": fixed.SUCCEEDED, "O": ""}, None)
    return given.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        phase_or_pending(phase).alias("phase"),
        is_terminal(phase).alias("terminal"),
        is_success(phase).alias("success"),
    )
