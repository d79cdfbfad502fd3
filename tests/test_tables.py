"""Create, append, read back, look up and check tables."""

import math
from datetime import UTC, date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom import schemas
from batchloom.operators.aggregate import summarise
from batchloom.operators.checks import (
    CheckFailed,
    SchemaMismatch,
    expect_positive,
    expect_rows,
    expect_schema,
)
from batchloom.operators.enrich import enrich
from batchloom.operators.logs import tail_lines
from batchloom.operators.ordering import repartition_by, sort_rows
from batchloom.plans import staging
from batchloom.plans.staging import scratch_location, shared_folder, stage
from batchloom.sinks import tables as sink
from batchloom.sources import catalog
from batchloom.sources.generate import generate_batch, inline_rows


@pytest.fixture
def events(spark, database, location):
    table = f"{database}.events"
    sink.ensure_table(spark, table, schemas.EVENTS, f"{location}/events")
    return table


def summary_of(spark, table, batch_id):
    rows = summarise(enrich(sink.read_batch(spark, table, batch_id)), exact=True).collect()
    return sorted(tuple(row) for row in rows)


def test_second_batch_leaves_the_first_unchanged(spark, events):
    first = sink.append_batch(generate_batch(spark, 500), events)
    before = summary_of(spark, events, first)
    second = sink.append_batch(generate_batch(spark, 300), events)
    assert first != second
    assert summary_of(spark, events, first) == before
    assert expect_rows(spark.table(events), 800) == 800
    assert expect_rows(sink.read_batch(spark, events, second), 300) == 300


def test_columns_are_matched_by_name(spark, events):
    batch = generate_batch(spark, 10, 1)
    sink.append_batch(batch.select(*reversed(batch.columns)), events, "b1")
    expected = batch.select(F.lit("b1").alias("batch_id"), "*")
    assert spark.table(events).exceptAll(expected).count() == 0


def test_append_rejects_other_columns(spark, events):
    batch = generate_batch(spark, 10, 1)
    with pytest.raises(SchemaMismatch):
        sink.append_batch(batch.drop("quantity"), events)
    with pytest.raises(SchemaMismatch):
        sink.append_batch(batch.withColumn("more", F.lit(1)), events)
    with pytest.raises(SchemaMismatch):
        sink.append_batch(batch.withColumn("quantity", F.col("unit_price")), events)
    assert spark.table(events).count() == 0


def test_insert_select_is_positional(spark, events):
    rows = inline_rows(spark, [("b'1", 7, "x", 2, 1.5)], "a string, b long, c string, d int, e double")
    sink.insert_select(rows, events)
    assert tuple(spark.table(events).first()) == ("b'1", 7, "x", 2, 1.5)


def test_insert_overflow_is_an_error(spark, events):
    rows = inline_rows(spark, [("b1", 7, "x", 2**40, 1.5)], "a string, b long, c string, d long, e double")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        sink.insert_select(rows, events)
    assert spark.table(events).count() == 0


def test_ensure_table_is_idempotent(spark, events, location):
    sink.append_batch(generate_batch(spark, 10, 1), events)
    sink.ensure_table(spark, events, schemas.EVENTS, f"{location}/elsewhere")
    assert spark.table(events).count() == 10
    assert catalog.table_location(spark, events).endswith("/events")
    with pytest.raises(SchemaMismatch):
        sink.ensure_table(spark, events, schemas.SALES, f"{location}/events")


@pytest.mark.parametrize("fmt", ["orc", "json", "csv"])
def test_other_formats(spark, database, location, fmt):
    table = f"{database}.{fmt}_events"
    sink.ensure_table(spark, table, schemas.EVENTS, f"{location}/{fmt}", fmt=fmt)
    sink.append_batch(generate_batch(spark, 100), table, "b1")
    sink.append_batch(generate_batch(spark, 50), table, "b2")
    expected = generate_batch(spark, 100, batch_id="b1")
    assert sink.read_batch(spark, table, "b1").exceptAll(expected).count() == 0
    assert sink.read_batch(spark, table, "b1").count() == 100


def test_missing_format_is_an_error(spark, database, location):
    with pytest.raises(Exception, match="nosuch"):
        sink.ensure_table(spark, f"{database}.t", schemas.EVENTS, f"{location}/t", fmt="nosuch")


def test_partitioned_table_prunes_batches(spark, database, location):
    table = f"{database}.by_batch"
    schema = sink.partitions_last(schemas.EVENTS, ["batch_id"])
    assert schema.names[-1] == "batch_id" and len(schema) == len(schemas.EVENTS)
    sink.ensure_table(spark, table, schema, f"{location}/p", partitioned_by=["batch_id"])
    sink.append_batch(generate_batch(spark, 100), table, "b1")
    sink.append_batch(generate_batch(spark, 50), table, "b2")
    batch = sink.read_batch(spark, table, "b2")
    assert catalog.table_schema(spark, table) == schema
    assert batch.count() == 50
    assert all("batch_id=b2" in path for path in batch.inputFiles())


def test_resolve_tables(spark, events, database):
    resolved = catalog.resolve_tables(spark, [events, f"spark_catalog.{events}"])
    assert resolved[events].schema == schemas.EVENTS
    assert resolved[events].location.endswith("/events")
    assert catalog.probe(spark, events).collect() == []
    with pytest.raises(AnalysisException):
        catalog.resolve_tables(spark, [events, f"{database}.missing"])


def test_location_is_not_a_column(spark, database, location):
    table = f"{database}.places"
    schema = T.StructType([T.StructField("location", T.StringType())])
    sink.ensure_table(spark, table, schema, f"{location}/places")
    assert catalog.table_location(spark, table).endswith("/places")


def test_list_tables(spark, events, database):
    assert [row["tableName"] for row in catalog.list_tables(spark, database).collect()] == ["events"]
    assert catalog.database_exists(spark, database)
    assert not catalog.database_exists(spark, "no_such_database")


def test_database_names_are_quoted(spark, location):
    sink.ensure_database(spark, "select", f"{location}/select")
    sink.ensure_database(spark, "select", f"{location}/select")
    assert catalog.list_tables(spark, "select").collect() == []
    assert catalog.quoted("a`b", "c.d") == "`a``b`.`c.d`"
    with pytest.raises(AnalysisException):
        catalog.list_tables(spark, "no such database").collect()


def test_namespace(spark, database):
    catalog.use_namespace(spark, database, "spark_catalog")
    assert tuple(catalog.namespace(spark).first()) == ("spark_catalog", database)
    catalog.use_namespace(spark, "default")
    assert tuple(catalog.namespace(spark).first()) == ("spark_catalog", "default")


def test_expect_schema(spark):
    enriched = enrich(generate_batch(spark, 10, 1))
    types = {"line_total": "double", "quantity_band": "string"}
    assert expect_schema(enriched, types) is enriched
    with pytest.raises(SchemaMismatch, match="line_total: expected string, found double"):
        expect_schema(enriched, {"line_total": "string"})
    with pytest.raises(SchemaMismatch, match="missing: expected int, found no such column"):
        expect_schema(enriched, {"missing": "int"})


def test_expect_rows_and_parameters(spark):
    with pytest.raises(CheckFailed, match="rows: expected 4, found 3"):
        expect_rows(spark.range(3), 4)
    expect_positive(rows=1)
    with pytest.raises(ValueError, match="rows must be positive, found 0"):
        expect_positive(rows=0)


def test_staged_result_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    staged = stage(spark.range(0, 100, 1, 4).mapInPandas(count, "id long"))
    once = seen.value
    assert once == 100
    assert staged.count() == 100 and staged.agg(F.sum("id")).first()[0] == 4950
    assert seen.value == once
    assert "MapInPandas" not in staged._jdf.queryExecution().toString()


def test_shared_folder_is_the_named_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert scratch_location(spark, "x").startswith(f"{folder}/x-")


def test_library_needs_no_classic_session():
    """Neither the classic context nor a change of settings is used outside of tests."""
    root = Path(staging.__file__).resolve().parent.parent
    words = ("sparkContext", "setCheckpointDir", "localCheckpoint", "mkdtemp", "conf.set")
    for path in root.rglob("*.py"):
        found = [word for word in words if word in path.read_text()]
        assert not found, f"{path}: {found}"


def test_wide_and_oddly_named_columns(spark, database, location):
    fields = ", ".join(f"f{i}: int" for i in range(40))
    ddl = f"wide struct<{fields}>, `a.b` string, `__part` int, `back``tick` double"
    rows = inline_rows(spark, [(tuple(range(40)), "x", 1, 2.0), (None, "y", 2, 3.0)], ddl)
    table = f"{database}.odd"
    for _ in range(2):
        sink.ensure_table(spark, table, rows.schema, f"{location}/odd")
    sink.append(rows, table)
    stored = spark.table(table)
    assert sorted(stored.select("`a.b`").collect()) == [("x",), ("y",)]
    assert sort_rows(stored, "a.b", descending=True).collect()[0]["a.b"] == "y"
    assert sort_rows(stored, "back`tick").columns == rows.columns
    assert repartition_by(stored, 3, "a.b", split_hot=2).columns == rows.columns
    assert tail_lines(stored, 1, ["back`tick"], source="a.b").columns == rows.columns


def test_literal_insert_goes_by_position(spark, database, location):
    table = f"{database}.literals"
    sink.ensure_table(spark, table, schemas.SALES, f"{location}/literals")
    sink.insert_values(spark, table, [("b", 1, "c", 2, Decimal("2499.00")), ("b", 2, "it's \\ c", None, Decimal("0.10"))])
    assert sorted(tuple(row) for row in spark.table(table).collect()) == [("b", 1, "c", 2, 2499.0), ("b", 2, "it's \\ c", None, 0.1)]
    catalog.drop_database(spark, database)
    assert not catalog.database_exists(spark, database)


def test_literals_arrive_as_they_are(spark, database, location):
    table = f"{database}.kinds"
    kinds = (
        "d date, t timestamp, n timestamp_ntz, x double, f float, m decimal(10,2), s string, "
        "b boolean, raw binary, l array<int>, o map<string,int>"
    )
    sink.ensure_table(spark, table, inline_rows(spark, [], kinds).schema, f"{location}/kinds")
    at, wall = datetime(2024, 1, 2, 3, 4, 5, 678, UTC), datetime(2024, 3, 10, 2, 30)
    text = ":v0 ? it's \\ \n é"
    row = (date(2024, 1, 1), at, wall, float("inf"), float("nan"), Decimal("1.25"), text, True, b"\x00\xff", [1, None], {"a": 1})
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        sink.insert_values(spark, table, [row, (None,) * len(row), (date(1, 1, 1), None, None, float("-inf"), -0.0) + (None,) * 6])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    stored = spark.table(table)
    first = stored.where("s is not null").withColumn("t", F.unix_micros("t")).first()
    assert first["t"] == int(at.timestamp() * 1_000_000)
    assert math.isnan(first["f"])
    assert (first["d"], first["n"], first["x"], *first[5:]) == (row[0], row[2], row[3], *row[5:])
    assert stored.where(" and ".join(f"{c} is null" for c in stored.columns)).count() == 1
    assert [tuple(r) for r in stored.where("x < 0").select("d", "x").collect()] == [(date(1, 1, 1), float("-inf"))]


@pytest.fixture
def by_batch(spark, database, location):
    table = f"{database}.by_batch"
    schema = sink.partitions_last(schemas.EVENTS, ["batch_id"])
    sink.ensure_table(spark, table, schema, f"{location}/by_batch", partitioned_by=["batch_id"])
    return table


def dying(rows):
    """The same rows, but the last input partition fails once the others are written."""
    last = F.spark_partition_id() == 7
    late = F.when(last, F.raise_error(F.lit("killed"))).otherwise(F.col("quantity"))
    return rows.withColumn("quantity", late.cast("int"))


@pytest.mark.parametrize("how", ["append", "replace"])
def test_a_killed_batch_is_run_again(spark, by_batch, how, location):
    whole = generate_batch(spark, 8_000, 8)
    sink.append_batch(generate_batch(spark, 50), by_batch, "other")
    with pytest.raises(Exception, match="killed"):
        if how == "append":
            sink.append_batch(dying(whole), by_batch, "b")
        else:
            sink.replace_batch(dying(whole), by_batch, "b")
    # What a driver that dies while files are moved leaves behind: some of the batch's files.
    left = f"{location}/by_batch/batch_id=b"
    whole.drop("batch_id").where("event_id < 3000").write.mode("append").parquet(left)
    spark.sql("MSCK REPAIR TABLE IDENTIFIER(:t)", args={"t": by_batch})
    spark.catalog.refreshTable(by_batch)
    assert sink.read_batch(spark, by_batch, "b").count() == 3_000
    with pytest.raises(CheckFailed):
        sink.append_batch(whole, by_batch, "b")
    for _ in range(2):
        assert sink.replace_batch(whole, by_batch, "b") == "b"  # also of what was left
        kept = sink.read_batch(spark, by_batch, "b")
        assert kept.count() == 8_000 and kept.select("event_id").distinct().count() == 8_000
    assert sink.read_batch(spark, by_batch, "other").count() == 50
    sink.replace_batch(whole.limit(0), by_batch, "b")
    assert spark.table(by_batch).count() == 50
    sink.replace_batch(whole.limit(0), by_batch, "never seen")
    assert spark.table(by_batch).count() == 50


def test_only_tables_by_batch_replace(spark, events):
    with pytest.raises(ValueError, match="not partitioned"):
        sink.replace_batch(generate_batch(spark, 5), events, "b")


def scanned_rows(df):
    """Rows that the file scan of a plan has handed on, after row groups were skipped."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan"):
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("filtered", [True, False])
def test_bloom_filter_skips_row_groups(spark, database, location, filtered):
    """Many batches in one file, in no order: only the filter can tell the row groups apart."""
    table = f"{database}.mixed"
    sink.ensure_table(
        spark, table, schemas.EVENTS, f"{location}/mixed",
        bloom_filters={"batch_id": 5_000} if filtered else None,
    )
    rows = generate_batch(spark, 100_000, 1).withColumn("batch_id", F.md5(F.col("event_id").cast("string")))
    rows = rows.select(*schemas.EVENTS.names)
    small = {"parquet.block.size": 1 << 16, "parquet.page.size": 1 << 12, "parquet.enable.dictionary": "false"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        sink.append(rows, table)
    finally:
        for key in small:
            spark.conf.unset(key)
    wanted = rows.where("event_id = 51234").first()["batch_id"]
    found = sink.read_batch(spark, table, wanted)
    assert found.count() == 1
    scanned = scanned_rows(sink.read_batch(spark, table, wanted))
    assert (scanned < 15_000) if filtered else (scanned == 100_000), scanned


def test_bloom_filter_of_no_column(spark, database, location):
    for wrong in ({"nope": 5}, {"batch_id": 0}):
        with pytest.raises(ValueError, match="bloom"):
            sink.ensure_table(spark, f"{database}.t", schemas.EVENTS, f"{location}/t", bloom_filters=wrong)


class Settings:
    """What the staging helper asks of a session."""

    def __init__(self, **values):
        self.conf = self
        self.values = {key.replace("_", "."): value for key, value in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", None])
def test_staging_keeps_off_one_machines_disk(master):
    on_disk = {"spark_sql_warehouse_dir": "file:/tmp/warehouse", "spark_master": master}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Settings(**on_disk))
    assert shared_folder(Settings(**on_disk, spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(Settings(spark_sql_warehouse_dir="s3a://b/w/", spark_master=master)) == "s3a://b/w/staged"
    assert shared_folder(Settings(spark_sql_warehouse_dir="/w", spark_master="local[2]")) == "/w/staged"
