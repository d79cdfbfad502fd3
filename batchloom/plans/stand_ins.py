"""The given tables in the shape of the batch and run-status models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom import fixed_values as fixed
from batchloom.functions.times import hour_of
from batchloom.operators.enrich import tag_batch


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as untagged event rows."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        F.col("l_returnflag").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("unit_price"),
    )


def event_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_batch(event_rows(spark, sf_dir), "b1")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as untagged event rows; a second, different batch."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderpriority").alias("category"),
        F.lit(1).alias("quantity"),
        F.col("o_totalprice").alias("unit_price"),
    )


def sold_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each unit of a line item, with its share of the line's price."""
    line = read(spark, sf_dir, "lineitem")
    count = F.col("l_quantity").cast("int")
    unit = F.explode(F.sequence(F.lit(1), count)).alias("unit")
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("unit_price")
    return line.where(count >= 1).select("l_orderkey", "l_linenumber", price, unit)


def event_phase() -> Column:
    """Worker phase of an event."""
    kind = F.col("event_type")
    return (
        F.when(kind == "error", fixed.FAILED)
        .when(kind == "signup", fixed.PENDING)
        .otherwise(fixed.RUNNING)
    )


def year_run() -> Column:
    """The year of an event as its run; all given events lie in one year."""
    return F.concat(F.lit("y"), F.year("ts").cast("string"))


def as_hourly_status(events: DataFrame) -> DataFrame:
    """Events as one run that holds all rows, polled once an hour."""
    return events.select(
        year_run().alias("run_id"),
        hour_of(F.col("ts")).alias("poll_ts"),
        F.col("user_id").cast("string").alias("worker"),
        event_phase().alias("phase"),
    )


def hourly_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hourly_status(read(spark, sf_dir, "events"))


def as_user_status(events: DataFrame) -> DataFrame:
    """Events as one run per user, with one poll per event."""
    return events.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("ts").alias("poll_ts"),
        F.col("user_id").cast("string").alias("worker"),
        event_phase().alias("phase"),
    )


def user_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_user_status(read(spark, sf_dir, "events"))


def as_single_run_status(events: DataFrame) -> DataFrame:
    """Events as one run that holds all rows, with one poll per timestamp."""
    return as_user_status(events).withColumn("run_id", F.concat(F.lit("y"), F.year("poll_ts").cast("string")))


def single_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_single_run_status(read(spark, sf_dir, "events"))


def as_log_lines(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("source"),
        "ts",
        "event_id",
        F.col("props").alias("line"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log_lines(read(spark, sf_dir, "events"))


def object_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("object"),
        F.col("ts").alias("last_ts"),
        F.when(F.col("event_type") == "error", "Warning").otherwise("Normal").alias("type"),
        F.col("event_type").alias("reason"),
        F.col("props").alias("message"),
    )
