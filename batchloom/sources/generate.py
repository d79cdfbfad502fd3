"""Row sources that read no table: generated batches and inline rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom import fixed_values as fixed
from batchloom.functions.expressions import category_of, quantity_of, unit_price_of
from batchloom.operators.checks import expect_positive
from batchloom.operators.enrich import tag_batch


def generate_batch(
    spark: SparkSession,
    rows: int = fixed.DEFAULT_ROWS,
    partitions: int | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    """Deterministic event rows for ids ``0 .. rows - 1``.

    The rows come from ``spark.range`` inside the tasks; there is no shuffle. The number
    of partitions follows from ``rows`` unless it is given.
    """
    if partitions is None:
        partitions = partitions_for(rows)
    expect_positive(rows=rows, partitions=partitions)
    return events_from_ids(spark.range(0, rows, 1, partitions), F.col("id"), batch_id)


def events_from_ids(df: DataFrame, id_: Column, batch_id: str | None = None) -> DataFrame:
    """One event row per input row, with every value a function of ``id_``."""
    events = df.select(
        id_.alias("event_id"),
        category_of(id_).alias("category"),
        quantity_of(id_).alias("quantity"),
        unit_price_of(id_).alias("unit_price"),
    )
    return events if batch_id is None else tag_batch(events, batch_id)


def partitions_for(rows: int, rows_per_partition: int = 5_000_000) -> int:
    """Source partitions that keep each task near ``rows_per_partition`` rows."""
    return max(fixed.DEFAULT_PARTITIONS, math.ceil(rows / rows_per_partition))


def inline_rows(
    spark: SparkSession, rows: Sequence[Sequence[Any]], schema: T.StructType
) -> DataFrame:
    """A handful of literal rows."""
    return spark.createDataFrame([tuple(row) for row in rows], schema)


def sales_batch(spark: SparkSession, batch_id: str, schema: T.StructType) -> DataFrame:
    """The sample sales batch under a batch id."""
    return inline_rows(spark, [(batch_id, *row) for row in fixed.SALES_ROWS], schema)
