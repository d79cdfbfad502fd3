"""Projections and filters on event batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom import fixed_values as fixed
from batchloom.functions.expressions import line_total_of, quantity_band_of
from batchloom.sources.catalog import quoted


def tag_batch(df: DataFrame, batch_id: str) -> DataFrame:
    """Put one constant batch id on every row, as the first column."""
    rest = [F.col(quoted(name)) for name in df.columns if name != "batch_id"]
    return df.select(F.lit(batch_id).alias("batch_id"), *rest)


def current_batch(df: DataFrame, batch_id: str) -> DataFrame:
    """Rows of one batch. The equality reaches the scan as a pushed or partition filter."""
    return df.filter(F.col("batch_id") == batch_id)


def enrich(df: DataFrame) -> DataFrame:
    """Add ``line_total`` and ``quantity_band``."""
    quantity = F.col("quantity")
    return df.withColumns(
        {
            "line_total": line_total_of(quantity, F.col("unit_price")),
            "quantity_band": quantity_band_of(quantity),
        }
    )


def large_lines(df: DataFrame, minimum: float = fixed.LARGE_LINE_TOTAL) -> DataFrame:
    """Rows whose line total reaches ``minimum``; NULL totals are left out."""
    return df.filter(F.col("line_total") >= minimum)
