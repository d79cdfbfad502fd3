"""The local sales run: append the sample batch and report on it from the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from batchloom import fixed_values as fixed
from batchloom import schemas
from batchloom.operators.aggregate import summarise
from batchloom.operators.checks import expect_rows
from batchloom.operators.enrich import enrich, large_lines
from batchloom.operators.ordering import sort_rows
from batchloom.sinks.tables import DEFAULT_FORMAT, append_batch, ensure_table, read_batch
from batchloom.sources.catalog import scan
from batchloom.sources.generate import sales_batch


@dataclass(frozen=True)
class SalesReport:
    """Lazy parts of the report; only those that are shown are computed."""

    all_rows: DataFrame
    lines: DataFrame
    large: DataFrame
    summary: DataFrame


def report_sales(
    spark: SparkSession, table: str, batch_id: str, minimum: float = fixed.LARGE_LINE_TOTAL
) -> SalesReport:
    """All rows by product; the batch's lines and large lines by total; its summary."""
    enriched = enrich(read_batch(spark, table, batch_id))
    lines = enriched.select("product_id", "category", "quantity", "unit_price", "line_total")
    return SalesReport(
        all_rows=sort_rows(scan(spark, table), "product_id"),
        lines=sort_rows(lines, "line_total", descending=True),
        large=sort_rows(large_lines(lines, minimum), "line_total", descending=True),
        summary=summarise(
            enriched, ["category"], count_as="product_count", average=True, ordered=True
        ),
    )


def run_sales(
    spark: SparkSession, table: str, location: str, fmt: str = DEFAULT_FORMAT
) -> SalesReport:
    """Create the table if missing, append the sample batch, check it and report on it."""
    ensure_table(spark, table, schemas.SALES, location, fmt)
    batch_id = append_batch(sales_batch(spark, "", schemas.SALES), table)
    expect_rows(read_batch(spark, table, batch_id), len(fixed.SALES_ROWS), "rows of the batch")
    return report_sales(spark, table, batch_id)
