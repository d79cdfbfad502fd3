"""Grouped summaries and counts.

A grouped summary is one scan, a map-side partial aggregate and one small exchange: a
category holding a third of all rows reaches the reducer as one partial row per task.
Nothing is repartitioned before the aggregate, as that would move every raw row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.functions.expressions import (
    accurate_average,
    accurate_sum,
    exact_average,
    exact_sum,
    round_money,
)


def summarise(
    df: DataFrame,
    keys: Sequence[str] = ("batch_id", "category"),
    *,
    count_as: str = "event_count",
    average: bool = False,
    exact: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Count, total quantity and revenue per group of enriched rows.

    ``average`` adds the rounded average unit price. Sums do not lose cents however many
    rows there are. ``exact`` takes all amounts as whole cents and rounds averages on the
    exact quotient, so that no tie depends on how a DOUBLE is represented. ``ordered``
    sorts by revenue, highest first; leave it off before a table write, where the order is
    lost anyway.
    """
    sum_of, average_of = (
        (exact_sum, exact_average) if exact else (accurate_sum, accurate_average)
    )
    measures = [
        F.count("*").alias(count_as),
        F.sum("quantity").cast("long").alias("total_quantity"),
        round_money(sum_of(F.col("line_total"))).alias("revenue"),
    ]
    if average:
        measures.append(round_money(average_of(F.col("unit_price"))).alias("average_price"))
    summary = df.groupBy(*keys).agg(*measures)
    return by_revenue(summary, *keys) if ordered else summary


def by_revenue(summary: DataFrame, *tie_break: str) -> DataFrame:
    """Highest revenue first, NULL revenue last."""
    return summary.orderBy(F.desc_nulls_last("revenue"), *tie_break)


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    """Global row count as a one-row DataFrame."""
    return df.agg(F.count("*").alias(name))
