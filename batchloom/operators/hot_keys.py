"""Finding the keys that hold many rows, and spreading only those."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.operators.checks import expect_positive
from batchloom.operators.ordering import free_name
from batchloom.sources.catalog import quoted

#: Most hot keys that are told apart; bounds what a plan holds of them.
MOST = 1_000
#: Counters of the sketch for each hot key that there may be.
COUNTERS = 16
#: Pieces of a hot key for each partition that it would fill, so that chance evens them out.
PIECES = 64


def key_hash(column: str) -> Column:
    """The 64-bit hash of a key of any type; NULL has one as well."""
    return F.xxhash64(F.col(quoted(column)))


def hot_keys(df: DataFrame, column: str, share: float) -> dict[int, float]:
    """Hashes of the keys that hold at least ``share`` of the rows, with their shares.

    One scan with a frequent-items sketch in each task, whose counters meet in the last one: a
    key above the share is never missed, and shares are too high by a sixteenth of ``share`` at
    most.
    """
    if not 1 / MOST <= share <= 1:
        raise ValueError(f"share must lie between {1 / MOST} and 1, found {share}")
    most = int(1 / share)
    # The sketch keeps three quarters of the counters that it is given, a power of two.
    counters = 1 << (2 * COUNTERS * most - 1).bit_length()
    sketch = F.call_function("approx_top_k", key_hash(column), F.lit(most), F.lit(counters))
    found = df.agg(F.count(F.lit(1)).alias("rows"), sketch.alias("top")).first()
    total = found["rows"]
    return {t["item"]: t["count"] / total for t in found["top"] or [] if t["count"] >= share * total}


def repartition_hot(
    df: DataFrame, partitions: int | None, column: str, *, share: float | None = None
) -> DataFrame:
    """Hash rows by ``column`` into partitions, splitting only keys above ``share`` of the rows.

    All rows of any other key stay together in one partition. A hot key is cut into pieces by a
    hash of the whole row and its input partition (the same when a task is run again), in number
    by its share. ``share`` is by default that of one partition, but not below 1 in ``MOST``.
    """
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    expect_positive(partitions=width)
    hot = hot_keys(df, column, max(1 / width, 1 / MOST) if share is None else share)
    number = [] if partitions is None else [partitions]
    if not hot:
        return df.repartition(*number, F.col(quoted(column)))
    piece = free_name(df, "piece")
    row = F.xxhash64(*(F.col(quoted(name)) for name in df.columns), F.spark_partition_id())
    split = df.withColumn(piece, F.pmod(row, _pieces(column, hot, width)))
    return split.repartition(*number, F.col(quoted(column)), piece).drop(piece)


def _pieces(column: str, hot: dict[int, float], partitions: int) -> Column:
    """How many pieces a row's key is cut into: a power of two for hot keys, 1 for others."""
    by_size: dict[int, list[int]] = {}
    for key, share in hot.items():
        wanted = max(2, round(share * partitions * PIECES))
        by_size.setdefault(1 << (wanted - 1).bit_length(), []).append(key)
    return reduce(
        lambda rest, size: F.when(key_hash(column).isin(by_size[size]), F.lit(size).cast("long"))
        .otherwise(rest),
        by_size,
        F.lit(1).cast("long"),
    )
