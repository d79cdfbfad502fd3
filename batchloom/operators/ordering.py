"""Sorts and explicit repartitioning."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.sources.catalog import quoted


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {name.lower() for name in df.columns}
    return next(name for i in count() if (name := f"{stem}_{i}") not in taken)


def sort_rows(df: DataFrame, column: str, *, descending: bool = False) -> DataFrame:
    """Total order by ``column`` with all other columns as the tie-break.

    The tie-break makes the order reproducible and gives the range partitioner keys to
    split on when one value of ``column`` holds a large share of the rows. Rows that are
    alike in every column are told apart by the input partition they come from, so many
    copies of one row do not meet in a single task. NULLs come first ascending and last
    descending.
    """
    part = free_name(df, "part")
    # Input partition ids stay the same when a task is run again; random numbers would not.
    parted = df.withColumn(part, F.spark_partition_id())
    return parted.orderBy(*sort_keys(df, column, descending), part).drop(part)


def sort_keys(df: DataFrame, column: str, descending: bool) -> list[Column]:
    by = F.desc_nulls_last if descending else F.asc_nulls_first
    rest = [F.asc_nulls_first(quoted(name)) for name in df.columns if name != column]
    return [by(quoted(column)), *rest]


def repartition_by(
    df: DataFrame, partitions: int | None, column: str, *, split_hot: int = 1
) -> DataFrame:
    """Hash rows by ``column`` into partitions; without a number, as many as the data need.

    With ``split_hot`` above 1 the rows of one key are dealt to that many pieces by a hash
    of the whole row and its input partition, so one key with a third of all rows does not
    end up in a single task, however few the input partitions are. Pieces are hashed to
    partitions, so several times as many pieces as partitions give even ones. Use it only to
    spread rows; an aggregate needs no repartition at all.
    """
    number = [] if partitions is None else [partitions]
    if split_hot == 1:
        return df.repartition(*number, quoted(column))
    piece = free_name(df, "piece")
    row = F.xxhash64(*(F.col(quoted(name)) for name in df.columns), F.spark_partition_id())
    split = df.withColumn(piece, F.pmod(row, F.lit(split_hot)))
    return split.repartition(*number, quoted(column), piece).drop(piece)
