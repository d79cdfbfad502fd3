"""Top-k: in one task while that can hold k rows, else by a threshold and an exact cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.operators.checks import expect_positive
from batchloom.operators.ordering import free_name, sort_keys, sort_rows
from batchloom.plans.staging import scratch_location, stage
from batchloom.sources.catalog import quoted

#: Most rows that the last task of a top-k merges.
LARGE_K = 10_000
#: A quantile of the sketch is off by at most this share of the rows.
SKETCH_ERROR = 1e-4
#: Shares of the rows for which a threshold is looked up, small to large.
SHARES = tuple(2.0 ** (-step / 4) for step in range(48, -1, -1))
#: Bytes of a text that its sketch key holds.
PREFIX = 7


def top_k(df: DataFrame, k: int, column: str, *, descending: bool = True) -> DataFrame:
    """First ``k`` rows of the total order, without sorting the whole input.

    Up to ``LARGE_K`` rows Spark plans this as ``TakeOrderedAndProject``: each task keeps ``k``
    rows and the last one merges them. A larger k goes through ``select_top``.
    """
    if k > LARGE_K:
        return select_top(df, k, column, descending=descending)
    return df.orderBy(*sort_keys(df, column, descending)).limit(k)


def select_top(
    df: DataFrame, k: int, column: str, *, descending: bool = True, parts: int | None = None
) -> DataFrame:
    """First ``k`` rows of the total order of ``sort_rows``, in that order.

    1. One aggregate sketches the quantiles of ``column``. The least extreme value that surely
       leaves ``k`` rows is a filter that reaches the scan.
    2. What passes is range-partitioned by the total order into ``parts`` (as many as the
       session's shuffle partitions, unless given) and written to the shared folder. The sizes
       of the parts tell which are inside, and how many rows the part at the edge gives.

    So a task holds one part at most, never ``k`` rows, and the rows beyond the threshold are
    not shuffled. Should the sketch have been wrong, which the sizes show, the rows are cut
    without it. Types without a sketch (arrays, structs, intervals) are cut without one, too.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    expect_positive(k=k, parts=parts)
    inside = threshold(df, k, column, descending=descending)
    chosen = None if inside is None else _cut(df.filter(inside), k, column, descending, parts)
    if chosen is None:
        chosen = _cut(df, k, column, descending, parts, short=True)
    return sort_rows(chosen, column, descending=descending)


def threshold(df: DataFrame, k: int, column: str, *, descending: bool = True) -> Column | None:
    """A condition that the first ``k`` rows by ``column`` meet, or None if nothing better is known."""
    key = _sketch_key(df, column)
    if key is None:
        return None
    shares = [1 - share for share in SHARES] if descending else list(SHARES)
    usable = key
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        usable = F.when(~F.isnan(key), key)
    sketch = F.percentile_approx(usable, shares, round(1 / SKETCH_ERROR))
    found = df.agg(
        F.count(usable).alias("rows"),
        F.count_if(quoted_column(column).isNull()).alias("nulls"),
        sketch.alias("values"),
    ).first()
    if not descending and found["nulls"] >= k:
        return quoted_column(column).isNull()
    if not found["rows"]:
        return None
    # The sketch may be off to either side, once for the value and once for the rows before it.
    needed = (k + 1) / found["rows"] + 2 * SKETCH_ERROR
    value = next((v for s, v in zip(SHARES, found["values"], strict=True) if s >= needed), None)
    if value is None:
        return None
    # NULLs come first ascending and last descending; NaN is above all numbers.
    return key >= F.lit(value) if descending else key.isNull() | (key <= F.lit(value))


def quoted_column(name: str) -> Column:
    return F.col(quoted(name))


def _sketch_key(df: DataFrame, column: str) -> Column | None:
    """What of the column a quantile sketch takes: in the same order, though ties may be more."""
    kind, value = df.schema[column].dataType, quoted_column(column)
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value
    if isinstance(kind, T.BooleanType):
        return value.cast("int")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        first = F.hex(F.substring(value.cast("binary"), 1, PREFIX))
        return F.conv(F.rpad(first, 2 * PREFIX, "0"), 16, 10).cast("long")
    return None


def _cut(
    df: DataFrame, k: int, column: str, descending: bool, parts: int, *, short: bool = False
) -> DataFrame | None:
    """Exactly the first ``k`` rows; None if there are fewer, unless ``short`` allows that."""
    origin, part, place = (free_name(df, stem) for stem in ("origin", "part", "place"))
    keys = sort_keys(df, column, descending)
    dealt = (
        df.withColumn(origin, F.spark_partition_id())
        .repartitionByRange(parts, *keys, origin)
        .withColumn(part, F.spark_partition_id())
        .drop(origin)
    )
    rows = stage(dealt, scratch_location(df.sparkSession, "top"))
    sizes = sorted((r[part], r["count"]) for r in rows.groupBy(part).count().collect())
    if not short and sum(size for _, size in sizes) < k:
        return None
    left = k
    for number, size in sizes:
        if size >= left:
            break
        left -= size
    else:
        return rows.drop(part)
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*keys))
    edge = rows.filter(F.col(part) == number).withColumn(place, rank)
    edge = edge.filter(F.col(place) <= left).drop(place)
    return rows.filter(F.col(part) < number).unionByName(edge).drop(part)
