"""Operators on log lines and object events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom import fixed_values as fixed
from batchloom.operators.checks import expect_positive
from batchloom.operators.ordering import free_name, sort_rows
from batchloom.operators.status import failed_rows
from batchloom.sources.catalog import quoted


def tail_lines(
    log: DataFrame,
    n: int = fixed.WORKER_TAIL,
    order: Sequence[str] = ("ts",),
    *,
    source: str = "source",
    split: int | None = None,
) -> DataFrame:
    """The last ``n`` lines of each source.

    Lines alike in ``order`` are put in order by all other columns, so the result does not
    depend on how the log is laid out. Three rounds keep a source with any share of the
    lines out of a single task: each input partition keeps its own last ``n`` lines of a
    source; those are cut into up to ``split`` parts (as many as the session's shuffle
    partitions, unless given), whose last ``n`` lines meet in the last round.
    """
    split = split or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    expect_positive(n=n, split=split)
    rest = [name for name in log.columns if name not in order and name != source]
    newest = [F.desc_nulls_last(quoted(name)) for name in [*order, *rest]]
    task, part = free_name(log, "task"), free_name(log, "part")
    lines = log.withColumn(task, F.spark_partition_id())
    lines = _first_rows(lines, [source, task], newest, n)
    lines = lines.withColumn(part, F.pmod(task, F.lit(split))).drop(task)
    lines = _first_rows(lines, [source, part], newest, n).drop(part)
    return _first_rows(lines, [source], newest, n)


def _first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    place = free_name(df, "rank")
    rank = F.row_number().over(Window.partitionBy(*map(quoted, keys)).orderBy(*order))
    return df.withColumn(place, rank).filter(F.col(place) <= n).drop(place)


def object_events(events: DataFrame, obj: str | None = None) -> DataFrame:
    """Type, reason and message of an object's events, oldest first.

    Without ``obj`` the events of all objects are listed, object by object.
    """
    details = ["last_ts", "type", "reason", "message"]
    if obj is None:
        listed = sort_rows(events.select("object", *details), "object")
    else:
        listed = sort_rows(events.filter(F.col("object") == obj).select(details), "last_ts")
    return listed.drop("last_ts")


def failed_worker_tail(
    log: DataFrame,
    status: DataFrame,
    n: int = fixed.WORKER_TAIL,
    order: Sequence[str] = ("ts",),
    *,
    source: str = "source",
) -> DataFrame:
    """The last ``n`` lines of each worker that failed.

    The tails are taken first: they hold at most ``n`` rows per source, so the join never
    moves the log itself and no source is large in it.
    """
    return of_failed_workers(tail_lines(log, n, order, source=source), status, source)


def of_failed_workers(rows: DataFrame, status: DataFrame, worker: str) -> DataFrame:
    """Rows whose ``worker`` column names a worker that failed in some run.

    The failed workers are few and distinct; Spark broadcasts them if their measured size
    allows and otherwise splits a skewed worker at run time.
    """
    failed = failed_rows(status).select(F.col("worker").alias(worker)).distinct()
    return rows.join(failed, worker, "left_semi")
