"""Operators on a run-status table ``(run_id, poll_ts, worker, phase)``.

One row says which phase a worker was in at one poll of a run. A poll that saw no worker
is one row with a NULL worker: it counts as a poll and as no worker.

No operator brings the rows of one run into one task. Counts are combined map-side, and
the streak guard cuts the time line of each run into pieces of even size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom import fixed_values as fixed
from batchloom.plans.staging import scratch_location, stage


def worker_of() -> Column:
    return F.nullif(F.col("worker"), F.lit(""))


def _count_phase(phase: str) -> Column:
    return F.count_if(worker_of().isNotNull() & (F.col("phase") == phase))


def status_rollup(status: DataFrame) -> DataFrame:
    """Workers per poll: total, running, pending and failed.

    Workers in any other phase count in the total only.
    """
    return status.groupBy("run_id", "poll_ts").agg(
        F.count(worker_of()).alias("total"),
        _count_phase(fixed.RUNNING).alias("running"),
        _count_phase(fixed.PENDING).alias("pending"),
        _count_phase(fixed.FAILED).alias("failed"),
    )


def distinct_workers(status: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Different workers seen in a run, in any phase.

    The exact count shuffles by ``(run_id, worker)`` first, so a large run is spread over
    tasks. ``approximate`` shuffles one sketch per run and task instead.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    return status.groupBy("run_id").agg(count(worker_of()).alias("distinct_workers"))


def resource_summary(status: DataFrame, slots_per_worker: int = fixed.SLOTS_PER_WORKER) -> DataFrame:
    """Distinct workers, peak of running workers and peak slots of each run.

    One scan and one exchange serve both measures: the rows are grouped by poll and by
    worker at once, and the second aggregate sees one row per poll and one per worker.
    """
    seen = status.select(
        "run_id",
        "poll_ts",
        worker_of().alias("worker"),
        (worker_of().isNotNull() & (F.col("phase") == fixed.RUNNING)).alias("is_running"),
    )
    grouped = seen.groupingSets(
        [["run_id", "poll_ts"], ["run_id", "worker"]], "run_id", "poll_ts", "worker"
    ).agg(
        F.count_if("is_running").alias("running"),
        (F.grouping("worker") == 1).alias("is_poll"),
    )
    peak = F.max(F.when(F.col("is_poll"), F.col("running")))
    return grouped.groupBy("run_id").agg(
        F.count_if(~F.col("is_poll") & F.col("worker").isNotNull()).alias("distinct_workers"),
        peak.alias("peak_running"),
        (peak * slots_per_worker).alias("peak_slots"),
    )


def failed_rows(status: DataFrame) -> DataFrame:
    return status.filter((F.col("phase") == fixed.FAILED) & worker_of().isNotNull())


def first_failure(status: DataFrame) -> DataFrame:
    """The first failed poll of each worker that failed, one row per worker and run."""
    return (
        failed_rows(status).groupBy("run_id", "worker").agg(F.min("poll_ts").alias("first_failed"))
    )


def all_failed() -> Column:
    """A poll in which there were workers and every one of them had failed."""
    total, failed = F.col("total"), F.col("failed")
    return (total > 0) & (failed == total) & (F.col("running") == 0) & (F.col("pending") == 0)


def streak_guard(status: DataFrame, limit: int = fixed.FAILED_POLLS_LIMIT) -> DataFrame:
    """Poll at which a run first has ``limit`` all-failed polls in a row.

    Runs that never get there are left out.
    """
    return rollup_guard(status_rollup(status), limit)


def rollup_guard(rollup: DataFrame, limit: int = fixed.FAILED_POLLS_LIMIT) -> DataFrame:
    """The streak guard on polls that are rolled up already."""
    return first_streak(rollup.select("run_id", "poll_ts", all_failed().alias("bad")), limit)


def first_streak(polls: DataFrame, limit: int) -> DataFrame:
    """First poll of each run that ends ``limit`` bad polls in a row.

    ``polls`` holds one row ``(run_id, poll_ts, bad)`` per poll. Range partitioning by
    ``(run_id, poll_ts)`` cuts every run into stretches that are contiguous in time and of even
    size, so one run may hold any share of the polls. The cut is written to the shared folder,
    as it is read twice: summed up per stretch, and once more for the single poll of a run at
    which a streak that came in from earlier stretches reaches the limit.
    """
    if limit <= 0:
        raise ValueError(f"limit must be positive, found {limit}")
    cut = polls.repartitionByRange("run_id", "poll_ts").withColumn(
        "stretch", F.spark_partition_id().cast("long")
    )
    cut = stage(with_lengths(cut), scratch_location(polls.sparkSession, "polls"))
    return fired_at(merge_stretches(stretch_summaries(cut, limit), limit), cut)


def with_lengths(polls: DataFrame) -> DataFrame:
    """Add ``length``, the bad polls in a row up to each one inside its stretch, and ``leading``:
    whether all polls of the stretch so far are bad.
    """
    so_far = (
        Window.partitionBy("run_id", "stretch")
        .orderBy("poll_ts")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    bad, at_reset = F.col("bad"), F.col("bad_at_reset")
    return (
        polls.withColumn("bad_so_far", F.count_if(bad).over(so_far))
        .withColumn("bad_at_reset", F.max(F.when(~bad, F.col("bad_so_far"))).over(so_far))
        .withColumn("length", F.col("bad_so_far") - F.coalesce(at_reset, F.lit(0)))
        .withColumn("leading", bad & at_reset.isNull())
        .drop("bad_so_far", "bad_at_reset")
    )


def stretch_summaries(polls: DataFrame, limit: int, *more: Column) -> DataFrame:
    """What a stretch of a run's time line contributes to its streaks, in one row.

    ``head`` bad polls lead it, ``tail`` bad polls end it, and ``fired`` is the poll at which a
    streak inside it first reaches the limit. With ``reset``, whether any poll was not bad, that
    is all that streaks across stretches need, however long the stretch. ``more`` are further
    aggregates.
    """
    at_limit = F.col("bad") & (F.col("length") == limit)
    return polls.groupBy("run_id", "stretch").agg(
        F.min("poll_ts").alias("starts"),
        F.count_if("leading").alias("head"),
        F.max_by("length", "poll_ts").alias("tail"),
        F.bool_or(~F.col("bad")).alias("reset"),
        F.min(F.when(at_limit, F.col("poll_ts"))).alias("fired"),
        *more,
    )


def merge_stretches(summaries: DataFrame, limit: int) -> DataFrame:
    """``run_id, fired, stretch, missing``: what the stretches of each run amount to.

    ``fired`` is the first firing inside a stretch. ``stretch`` is the first one in whose
    leading streak a streak carried in from before reaches the limit, at its ``missing``-th poll.
    One row per stretch meets per run.
    """
    earlier = (
        Window.partitionBy("run_id").orderBy("starts").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        summaries.withColumn("opened", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
        .withColumn("closed", F.max(F.when(F.col("reset"), F.col("opened"))).over(earlier))
        .withColumn("missing", F.lit(limit) - F.col("opened") + F.coalesce("closed", F.lit(0)))
    )
    by_carry = F.col("missing").between(1, F.least("head", F.lit(limit - 1)))
    first = F.min(F.when(by_carry, F.struct("starts", "stretch", "missing")))
    merged = carried.groupBy("run_id").agg(F.min("fired").alias("fired"), first.alias("first"))
    return merged.select("run_id", "fired", "first.stretch", "first.missing").where(
        "fired is not null or stretch is not null"
    )


def fired_at(merged: DataFrame, polls: DataFrame) -> DataFrame:
    """``run_id, fired`` of merged stretches; ``polls`` has the lengths of the polls in them."""
    reached = polls.where("leading").select(
        "run_id", "stretch", F.col("length").alias("missing"), F.col("poll_ts").alias("at")
    )
    carried = merged.where("stretch is not null").drop("fired")
    carried = reached.join(carried, ["run_id", "stretch", "missing"]).select("run_id", "at")
    inside = merged.where("fired is not null").select("run_id", F.col("fired").alias("at"))
    return inside.unionByName(carried).groupBy("run_id").agg(F.min("at").alias("fired"))
