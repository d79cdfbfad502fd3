"""The run-status and log operators on a stream, for a run that is still going on.

Each micro-batch is reduced on its own and written under its number; readers put together what
all batches have written. Counts add up, distinct workers unite, the last lines of last lines are
the last lines: so no row can come too late, whatever the order of the files and their split into
batches, and the stream holds no state. A batch that is run again after a failure overwrites its
own output.

What only depends on whole polls (the streak guard, the peak of running workers) is kept per
stretch of time. A batch adds its counts to the polls of the stretches that it touches and sums
up these stretches anew; all others keep the summary that they have. A reader merges the last
summary of each stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from batchloom import fixed_values as fixed
from batchloom.functions.times import utc_instant
from batchloom.operators.logs import tail_lines
from batchloom.operators.status import (
    all_failed,
    distinct_workers,
    failed_rows,
    fired_at,
    merge_stretches,
    status_rollup,
    stretch_summaries,
    with_lengths,
    worker_of,
)
from batchloom.streaming.ledger import FAN, Ledger

_BATCH = T.StructField("stream_batch", T.LongType())
_STRETCH = T.StructField("stretch", T.LongType())
#: Seconds of a stretch. Longer ones make fewer summaries, shorter ones less to sum up anew.
STRETCH_SECONDS = 3600


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New Parquet files of a folder, or of a path pattern, as a stream, oldest first.

    ``files_per_batch`` keeps a large backlog from being read as one batch.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _drain(
    stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Take in what has arrived so far, batch by batch, and wait for the end.

    A later call with the same checkpoint goes on where this one stopped.
    """
    running = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return running


def _written(spark: SparkSession, location: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, _BATCH])).parquet(location)


def drain_rollup(stream: DataFrame, location: str, checkpoint: str) -> StreamingQuery:
    """Write the workers per poll of each batch; a poll may go on in any later batch."""

    def write(rows: DataFrame, number: int) -> None:
        status_rollup(rows).write.mode("overwrite").parquet(f"{location}/{_BATCH.name}={number}")

    return _drain(stream, checkpoint, write)


def rollup_so_far(spark: SparkSession, status: DataFrame, location: str) -> DataFrame:
    """Workers per poll over all batches written; ``status`` gives the types."""
    schema = status_rollup(status).schema
    keys = ["run_id", "poll_ts"]
    counts = [name for name in schema.names if name not in keys]
    return _written(spark, location, schema).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))


def failed_workers(status: DataFrame) -> DataFrame:
    return failed_rows(status).select("run_id", "worker").distinct()


def _new(found: DataFrame, ledger: Ledger, number: int) -> DataFrame:
    """The rows ``run_id, worker`` that no earlier batch has written."""
    known = ledger.before(found.sparkSession, found.schema, number)
    if known is None:
        return found
    same = F.col("f.run_id").eqNullSafe(F.col("k.run_id")) & (F.col("f.worker") == F.col("k.worker"))
    return found.alias("f").join(known.alias("k"), same, "left_anti")


def _failed_ledger(location: str, fan: int) -> Ledger:
    return Ledger(location, DataFrame.distinct, fan)


def drain_failed_workers(
    stream: DataFrame, location: str, checkpoint: str, *, fan: int = FAN
) -> StreamingQuery:
    """Write each failed worker of a run once, in the batch in which it is first seen.

    A batch is made distinct map-side, so a worker with most of the rows costs each task one
    row, and is then held against what earlier batches have reported: one merged base and less
    than ``fan`` batches.
    """
    ledger = _failed_ledger(location, fan)
    return _drain(
        stream,
        checkpoint,
        lambda rows, number: ledger.write(_new(failed_workers(rows), ledger, number), number),
    )


def failed_so_far(spark: SparkSession, status: DataFrame, location: str) -> DataFrame:
    """The failed workers reported by all batches; ``status`` gives the types."""
    return _failed_ledger(location, FAN).so_far(spark, failed_workers(status).schema)


# Distinct workers


def _workers(status: DataFrame) -> DataFrame:
    """The workers of each run, and a row without worker for each run."""
    return status.select("run_id", worker_of().alias("worker")).distinct()


def _sketches(status: DataFrame) -> DataFrame:
    return status.groupBy("run_id").agg(F.hll_sketch_agg(worker_of()).alias("sketch"))


def _united(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("run_id").agg(F.hll_union_agg("sketch").alias("sketch"))


def drain_workers(
    stream: DataFrame, location: str, checkpoint: str, *, fan: int = FAN
) -> StreamingQuery:
    """Write the workers of a run that are new in each batch, and a sketch of all in it.

    The sketches are a few kilobytes a run and unite without the workers themselves; the exact
    count needs those.
    """
    exact = Ledger(f"{location}/workers", DataFrame.distinct, fan)
    rough = Ledger(f"{location}/sketches", _united, fan)

    def write(rows: DataFrame, number: int) -> None:
        found = _workers(rows).na.fill("", ["worker"])
        exact.write(_new(found, exact, number), number)
        rough.write(_sketches(rows), number)

    return _drain(stream, checkpoint, write)


def workers_so_far(
    spark: SparkSession, status: DataFrame, location: str, *, approximate: bool = False
) -> DataFrame:
    """Different workers seen in each run by all batches; ``status`` gives the types.

    The approximate count only reads the sketches.
    """
    if approximate:
        united = Ledger(f"{location}/sketches", _united).so_far(spark, _sketches(status).schema)
        count = F.hll_sketch_estimate("sketch").alias("distinct_workers")
        return united.select("run_id", count)
    workers = Ledger(f"{location}/workers", DataFrame.distinct)
    return distinct_workers(workers.so_far(spark, _workers(status).schema))


# Polls by stretch


def _stretch(polls: DataFrame, seconds: int) -> Column:
    """The stretch of time that a poll lies in, the same in any time zone."""
    at = F.col("poll_ts")
    if isinstance(polls.schema["poll_ts"].dataType, T.TimestampNTZType):
        at = utc_instant(at)
    return F.floor(F.unix_seconds(at) / seconds).alias(_STRETCH.name)


def _polls(status: DataFrame, seconds: int) -> DataFrame:
    rollup = status_rollup(status)
    return rollup.select("*", _stretch(rollup, seconds))


def _summaries(polls: DataFrame, limit: int, number: int) -> DataFrame:
    lengths = with_lengths(polls.withColumn("bad", all_failed()))
    peak = F.max("running").alias("peak_running")
    return stretch_summaries(lengths, limit, peak).withColumn("as_of", F.lit(number).cast("long"))


def _latest(summaries: DataFrame) -> DataFrame:
    """The last summary of each stretch."""
    rest = [c for c in summaries.columns if c not in ("run_id", "stretch")]
    last = F.max_by(F.struct(*rest), "as_of").alias("last")
    return summaries.groupBy("run_id", "stretch").agg(last).select("run_id", "stretch", "last.*")


def _read_polls(
    spark: SparkSession, schema: T.StructType, location: str, stretches: list[int]
) -> DataFrame:
    """The counts that batches have added to the polls of some stretches."""
    if not stretches:
        return spark.createDataFrame([], T.StructType([*schema.fields, _BATCH]))
    kept = [f for f in schema.fields if f.name != _STRETCH.name]
    reader = spark.read.schema(T.StructType([*kept, _STRETCH, _BATCH]))
    reader = reader.option("basePath", f"{location}/polls")
    return reader.parquet(*(f"{location}/polls/{_STRETCH.name}={s}" for s in stretches))


def _whole_polls(counts: DataFrame) -> DataFrame:
    keys = ["run_id", "stretch", "poll_ts"]
    added = [c for c in counts.columns if c not in (*keys, _BATCH.name)]
    return counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in added))


def drain_stretches(
    stream: DataFrame,
    location: str,
    checkpoint: str,
    limit: int = fixed.FAILED_POLLS_LIMIT,
    *,
    seconds: int = STRETCH_SECONDS,
    fan: int = FAN,
) -> StreamingQuery:
    """Keep the polls by stretch and, of each stretch, one row of what it amounts to.

    Polls without a time are left out.

    Each batch reads again only the stretches in which it has polls. How many those are is
    bounded by the time that its polls span.
    """
    ledger = Ledger(f"{location}/summaries", _latest, fan)

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        counts = _polls(rows, seconds).persist()
        touched = [r[0] for r in counts.select("stretch").distinct().collect() if r[0] is not None]
        numbered = counts.where("stretch is not null").withColumn(_BATCH.name, F.lit(number))
        # One stretch may hold all rows: rebalanced files keep within the advised size.
        numbered.hint("rebalance", F.col("stretch")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(_STRETCH.name, _BATCH.name).parquet(f"{location}/polls")
        seen = _read_polls(spark, counts.schema, location, touched)
        whole = _whole_polls(seen.where(F.col(_BATCH.name) <= number))
        ledger.write(_summaries(whole, limit, number), number)
        counts.unpersist()

    return _drain(stream, checkpoint, write)


def _stretches(
    spark: SparkSession, status: DataFrame, location: str, limit: int, seconds: int
) -> tuple[DataFrame, T.StructType]:
    polls = _polls(status, seconds)
    schema = _summaries(_whole_polls(polls), limit, 0).schema
    return Ledger(f"{location}/summaries", _latest).so_far(spark, schema), polls.schema


def guard_so_far(
    spark: SparkSession,
    status: DataFrame,
    location: str,
    limit: int = fixed.FAILED_POLLS_LIMIT,
    *,
    seconds: int = STRETCH_SECONDS,
) -> DataFrame:
    """The streak guard over all batches, from the summaries of the stretches.

    ``limit`` and ``seconds`` must be those that the stretches were drained with; ``status``
    gives the types. Polls are only read of the stretches in which a streak that came in from
    before reached the limit.
    """
    summaries, schema = _stretches(spark, status, location, limit, seconds)
    merged = merge_stretches(summaries, limit)
    needed = [r[0] for r in merged.select("stretch").distinct().collect() if r[0] is not None]
    polls = _whole_polls(_read_polls(spark, schema, location, needed))
    return fired_at(merged, with_lengths(polls.withColumn("bad", all_failed())))


def resources_so_far(
    spark: SparkSession,
    status: DataFrame,
    stretches: str,
    workers: str,
    slots_per_worker: int = fixed.SLOTS_PER_WORKER,
    *,
    limit: int = fixed.FAILED_POLLS_LIMIT,
    seconds: int = STRETCH_SECONDS,
) -> DataFrame:
    """The resource summary over all batches of ``drain_stretches`` and ``drain_workers``."""
    summaries, _ = _stretches(spark, status, stretches, limit, seconds)
    peaks = summaries.groupBy("run_id").agg(F.max("peak_running").alias("peak_running"))
    counts = workers_so_far(spark, status, workers)
    both = counts.join(peaks.withColumnRenamed("run_id", "run"), F.col("run_id").eqNullSafe(F.col("run")))
    slots = (F.col("peak_running") * slots_per_worker).alias("peak_slots")
    return both.select("run_id", "distinct_workers", "peak_running", slots)


# Log tails


def _tail_ledger(location: str, n: int, order: Sequence[str], source: str, fan: int) -> Ledger:
    return Ledger(location, lambda lines: tail_lines(lines, n, order, source=source), fan)


def drain_tails(
    stream: DataFrame,
    location: str,
    checkpoint: str,
    n: int = fixed.WORKER_TAIL,
    order: Sequence[str] = ("ts",),
    *,
    source: str = "source",
    fan: int = FAN,
) -> StreamingQuery:
    """Write the last ``n`` lines of each source in each batch; merged, they are at most as many."""
    ledger = _tail_ledger(location, n, order, source, fan)
    return _drain(
        stream, checkpoint, lambda rows, number: ledger.write(ledger.merge(rows), number)
    )


def tails_so_far(
    spark: SparkSession,
    log: DataFrame,
    location: str,
    n: int = fixed.WORKER_TAIL,
    order: Sequence[str] = ("ts",),
    *,
    source: str = "source",
) -> DataFrame:
    """The last ``n`` lines of each source over all batches; ``log`` gives the types."""
    return _tail_ledger(location, n, order, source, FAN).so_far(spark, log.schema)
