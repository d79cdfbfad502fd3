"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.plans.staging import scratch_location, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words, as a regular expression of either engine.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This computes it once, cuts its lineage and survives lost executors.
    """
    return stage(df, scratch_location(df.sparkSession, "llm"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The runs of other characters than white space; none for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(parts, lambda word: word != "")


def fold(key: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that hands free memory back to the system when it ends.

    Workers are used again by later tasks, and what one has once held would else count as theirs.
    """

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


#: Elements that ``scan`` takes at a time, so that growing arrays stay small.
CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(
    items: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    kind: str,
) -> Column:
    """``emit(state, item)`` of each item in order, an array of ``kind``; the state goes from
    ``start`` on by ``step(state, item)``. Null or empty items give an empty array.

    An array that grows by one is copied each time. So items are taken in chunks: first only the
    states at which chunks begin are gathered, then each chunk's results.
    """

    def run(all_items: Column) -> Column:
        last = F.floor((F.size(all_items) - 1) / CHUNK).cast("int")
        chunks = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice(all_items, i * CHUNK + 1, F.lit(CHUNK))
        )
        return let(chunks, through)

    def through(chunks: Column) -> Column:
        before = F.struct(start.alias("state"), F.slice(F.array(start), 1, 0).alias("states"))
        states = F.aggregate(
            chunks, before,
            lambda to, chunk: F.struct(
                F.aggregate(chunk, to["state"], step).alias("state"),
                F.concat(to["states"], F.array(to["state"])).alias("states"),
            ),
        )["states"]
        none = F.expr(f"cast(array() as array<{kind}>)")
        return F.flatten(F.zip_with(
            chunks, states,
            lambda chunk, state: F.aggregate(
                chunk, F.struct(state.alias("state"), none.alias("out")),
                lambda to, x: F.struct(
                    step(to["state"], x).alias("state"),
                    F.concat(to["out"], F.array(emit(to["state"], x).cast(kind))).alias("out"),
                ),
            )["out"],
        ))

    empty = F.expr(f"cast(array() as array<{kind}>)")
    return let(items, lambda x: F.when(F.size(x) > 0, run(x)).otherwise(empty))
