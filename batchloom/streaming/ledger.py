"""What the micro-batches of a stream have written, merged from time to time.

A ledger holds one folder per micro-batch. ``FAN`` batches make a generation; the first batch of
the next one merges what the generations before amount to into a base of its own, and empties
the generation before the last. So whoever reads the ledger opens one base and less than ``FAN``
batches, however long the stream has been going on.

Each folder depends on the batch's number and on folders written before it only, so a batch that
is run again after a failure writes the same folders again, merged base included: the two
generations that this needs are kept. Readers outside the stream should read between batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 16
GENERATION, BATCH = "generation", "stream_batch"
#: The batch number of a base.
BASE = -1


@dataclass(frozen=True)
class Ledger:
    """A ledger at ``location``; ``merge`` reduces the rows of several batches to what they
    amount to. Merging must not depend on how batches are grouped."""

    location: str
    merge: Callable[[DataFrame], DataFrame]
    fan: int = FAN

    def before(self, spark: SparkSession, schema: T.StructType, number: int) -> DataFrame | None:
        """All that batches below ``number`` have written, not merged; None if there are none."""
        generation = max(number - 1, 0) // self.fan
        return self._read(spark, schema, generation, number)

    def write(self, rows: DataFrame, number: int) -> None:
        """Write the rows of batch ``number``; with the first one of a generation also its base."""
        generation = number // self.fan
        if generation and number % self.fan == 0:
            earlier = self._read(rows.sparkSession, rows.schema, generation - 1, number)
            self._write(self.merge(earlier), generation, BASE)
            if generation > 1:
                old = f"{self.location}/{GENERATION}={generation - 2}"
                earlier.limit(0).withColumn(BATCH, F.lit(0)).write.mode("overwrite").partitionBy(
                    BATCH
                ).parquet(old)
        self._write(rows, generation, number)

    def so_far(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """What all batches amount to."""
        places = [T.StructField(GENERATION, T.LongType()), T.StructField(BATCH, T.LongType())]
        rows = spark.read.schema(T.StructType([*schema.fields, *places])).parquet(self.location)
        # A base holds whatever came before it, so rows of any kind show the last generation.
        last = rows.agg(F.max(GENERATION)).first()[0] or 0
        return self.merge(rows.filter(F.col(GENERATION) == last).drop(GENERATION, BATCH))

    def _read(
        self, spark: SparkSession, schema: T.StructType, generation: int, end: int
    ) -> DataFrame | None:
        """The base of a generation and its batches below ``end``."""
        batches = [BASE] if generation else []
        batches += range(generation * self.fan, end)
        if not batches:
            return None
        return spark.read.schema(schema).parquet(*(self._folder(generation, b) for b in batches))

    def _write(self, rows: DataFrame, generation: int, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self._folder(generation, batch))

    def _folder(self, generation: int, batch: int) -> str:
        return f"{self.location}/{GENERATION}={generation}/{BATCH}={batch}"
