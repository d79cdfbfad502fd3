"""Time the headline queries; print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local threads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from batchloom import fixed_values as fixed  # noqa: E402
from batchloom.operators.aggregate import summarise  # noqa: E402
from batchloom.operators.enrich import enrich  # noqa: E402
from batchloom.operators.ordering import repartition_by  # noqa: E402
from batchloom.plans.batch_run import RunTables, run_generated  # noqa: E402
from batchloom.plans.queries import QUERIES  # noqa: E402
from batchloom.plans.staging import scratch_location  # noqa: E402
from batchloom.sinks.tables import ensure_database  # noqa: E402
from batchloom.sources.generate import generate_batch  # noqa: E402

HEADLINE = (
    "enrich_batch",
    "summary_by_category",
    "summary_by_band",
    "summary_by_part",
    "top_k",
    "top_k_large",
    "sort_desc",
    "repartition_rows",
    "repartition_summary",
    "append_readback",
    "batch_run_summary",
    "status_rollup",
    "resource_summary",
    "first_failure",
    "streak_guard",
    "streak_guard_one_run",
    "streak_guard_one_run_stream",
    "tail_n",
    "tail_one_source",
    "failed_worker_tail",
)
REPEATS = 3


def generated_summary(spark, rows, *, repartition_first=False):
    batch = enrich(generate_batch(spark, rows, batch_id="b1"))
    if repartition_first:
        batch = repartition_by(batch, fixed.DEFAULT_PARTITIONS, "category")
    return summarise(batch)


def default_run(spark):
    """The default generated batch as a whole run: 100,000 rows, 4 partitions."""
    name = f"bench_{uuid.uuid4().hex}"
    location = scratch_location(spark, name)
    ensure_database(spark, name, location)
    tables = RunTables(
        f"{name}.events", f"{name}.summary", f"{location}/events", f"{location}/summary"
    )
    return run_generated(spark, tables).summary


def workloads(spark, sf_dir):
    for name in HEADLINE:
        yield name, lambda name=name: QUERIES[name](spark, sf_dir)
    yield "default_run_100k", lambda: default_run(spark)
    yield "generated_summary_10m", lambda: generated_summary(spark, 10_000_000)
    yield "generated_summary_100m", lambda: generated_summary(spark, 100_000_000)
    if os.environ.get("BENCH_COMPARE"):
        yield "generated_summary_10m_repartition_first", lambda: generated_summary(
            spark, 10_000_000, repartition_first=True
        )


def seconds(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("batchloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, build in workloads(spark, sf_dir):
        seconds(build)
        times[name] = round(statistics.median(seconds(build) for _ in range(REPEATS)), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
