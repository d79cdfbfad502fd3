"""The streaming operators, fed file by file."""

import random
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from batchloom import schemas
from batchloom.plans.queries import QUERIES
from batchloom.operators import status as S
from batchloom.operators.logs import tail_lines
from batchloom.operators.status import rollup_guard, status_rollup
from batchloom.sources.generate import inline_rows
from batchloom.streaming import monitor
from batchloom.streaming.ledger import Ledger
from tests.conftest import TESTDATA
from tests.test_logs import lines_of
from tests.test_status import POLLS, START, keyed, random_polls, read_in_order, status_rows


@pytest.fixture(params=["timestamp_ntz", "timestamp"])
def feed(request, spark, location):
    """Write status rows of some polls into the watched folder, as a later file."""
    folder = f"{location}/status"

    def write(*numbers):
        chosen = {START + timedelta(seconds=5 * number) for number in numbers}
        rows = [row for row in status_rows(POLLS) if row[1] in chosen]
        status = inline_rows(spark, rows, schemas.STATUS).select(as_fed)
        status.coalesce(1).write.mode("append").parquet(folder)

    as_fed = [
        F.col(name).cast(request.param) if name == "poll_ts" else F.col(name)
        for name in schemas.STATUS.names
    ]
    write.folder = folder
    write.schema = inline_rows(spark, [], schemas.STATUS).select(as_fed).schema
    return write


@pytest.mark.parametrize("files", [1, 2, None])
@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4, 5, 6, 7, 8], [8, 3, 5, 0, 7, 1, 2, 6, 4]])
def test_rollup_does_not_depend_on_files_and_batches(spark, location, feed, files, order):
    out, checkpoint = f"{location}/rollup", f"{location}/checkpoint"
    status = inline_rows(spark, [], feed.schema)
    # One poll comes in two files, whose rows lie in different batches.
    for step in (order[:4], order[4:]):
        for number in step:
            feed(number)
        stream = monitor.file_stream(spark, feed.folder, feed.schema, files)
        monitor.drain_rollup(stream, out, checkpoint)
    found = monitor.rollup_so_far(spark, status, out)
    rollup, _, fired, _, _ = read_in_order(POLLS, 3)
    assert keyed(found, 2) == rollup
    assert keyed(rollup_guard(found), 1) == {run: (at,) for run, at in fired.items()}
    assert found.schema.simpleString() == status_rollup(status).schema.simpleString()


def test_failed_worker_is_reported_once(spark, location, feed):
    out, checkpoint = f"{location}/failed", f"{location}/checkpoint"
    _, failures, _, _, _ = read_in_order(POLLS, 3)
    for numbers in [(2, 3), (0, 1), (4,), (5,), (7, 8), (6,)]:
        feed(*numbers)
        if numbers in [(4,), (5,)]:
            continue
        stream = monitor.file_stream(spark, feed.folder, feed.schema, files_per_batch=1)
        monitor.drain_failed_workers(stream, out, checkpoint)
    found = monitor.failed_so_far(spark, inline_rows(spark, [], feed.schema), out)
    assert sorted(tuple(row) for row in found.collect()) == sorted(failures)


def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    events = spark.read.parquet(str(TESTDATA / "sf0.001" / "events.parquet"))
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    kept = ("status_rollup", "streak_guard", "streak_guard_one_run", "resource_summary", "tail_n")
    for name in (*kept, "distinct_workers", "failed_workers"):
        batch = QUERIES[name](spark, str(tmp_path)) if name in QUERIES else None
        found = QUERIES[f"{name}_stream"](spark, str(tmp_path))
        if batch is not None:
            assert sorted(found.collect()) == sorted(batch.select(found.columns).collect())
        else:
            assert found.count() == found.distinct().count() > 0


def files_below(folder):
    return [str(p) for p in Path(folder).rglob("part-*.parquet")]


def split_files(spark, rows, schema, folder, files, seed):
    """Any row may come in any file, so polls and streaks are torn apart."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for i in range(files):
        part = inline_rows(spark, rows[i::files], schema)
        part.coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seconds", [5, 35, 10**6])
@pytest.mark.parametrize("limit", [1, 3])
def test_live_guard_and_peaks_for_any_split(spark, location, seconds, limit):
    polls = POLLS | random_polls(seconds + limit, runs=6, polls=25)
    schema, folder, out = schemas.STATUS, f"{location}/status", f"{location}/out"
    empty = inline_rows(spark, [], schema)
    seen = []
    for step, files in enumerate((3, 4)):
        part = {run: seq[:12] if step == 0 else [{}] * 12 + seq[12:] for run, seq in polls.items()}
        later = START + timedelta(seconds=5 * 12)
        rows = [r for r in status_rows(part) if (r[1] < later) == (step == 0)]
        seen += rows
        split_files(spark, rows, schema, folder, files, limit)
        stream = monitor.file_stream(spark, folder, schema, files_per_batch=1)
        monitor.drain_stretches(stream, f"{out}/p", f"{location}/cp", limit, seconds=seconds, fan=3)
        stream = monitor.file_stream(spark, folder, schema, files_per_batch=1)
        monitor.drain_workers(stream, f"{out}/w", f"{location}/cw", fan=3)
        whole = inline_rows(spark, seen, schema)
        found = monitor.guard_so_far(spark, empty, f"{out}/p", limit, seconds=seconds)
        assert sorted(found.collect()) == sorted(S.streak_guard(whole, limit).collect())
        found = monitor.resources_so_far(
            spark, empty, f"{out}/p", f"{out}/w", 2, limit=limit, seconds=seconds
        )
        want = S.resource_summary(whole, 2)
        assert sorted(found.collect()) == sorted(want.select(found.columns).collect())


def test_a_batch_that_touches_one_stretch_reads_no_other(spark, location):
    """Far apart in time: the polls of the first file are gone when the second comes."""
    schema, folder, out = schemas.STATUS, f"{location}/status", f"{location}/out"
    for hour in (0, 5):
        at = START + timedelta(hours=hour)
        rows = [("r", at + timedelta(seconds=i), "w", "Failed") for i in range(5)]
        inline_rows(spark, rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = monitor.file_stream(spark, folder, schema)
        monitor.drain_stretches(stream, out, f"{location}/c", 7)
        for file in Path(f"{out}/polls").rglob("part-*"):
            if hour == 0:
                file.write_bytes(b"no longer readable")
    summaries, _ = monitor._stretches(spark, inline_rows(spark, [], schema), out, 7, 3600)
    assert sorted((r["head"], r["tail"], r["reset"]) for r in summaries.collect()) == [(5, 5, False)] * 2


def test_distinct_workers_live(spark, location):
    schema, folder, out = schemas.STATUS, f"{location}/status", f"{location}/out"
    rows = [("r", START, f"w{i % 700}", "Running") for i in range(3_000)]
    rows += [("none", START, None, None), ("few", START, "", "Running"), ("few", START, "a", "x")]
    split_files(spark, rows, schema, folder, 7, 1)
    stream = monitor.file_stream(spark, folder, schema, files_per_batch=1)
    monitor.drain_workers(stream, out, f"{location}/c", fan=2)
    empty = inline_rows(spark, [], schema)
    assert keyed(monitor.workers_so_far(spark, empty, out), 1) == {"r": (700,), "none": (0,), "few": (1,)}
    rough = keyed(monitor.workers_so_far(spark, empty, out, approximate=True), 1)
    assert abs(rough["r"][0] - 700) < 35 and rough["none"] == (0,) and rough["few"] == (1,)


@pytest.mark.parametrize("files", [1, 5, 11])
@pytest.mark.parametrize("n", [1, 4])
def test_live_tails_for_any_split(spark, location, files, n):
    log = inline_rows(spark, lines_of(files), "source string, ts timestamp_ntz, seq int, line string")
    folder, out = f"{location}/log", f"{location}/out"
    for part in log.randomSplit([1.0] * files, 3):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = monitor.file_stream(spark, folder, log.schema, files_per_batch=1)
    monitor.drain_tails(stream, out, f"{location}/c", n, fan=3)
    found = monitor.tails_so_far(spark, log.limit(0), out, n)
    assert sorted(map(str, found.collect())) == sorted(map(str, tail_lines(log, n).collect()))


def test_a_ledger_reads_no_more_files_as_it_grows(spark, location):
    """Numbers 0..N-1 in batches of one, some of them written again after a failure."""
    ledger = Ledger(f"{location}/l", lambda rows: rows.distinct().coalesce(1), fan=4)
    schema = spark.range(1).schema
    opened = []
    for number in range(19):
        for _ in range(2 if number in (3, 4, 8, 13, 16) else 1):
            known = ledger.before(spark, schema, number)
            if known is not None:
                assert sorted(r[0] for r in known.collect()) == list(range(number))
                opened.append(len(known.inputFiles()))
            ledger.write(spark.range(number, number + 1).coalesce(1), number)
        assert sorted(r[0] for r in ledger.so_far(spark, schema).collect()) == list(range(number + 1))
    assert max(opened) <= 5
    assert len(files_below(f"{location}/l")) <= 2 * 5


def test_failed_workers_over_many_batches(spark, location):
    """Every batch reports all workers so far; the files it opens do not grow with history."""
    schema, folder, out = schemas.STATUS, f"{location}/status", f"{location}/failed"
    for i in range(9):
        rows = [("r", START, f"w{j}", "Failed") for j in range(i + 1)]
        inline_rows(spark, rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = monitor.file_stream(spark, folder, schema, files_per_batch=1)
    monitor.drain_failed_workers(stream, out, f"{location}/c", fan=3)
    found = monitor.failed_so_far(spark, inline_rows(spark, [], schema), out)
    assert sorted(r["worker"] for r in found.collect()) == [f"w{j}" for j in range(9)]
    batches = {Path(f).parent.name for f in files_below(out)}
    assert len(batches) <= 2 * 4
