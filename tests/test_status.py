"""Run-status operators against a sequential reading of the polls."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from batchloom import schemas
from batchloom.functions.phases import is_success, is_terminal, phase_or_pending
from batchloom.functions.times import hour_of, utc_clock, utc_instant
from batchloom.operators import status as S
from batchloom.sources.generate import inline_rows

START = datetime(2024, 1, 1)
R, P, X, OK = "Running", "Pending", "Failed", "Succeeded"

# Per poll: the phase of each worker.
POLLS = {
    "recovers": [
        {},
        {"w1": P, "w2": ""},
        {"w1": X, "w2": X},
        {"w1": X, "w2": X},
        {"w1": X, "w2": R},
        {"w1": X, "w2": X},
        {"w1": X, "w2": X},
        {"w1": X, "w2": X},
        {"w1": X, "w2": X},
    ],
    "gap": [{"w1": X}, {"w1": X}, {}, {"w1": X}, {"w1": X}],
    "done": [{"w1": R, "w2": R, "w3": R}, {"w1": OK, "w2": X}, {"w1": OK, "w2": X, "": X}],
}


def status_rows(polls):
    for run, sequence in polls.items():
        for number, workers in enumerate(sequence):
            at = START + timedelta(seconds=5 * number)
            for worker, phase in (workers or {None: None}).items():
                yield (run, at, worker, phase)


def read_in_order(polls, limit):
    """The monitor's state, poll by poll."""
    rollup, failures, fired, peaks, seen = {}, {}, {}, {}, {}
    for run, sequence in polls.items():
        streak, peaks[run], seen[run] = 0, 0, set()
        for number, workers in enumerate(sequence):
            at = START + timedelta(seconds=5 * number)
            phases = [phase for worker, phase in workers.items() if worker]
            seen[run] |= {worker for worker in workers if worker}
            counts = (len(phases), phases.count(R), phases.count(P), phases.count(X))
            rollup[run, at] = counts
            peaks[run] = max(peaks[run], counts[1])
            for worker, phase in workers.items():
                if worker and phase == X:
                    failures.setdefault((run, worker), at)
            streak = streak + 1 if counts[0] and counts[3] == counts[0] else 0
            if streak == limit:
                fired.setdefault(run, at)
    return rollup, failures, fired, peaks, {run: len(names) for run, names in seen.items()}


def keyed(df, keys):
    return {
        tuple(row)[:keys] if keys > 1 else row[0]: tuple(row)[keys:] for row in df.collect()
    }


def random_polls(seed, runs=12, polls=60):
    rng = random.Random(seed)
    result = {}
    for run in range(runs):
        bad = rng.choice([0.3, 0.6, 0.9])
        result[f"r{run}"] = [
            {} if rng.random() < 0.05 else
            {
                f"w{w}": X if rng.random() < bad else rng.choice([R, P, OK, ""])
                for w in range(rng.randint(1, 2))
            }
            for _ in range(polls)
        ]
    return result


@pytest.mark.parametrize("polls", [POLLS, random_polls(1), random_polls(2)], ids=["hand", "r1", "r2"])
@pytest.mark.parametrize("limit", [1, 3])
def test_against_sequential_reading(spark, polls, limit):
    status = inline_rows(spark, list(status_rows(polls)), schemas.STATUS).repartition(5)
    rollup, failures, fired, peaks, seen = read_in_order(polls, limit)

    assert keyed(S.status_rollup(status), 2) == rollup
    assert keyed(S.first_failure(status), 2) == {key: (at,) for key, at in failures.items()}
    assert keyed(S.distinct_workers(status), 1) == {run: (n,) for run, n in seen.items()}
    assert keyed(S.resource_summary(status, 2), 1) == {
        run: (seen[run], peaks[run], 2 * peaks[run]) for run in polls
    }
    assert keyed(S.streak_guard(status, limit), 1) == {run: (at,) for run, at in fired.items()}


def test_hand_made_guard(spark):
    status = inline_rows(spark, list(status_rows(POLLS)), schemas.STATUS)
    assert keyed(S.streak_guard(status), 1) == {"recovers": (START + timedelta(seconds=35),)}


def first_streaks(flags, limit):
    result = {}
    for run, sequence in flags.items():
        streak = 0
        for number, bad in enumerate(sequence):
            streak = streak + 1 if bad else 0
            if streak == limit:
                result.setdefault(run, (START + timedelta(seconds=number),))
    return result


@pytest.mark.parametrize("pieces", [1, 7, 40])
@pytest.mark.parametrize("limit", [1, 2, 5, 30])
def test_streaks_across_pieces(spark, pieces, limit):
    """Small pieces, so that streaks span several of them; one run holds most polls."""
    rng = random.Random(pieces * 100 + limit)
    flags = {"hot": [rng.random() < 0.9 for _ in range(400)], "all": [True] * 60, "none": [False] * 20}
    flags |= {f"r{i}": [rng.random() < 0.7 for _ in range(rng.randint(1, 12))] for i in range(10)}
    rows = [
        (run, START + timedelta(seconds=number), bad)
        for run, sequence in flags.items()
        for number, bad in enumerate(sequence)
    ]
    rng.shuffle(rows)
    polls = inline_rows(spark, rows, "run_id string, poll_ts timestamp_ntz, bad boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = keyed(S.first_streak(polls, limit), 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == first_streaks(flags, limit)


def test_streak_limit_must_be_positive(spark):
    status = inline_rows(spark, [], schemas.STATUS)
    with pytest.raises(ValueError):
        S.streak_guard(status, 0)
    assert S.streak_guard(status).collect() == []


def test_approximate_workers(spark):
    status = spark.range(1000).select(
        F.lit("r").alias("run_id"), F.col("id").cast("string").alias("worker")
    )
    found = S.distinct_workers(status, approximate=True).first()["distinct_workers"]
    assert abs(found - 1000) < 100


def test_phases(spark):
    phases = inline_rows(
        spark, [(None,), ("",), (P,), (R,), (OK,), (X,), ("Error",)], "phase string"
    )
    phase = F.col("phase")
    found = phases.select(phase_or_pending(phase), is_terminal(phase), is_success(phase)).collect()
    assert [tuple(row) for row in found] == [
        (P, False, False),
        (P, False, False),
        (P, False, False),
        (R, False, False),
        (OK, True, True),
        (X, True, False),
        ("Error", True, False),
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zoneless_times(spark, zone):
    """02:30 on this day does not exist in one of the zones."""
    moment = datetime(2024, 3, 10, 2, 30, 1, 123456)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = inline_rows(spark, [(moment,)], "ts timestamp_ntz")
        ts = F.col("ts")
        found = row.select(hour_of(ts), utc_clock(utc_instant(ts))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(found) == (datetime(2024, 3, 10, 2), moment)
