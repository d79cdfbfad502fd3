"""Log tails and event listings."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from batchloom import schemas
from batchloom.operators import logs
from batchloom.sources.generate import inline_rows

START = datetime(2024, 1, 1)


def lines_of(seed):
    """One source holds a third of all lines, one holds two."""
    rng = random.Random(seed)
    lines = []
    for number in range(600):
        source = rng.choice(["hot", "hot", "a", "b", "c", "d"])
        lines.append((source, START + timedelta(seconds=number // 2), number, f"line {number}"))
    lines += [("few", START, 0, "x"), ("few", START, 1, "y")]
    rng.shuffle(lines)
    return lines


@pytest.mark.parametrize("n", [1, 3, 80, 1500])
@pytest.mark.parametrize("split", [1, 4])
def test_tail(spark, n, split):
    lines = lines_of(n)
    log = inline_rows(spark, lines, "source string, ts timestamp_ntz, seq int, line string")
    found = logs.tail_lines(log.repartition(9), n, ["ts", "seq"], split=split)
    assert found.columns == log.columns
    expected = []
    for source in {line[0] for line in lines}:
        own = sorted((line for line in lines if line[0] == source), key=lambda l: (l[1], l[2]))
        expected += own[-n:]
    assert sorted(tuple(row) for row in found.collect()) == sorted(expected)


@pytest.mark.parametrize("n", [2, 1500])
def test_tail_has_one_result_on_any_layout(spark, n):
    lines = [("s", START, str(i), f"{i} of them") for i in range(2000)]
    log = inline_rows(spark, lines, "source string, ts timestamp_ntz, `a.b` string, __part string")
    tails = [sorted(logs.tail_lines(rows, n).collect()) for rows in (log.repartition(7), log.coalesce(1))]
    assert tails[0] == tails[1] and len(tails[0]) == n
    assert tails[0][0].__fields__ == log.columns


def test_tail_parameters(spark):
    log = inline_rows(spark, [], schemas.LOG)
    with pytest.raises(ValueError):
        logs.tail_lines(log, 0)


def object_rows(spark):
    rows = [
        ("w1", START + timedelta(seconds=2), "Normal", "Started", "two"),
        ("w2", START, "Warning", "BackOff", "other"),
        ("w1", START + timedelta(seconds=1), "Warning", "Failed", "one"),
    ]
    return inline_rows(spark, rows, schemas.OBJECT_EVENT)


def test_object_events(spark):
    one = logs.object_events(object_rows(spark), "w1")
    assert [tuple(row) for row in one.collect()] == [
        ("Warning", "Failed", "one"),
        ("Normal", "Started", "two"),
    ]
    everything = logs.object_events(object_rows(spark))
    assert [row["message"] for row in everything.collect()] == ["one", "two", "other"]


def test_failed_workers(spark):
    status = inline_rows(
        spark,
        [("r", START, "w1", "Failed"), ("r", START, "w2", "Running"), ("r", START, None, "Failed")],
        schemas.STATUS,
    )
    failed = logs.of_failed_workers(object_rows(spark), status, "object")
    assert sorted(failed.select("message").toPandas()["message"]) == ["one", "two"]
    assert failed.filter(F.col("object") != "w1").count() == 0
