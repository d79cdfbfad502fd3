"""Large top-k by threshold, and repartitioning that splits hot keys only."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from batchloom.operators import hot_keys as H
from batchloom.operators import selection as S
from batchloom.operators.ordering import sort_rows
from batchloom.plans.queries import QUERIES
from batchloom.sources.generate import inline_rows
from tests.conftest import TESTDATA
from tests.test_plans import plan_of


def mixed_rows(spark, kind, rows=4_000):
    """Values with many ties, NULLs and, for numbers, NaN and infinities."""
    rng = random.Random(kind)
    odd = {"double": [float("nan"), float("inf"), -0.0, None], "string": ["", "é", "zz" * 9, None]}
    made = {
        "double": lambda: rng.choice([rng.gauss(0, 100), float(rng.randint(0, 3))]),
        "string": lambda: rng.choice("abcé") * rng.randint(0, 12),
        "long": lambda: rng.randint(-50, 50) * 10**17,
        "boolean": lambda: rng.random() < 0.5,
        "date": lambda: None,
        "array<int>": lambda: [rng.randint(0, 9)],
    }[kind]
    values = [
        rng.choice(odd.get(kind, [None])) if rng.random() < 0.1 else made() for _ in range(rows)
    ]
    return inline_rows(spark, list(enumerate(values)), f"id int, v {kind}").repartition(7)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("kind", ["double", "string", "long", "boolean", "date", "array<int>"])
def test_any_k_of_any_type(spark, kind, descending):
    rows = mixed_rows(spark, kind)
    ordered = [r["id"] for r in sort_rows(rows, "v", descending=descending).collect()]
    for k in (1, 1_999, 5_000):
        found = S.select_top(rows, k, "v", descending=descending, parts=6)
        assert found.columns == rows.columns
        assert [r["id"] for r in found.collect()] == ordered[:k]


def test_copies_are_cut_exactly(spark):
    rows = spark.range(9_000).select((F.col("id") % 3).alias("v"))
    found = S.select_top(rows, 4_000, "v", parts=8)
    assert Counter(r["v"] for r in found.collect()) == {2: 3_000, 1: 1_000}


def test_large_k_against_a_plain_sort(spark):
    lines = spark.read.parquet(str(TESTDATA / "sf0.1" / "lineitem.parquet"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_extendedprice")
    found = S.top_k(lines, 100_000, "l_extendedprice")
    want = lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100_000)
    assert found.collect() == want.collect()


def test_threshold_reaches_the_scan(spark):
    lines = spark.read.parquet(str(TESTDATA / "sf0.01" / "lineitem.parquet"))
    inside = S.threshold(lines, 12_000, "l_extendedprice")
    chosen = lines.filter(inside)
    assert "GreaterThanOrEqual(l_extendedprice" in plan_of(chosen)
    assert 12_000 <= chosen.count() < 15_000


def test_a_wrong_sketch_changes_nothing(spark, monkeypatch):
    rows = spark.range(5_000).select(F.col("id").alias("v"))
    monkeypatch.setattr(S, "threshold", lambda *_, **__: F.col("v") > 4_990)
    assert [r["v"] for r in S.select_top(rows, 30, "v").collect()] == list(range(4_999, 4_969, -1))


def test_no_task_holds_k_rows(spark):
    plan = plan_of(QUERIES["top_k_large"](spark, str(TESTDATA / "sf0.01")))
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "SinglePartition" not in plan
    few = plan_of(S.top_k(spark.range(10**6), S.LARGE_K, "id"))
    assert "TakeOrderedAndProject" in few


def test_empty_input(spark):
    rows = inline_rows(spark, [], "v int, w string")
    assert S.select_top(rows, 20_000, "v").collect() == []
    with pytest.raises(ValueError):
        S.select_top(rows, 0, "v")


def skewed(spark):
    """Key 0 holds a third of the rows, NULL a fifth; the others few each."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 0).when(n % 5 == 1, None).otherwise(n % 997 + 1).alias("k")
    return spark.range(0, 60_000, 1, 6).select(key, F.lit("same").alias("w"), (n % 10).alias("x"))


def test_hot_keys_are_found_with_their_shares(spark):
    rows = skewed(spark)
    shares = {r["h"]: r["n"] / 60_000 for r in rows.groupBy(H.key_hash("k").alias("h")).agg(F.count("*").alias("n")).collect()}
    for share in (0.01, 0.1, 0.3):
        found = H.hot_keys(rows, "k", share)
        assert set(found) == {h for h, s in shares.items() if s >= share}
        assert all(found[h] == pytest.approx(shares[h], abs=share / 16) for h in found)
    with pytest.raises(ValueError):
        H.hot_keys(rows, "k", 1e-9)


@pytest.mark.parametrize("partitions", [8, 32, None])
def test_only_hot_keys_are_split(spark, partitions):
    rows = skewed(spark)
    spread = H.repartition_hot(rows, partitions, "k")
    assert spread.columns == rows.columns
    spread = spread.withColumn("p", F.spark_partition_id())
    places, sizes = defaultdict(set), Counter()
    for row in spread.groupBy("k", "p").count().collect():
        places[row["k"]].add(row["p"])
        sizes[row["p"]] += row["count"]
    assert sum(sizes.values()) == 60_000
    assert all(len(p) == 1 for k, p in places.items() if k not in (0, None))
    if partitions is not None:
        assert len(places[0]) > partitions / 4
        assert max(sizes.values()) < 2 * 60_000 / partitions
    assert spread.drop("p").exceptAll(rows).isEmpty()


def test_without_hot_keys_every_key_stays_together(spark):
    rows = spark.range(10_000).select((F.col("id") % 500).alias("k"))
    spread = H.repartition_hot(rows, 8, "k").withColumn("p", F.spark_partition_id())
    assert spread.groupBy("k").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()
    assert H.repartition_hot(rows.limit(0), 8, "k").count() == 0
