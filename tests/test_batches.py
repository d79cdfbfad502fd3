"""Golden results of the sample and the generated batch, and NULL and edge rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from batchloom.functions.expressions import accurate_sum, exact_average, exact_sum
from batchloom.plans.queries import QUERIES
from tests.conftest import TESTDATA
from batchloom import fixed_values as fixed
from batchloom import schemas
from batchloom.functions import expressions as X
from batchloom.operators.aggregate import by_revenue, count_rows, summarise
from batchloom.operators.enrich import current_batch, enrich, large_lines, tag_batch
from batchloom.operators.ordering import repartition_by, sort_rows
from batchloom.operators.selection import top_k
from batchloom.sources.generate import (
    events_from_ids,
    generate_batch,
    inline_rows,
    partitions_for,
    sales_batch,
)

GENERATED = [
    ("farm", 25000, 150000, 82515000.0),
    ("grocery", 25000, 150000, 82485000.0),
    ("electronics", 25000, 125000, 68765000.0),
    ("household", 25000, 125000, 68730000.0),
]


def tuples(df):
    return [tuple(row) for row in df.collect()]


def test_sales_summary(spark):
    sales = enrich(sales_batch(spark, "b1", schemas.SALES))
    summary = summarise(
        sales, ["category"], count_as="product_count", average=True, ordered=True
    )
    assert summary.columns == [
        "category", "product_count", "total_quantity", "revenue", "average_price",
    ]
    assert tuples(summary) == [
        ("electronics", 2, 3, 9997.0, 3749.0),
        ("household", 1, 4, 1800.0, 450.0),
        ("grocery", 2, 8, 1350.0, 185.0),
    ]


def test_large_sales(spark):
    large = large_lines(enrich(sales_batch(spark, "b1", schemas.SALES)))
    ordered = sort_rows(large, "line_total", descending=True)
    assert [row["product_id"] for row in ordered.collect()] == [102, 101, 301]


def test_generated_summary(spark):
    batch = generate_batch(spark, batch_id="b1")
    assert batch.rdd.getNumPartitions() == fixed.DEFAULT_PARTITIONS
    assert batch.schema.simpleString() == schemas.EVENTS.simpleString()
    summary = summarise(enrich(batch), ordered=True)
    assert tuples(summary.drop("batch_id")) == GENERATED
    exact = summarise(enrich(batch), exact=True, ordered=True)
    assert tuples(exact.drop("batch_id")) == GENERATED


def test_generated_bands(spark):
    bands = (
        enrich(generate_batch(spark))
        .groupBy("quantity_band")
        .agg(F.count("*"), F.round(F.sum("line_total"), 2), F.min("unit_price"), F.max("unit_price"))
    )
    assert {row[0]: tuple(row)[1:] for row in bands.collect()} == {
        "bulk": (50000, 220000000.0, 50.2, 1049.9),
        "standard": (50000, 82495000.0, 50.0, 1049.8),
    }


def test_generated_price_equals_the_exact_decimal(spark):
    ids = spark.range(0, 20000)
    exact = F.expr("cast(50 + pmod(id * 37, 10000) / 10.0 as double)")
    assert ids.filter(X.unit_price_of(F.col("id")) != exact).count() == 0


def test_ids_near_the_limits(spark):
    ids = inline_rows(spark, [(2**63 - 1,), (-7,), (None,)], "id long")
    rows = {row["event_id"]: row for row in events_from_ids(ids, F.col("id")).collect()}
    largest = 2**63 - 1
    assert rows[largest]["unit_price"] == 50 + (largest * 37 % 10000) / 10
    assert rows[largest]["category"] == "farm"
    assert rows[-7]["category"] == "grocery"
    assert rows[-7]["quantity"] == 4
    assert rows[None]["category"] == "farm"
    assert rows[None]["quantity"] is None


@pytest.mark.parametrize("rows", [1, 3])
def test_fewer_rows_than_categories(spark, rows):
    batch = generate_batch(spark, rows, 2, "b1")
    assert summarise(enrich(batch)).count() == rows


@pytest.mark.parametrize("arguments", [(0, 4), (4, 0), (-1, 1)])
def test_positive_parameters(spark, arguments):
    with pytest.raises(ValueError):
        generate_batch(spark, *arguments)


def test_partitions_for_grows_with_rows():
    assert partitions_for(10) == 4
    assert partitions_for(10**9) == 200


def edge_rows(spark):
    rows = [
        ("b1", 1, "a", None, 10.0),
        ("b1", 2, "a", 5, 1.0),
        ("b1", 3, "a", 6, 1.0),
        ("b1", 4, "nulls", None, None),
        ("b1", 5, None, 2, 0.5),
        ("it's", 6, "a", 7, 1.0),
    ]
    return inline_rows(spark, rows, schemas.EVENTS)


def test_edge_rows(spark):
    lines = {row["event_id"]: row for row in enrich(edge_rows(spark)).collect()}
    assert (lines[1]["quantity_band"], lines[1]["line_total"]) == ("standard", None)
    assert lines[2]["quantity_band"] == "standard"
    assert lines[3]["quantity_band"] == "bulk"
    assert lines[4]["line_total"] is None

    summary = summarise(current_batch(enrich(edge_rows(spark)), "b1"), average=True)
    found = {row["category"]: tuple(row)[2:] for row in summary.collect()}
    assert found == {
        "a": (3, 11, 11.0, 4.0),
        "nulls": (1, None, None, None),
        None: (1, 2, 1.0, 0.5),
    }
    ordered = by_revenue(summary, "category").collect()
    assert [row["category"] for row in ordered] == ["a", None, "nulls"]


def test_exact_summary_of_nulls(spark):
    summary = summarise(enrich(edge_rows(spark)), ["category"], average=True, exact=True)
    found = {row["category"]: (row["revenue"], row["average_price"]) for row in summary.collect()}
    assert found == {"a": (18.0, 3.25), "nulls": (None, None), None: (1.0, 0.5)}


def test_exact_average_rounds_ties_up(spark):
    rows = [("b1", 1, "a", 1, 4544.60), ("b1", 2, "a", 1, 0.01), ("b1", 3, "b", 1, -0.01),
            ("b1", 4, "b", 1, 0.0)]
    lines = enrich(inline_rows(spark, rows, schemas.EVENTS))
    summary = summarise(lines, ["category"], average=True, exact=True)
    assert {r["category"]: r["average_price"] for r in summary.collect()} == {
        "a": 2272.31, "b": -0.01,
    }


def sums_of(spark, values):
    rows = inline_rows(spark, [(v,) for v in values], "v double").repartition(3)
    found = rows.agg(X.accurate_sum(F.col("v")), X.accurate_average(F.col("v"))).first()
    return tuple(found)


def test_sums_keep_their_cents(spark):
    """A plain DOUBLE sum of as many prices is off by several cents."""
    rows = 8_000_000
    lines = enrich(generate_batch(spark, rows))
    revenue = {row["category"]: row["revenue"] for row in summarise(lines, ["category"]).collect()}
    tenths = {name: 0 for name in fixed.CATEGORIES}
    for id_ in range(10000):  # the prices repeat after this many rows
        tenths[fixed.CATEGORIES[id_ % 4]] += (1 + id_ % 10) * (500 + id_ * 37 % 10000)
    assert revenue == {name: total * (rows // 10000) / 10 for name, total in tenths.items()}


def test_accurate_sum_of_any_doubles(spark):
    rng = random.Random(7)
    values = [rng.uniform(-1e6, 1e6) for _ in range(2000)] + [1e-9, -3e14, 2e17, -2e17]
    total, average = sums_of(spark, values)
    assert total == pytest.approx(math.fsum(values), rel=1e-12)
    assert average == pytest.approx(math.fsum(values) / len(values), rel=1e-12)
    assert sums_of(spark, [0.125] * 3) == (0.375, 0.125)
    assert sums_of(spark, [None, 2.5]) == (2.5, 2.5)
    assert sums_of(spark, [None]) == (None, None)
    assert sums_of(spark, [math.inf, 1.0])[0] == math.inf
    assert math.isnan(sums_of(spark, [math.nan, 1.0])[0])
    assert math.isnan(sums_of(spark, [math.inf, -math.inf])[0])


def test_quote_in_batch_id(spark):
    assert current_batch(edge_rows(spark), "it's").count() == 1


def test_tag_replaces_the_batch_id(spark):
    tagged = tag_batch(edge_rows(spark), "new")
    assert tagged.columns == schemas.EVENTS.names
    assert [row[0] for row in tagged.select("batch_id").distinct().collect()] == ["new"]


def test_simple_case(spark):
    values = inline_rows(spark, [(0,), (1,), (2,), (None,)], "v int")
    labelled = values.select(X.case_of(F.col("v"), {0: "zero", 1: "one"}, "else"))
    assert [row[0] for row in labelled.collect()] == ["zero", "one", "else", "else"]
    assert values.select(X.case_of(F.col("v"), {}, "only")).first()[0] == "only"


def test_count_rows(spark):
    assert tuples(count_rows(edge_rows(spark))) == [(6,)]


def test_sort_null_order(spark):
    rows = inline_rows(spark, [(2, "b"), (None, "c"), (1, "a")], "v int, w string")
    assert [r["v"] for r in sort_rows(rows, "v").collect()] == [None, 1, 2]
    assert [r["v"] for r in sort_rows(rows, "v", descending=True).collect()] == [2, 1, None]


def test_sort_spreads_copies(spark):
    """Copies of one row are a third of all rows; they must not meet in one task."""
    rows = spark.range(0, 30000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v")
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ordered = sort_rows(rows, "v")
        sizes = ordered.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(row["count"] for row in sizes) == 30000
    assert max(row["count"] for row in sizes) < 10000


def test_top_k_breaks_ties(spark):
    rows = inline_rows(spark, [(1, 5.0), (2, 7.0), (3, 7.0), (4, None)], "id int, v double")
    assert tuples(top_k(rows, 2, "v")) == [(2, 7.0), (3, 7.0)]


@pytest.mark.parametrize("split", [1, 8])
def test_repartition_keeps_rows(spark, split):
    rows = generate_batch(spark, 1000, 8)
    spread = repartition_by(rows, 8, "category", split_hot=split)
    assert spread.rdd.getNumPartitions() == 8
    assert spread.columns == rows.columns
    assert spread.exceptAll(rows).count() == 0 and spread.count() == 1000


def test_repartition_splits_copies(spark):
    rows = spark.range(0, 8000, 1, 16).select(F.lit("hot").alias("category"))
    spread = repartition_by(rows, 8, "category", split_hot=16)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 4000


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_summary_does_not_depend_on_partitions(spark, partitions):
    batch = generate_batch(spark, 10007, partitions, "b1")
    summary = summarise(enrich(batch), exact=True)
    whole = summarise(enrich(generate_batch(spark, 10007, 4, "b1")), exact=True)
    assert sorted(tuples(summary)) == sorted(tuples(whole))
    assert summary.agg(F.sum("event_count")).first()[0] == 10007


def test_repartition_splits_hot_keys_of_one_input_partition(spark):
    rows = generate_batch(spark, 30_000, 1).filter("category <> 'books'")
    spread = repartition_by(rows, 16, "category", split_hot=128)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


ODD_AMOUNTS = [
    [10.0, float("inf")], [10.0, float("-inf")], [1.0, float("nan")], [10.0, 1e19], [9e18, 9e18],
    [1e13, 0.25], [1e15, 1e15], [-1e13, -0.01], [0.1] * 10, [None, 2.5], [None, None],
    [float("inf"), float("-inf")], [1e308, 1e308],
]


@pytest.mark.parametrize("amounts", ODD_AMOUNTS, ids=str)
def test_sums_leave_nothing_out(spark, amounts):
    df = inline_rows(spark, [(a,) for a in amounts], "v double")
    sums = [accurate_sum(F.col("v")), exact_sum(F.col("v"))]
    found = df.agg(*sums, exact_average(F.col("v"))).first()
    own = [a for a in amounts if a is not None]
    want = math.fsum(own) if all(map(math.isfinite, own)) and max(map(abs, own), default=0) < 1e300 else sum(own)
    if not own:
        assert tuple(found) == (None, None, None)
    for value in found[:2] if own else ():
        assert value == pytest.approx(want, rel=1e-15, nan_ok=True)
    if own:
        assert found[2] == pytest.approx(want / len(own), rel=1e-9, abs=0.005, nan_ok=True)


def test_large_sums_do_not_overflow(spark):
    df = spark.range(0, 100_000).select(F.lit(11_000_000_000_000.01).alias("v"))
    assert df.agg(exact_sum(F.col("v"))).first()[0] == 1_100_000_000_000_001_000.0


def test_sorts_cross_partition_boundaries_in_order(spark):
    for name, column, sign in (("sort_asc", "event_id", 1), ("sort_desc", "line_total", -1)):
        rows = QUERIES[name](spark, str(TESTDATA / "sf0.001"))
        bounds = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.min(column), F.max(column))
        ends = sorted(tuple(row) for row in bounds.collect())
        for (_, low, high), (_, next_low, next_high) in zip(ends, ends[1:]):
            assert high <= next_low if sign > 0 else low >= next_high
