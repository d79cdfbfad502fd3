"""Benchmark decontamination by templates: finds questions asked again with other values.

Words become a template: numbers, names (a capitalised word inside a sentence) and units
after a number turn into typed placeholders, the rest is lower-cased, punctuation is dropped.
Windows of the template, hashed, are joined between documents and benchmark items. Windows with
fewer than ``MIN_LITERAL`` plain words (sums, lists of names) prove nothing as templates; they
are hashed with the values that they hold, so they match word for word.

A run of matching windows keeps one offset between document and item. On each run the slots
must fit: every benchmark value stands for one document value and the other way round. A window
that holds a pair of values which another pair of its run contradicts is dropped, unless all its
values are the benchmark's own: what is copied word for word stays found, whatever was changed
beside it. An item is found in a document when ``MIN_WINDOWS`` of its windows are left, or all if
it has fewer.

Items shorter than ``WINDOW`` tokens are one window of their own length, looked for anywhere in
the documents; one of fewer than ``SHORTEST`` tokens proves nothing inside a text and matches
only a whole text.

Only DataFrame functions are used. The windows of the benchmark are broadcast while they are
few (``BROADCAST_WINDOWS``, counted first); beyond that the same join shuffles by window.

Edge cases: null and empty texts have no window, so an empty table finds nothing. Very long texts
are cut into words whole, but hashed and cut into windows ``PART`` words at a time. Rows that share a doc_id (or
have none) count as one document, and items that share an item_id as one item; repeated rows
change nothing. Ties cannot occur. ``clean`` tells rows of one doc_id apart by their text. Only
``doc_id, text`` and ``item_id, text`` are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import staged
from batchloom.operators.ordering import free_name

WINDOW = 8
#: Least tokens of an item that is looked for inside of documents.
SHORTEST = 4
MIN_LITERAL = 4
#: With windows of 8 this is a run of 13 words.
MIN_WINDOWS = 6
BROADCAST_WINDOWS = 500_000
#: Words of a text whose windows are made at a time. All matches of a part are held at once, each
#: with the part's words, so this is kept small.
PART = 128
UNITS = (
    "kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml",
    "s", "sec", "min", "h", "hr", "usd", "eur", "gbp", "kilograms", "grams", "pounds",
    "kilometers", "kilometres", "meters", "metres", "miles", "feet", "inches", "liters",
    "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars",
    "euros", "cents", "percent", "degrees",
)
#: Marks a name in the lower-cased text.
MARK = "\u0001"
NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;:][ \n\t]\p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
TOKEN = MARK + r"?[\p{L}\p{N}]++(?:[.,:/][0-9]++)*+"


def tokens(text: Column) -> Column:
    """Lower-cased words of the text, names with their mark."""
    marked = F.lower(F.regexp_replace(F.translate(text, MARK, " "), NAME, MARK + "$0"))
    return F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))


def template(found: Column) -> Column:
    """The tokens with placeholders for numbers, names and units."""

    def typed(token: Column, i: Column) -> Column:
        first = F.substring(token, 1, 1)
        number = first.between("0", "9")
        unit = token.isin(*UNITS) & (F.substring(F.get(found, i - 1), 1, 1).between("0", "9"))
        return (
            F.when(number, "#number").when(first == MARK, "#name")
            .when(F.coalesce(unit, F.lit(False)), "#unit").otherwise(token)
        )

    return F.transform(found, typed)


def windows(texts: DataFrame, key: str, sizes: Sequence[int]) -> DataFrame:
    """``key, n, size, place, window`` of each window of the given sizes, and the tokens ``t`` and
    template ``k`` of its part of the text, which starts at ``first``; ``n`` is how many tokens the text has.

    Both are null for a text without placeholders, most of them: then no slot is to be held
    against another. Every window that matches takes a copy of both along.
    """
    found = texts.select(key, tokens(F.col("text")).alias("t"))
    slots = F.exists("t", lambda x: F.substring(x, 1, 1).between("0", "9") | x.startswith(MARK))
    found = found.withColumns({"n": F.size("t"), "k": F.when(slots, template(F.col("t")))})
    # A window belongs to the part in which it begins, and may run on into the next one.
    part = lambda name, first: F.slice(name, first + 1, PART + WINDOW - 1).alias(name)
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(PART)),
        lambda first: F.struct(first.alias("first"), part("t", first), part("k", first)),
    )
    found = found.select(key, "n", F.explode_outer(parts).alias("part")).select(key, "n", "part.*")
    rows = found.select(
        key,
        "n",
        "first",
        F.when(F.col("k").isNotNull(), F.col("t")).alias("t"),
        "k",
        F.transform(F.coalesce("k", "t"), lambda x: F.xxhash64(x)).alias("h1"),
        # Only of texts with placeholders: tokens as they are, and which of them are plain.
        F.when(F.col("k").isNotNull(), F.transform("t", lambda x: F.xxhash64(x))).alias("e1"),
        F.transform("k", lambda x: (~x.startswith("#")).cast("int")).alias("p1"),
    )
    # Hashes and sums of 2, 4 and 8 tokens in a row; those that run over the end are nulls.
    hashed = lambda a, b: F.xxhash64(a, b)
    for step in (1, 2, 4):
        rows = rows.withColumns({
            f"{name}{2 * step}": F.zip_with(f"{name}{step}", F.slice(f"{name}{step}", step + 1, PART + WINDOW), join)
            for name, join in (("h", hashed), ("e", hashed), ("p", lambda a, b: a + b))
        })
    made = [_of_size(size) for size in sizes]
    whole = F.when(
        F.col("n").between(1, SHORTEST - 1),
        F.array(_row(F.lit(0), F.col("n"), F.xxhash64(F.coalesce("e1", "h1"), F.col("n")))),
    )
    rows = rows.select(key, "n", "first", "t", "k", F.concat(*made, F.coalesce(whole, _no_row())).alias("w"))
    # The outer form, since a plain one repeats the array's making in a filter before it; a
    # text without windows gives a null one, which matches nothing.
    rows = rows.select(key, "n", "first", "t", "k", F.explode_outer("w").alias("w"))
    return rows.select(key, "n", "first", "t", "k", "w.size", "w.place", "w.window")


def _row(place: Column, size: Column, window: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), size.cast("int").alias("size"), window.alias("window"))


def _no_row() -> Column:
    return F.expr("cast(array() as array<struct<place:int,size:int,window:bigint>>)")


def _of_size(size: int) -> Column:
    """The windows of one size: by template, or by their tokens where few of these are plain."""
    parts, start = [], 0
    for step in (8, 4, 2, 1):
        if size & step:
            parts.append((step, start))
            start += step

    def run(name: str) -> list[Column]:
        return [F.slice(f"{name}{step}", at + 1, PART + WINDOW) for step, at in parts]

    def joined(name: str) -> Column:
        first, *rest = run(name)
        for other in rest:
            first = F.zip_with(first, other, lambda a, b: a + b if name == "p" else F.xxhash64(a, b))
        return first

    count = F.least(F.greatest(F.col("n") - F.col("first") - size + 1, F.lit(0)), F.lit(PART))
    by_template = F.transform(
        F.slice(joined("h"), 1, count), lambda h, i: _row(F.col("first") + i, F.lit(size), F.xxhash64(h, F.lit(size)))
    )
    dense = F.zip_with(joined("e"), joined("p"), lambda e, p: F.when(p < MIN_LITERAL, F.xxhash64(e, F.lit(-size))))
    either = F.zip_with(
        by_template, F.slice(dense, 1, count),
        lambda row, e: _row(row["place"], row["size"], F.coalesce(e, row["window"])),
    )
    # Without placeholders all tokens are plain, and a window has ``SHORTEST`` or more.
    some = F.when(F.col("k").isNull(), by_template).otherwise(either)
    return F.when(F.col("n") < size, _no_row()).otherwise(some)


def slots() -> Column:
    """The values of the window's placeholders in order; null if its text has none."""
    place = F.col("place") - F.col("first") + 1
    values = F.zip_with(
        F.slice("t", place, F.col("size")), F.slice("k", place, F.col("size")),
        lambda t, k: F.when(k.startswith("#"), t),
    )
    return F.filter(values, lambda v: v.isNotNull())


def _items(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """The windows of the items, each of the largest size that fits, and the sizes that occur."""
    texts = benchmark.select("item_id", "text")
    length = F.least(F.size(tokens(F.col("text"))), F.lit(WINDOW))
    found = {r[0] for r in texts.select(length).distinct().collect()}
    sizes = [size for size in range(SHORTEST, WINDOW + 1) if size in found]
    rows = windows(texts, "item_id", sizes).where("window is not null and size = least(n, 8)")
    return rows.select("item_id", "place", "window", slots().alias("slots")).distinct(), sizes


def _found(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc, item_id, n_windows, item_windows, reparameterised`` of the rows ``doc, text``."""
    own, sizes = _items(benchmark)
    own = staged(own)
    item_sizes = own.groupBy("item_id").agg(F.countDistinct("place").alias("item_windows"))
    item = own.select("item_id", "window", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    if own.count() <= BROADCAST_WINDOWS:
        item = F.broadcast(item)
    hits = staged(
        windows(texts, "doc", sizes).join(item, "window")
        .select("doc", "item_id", "item_place", (F.col("place") - F.col("item_place")).alias("offset"), slots().alias("slots"), "item_slots")
        .withColumn("other", F.coalesce(F.col("slots") != F.col("item_slots"), F.lit(False)))
    )
    good = hits.where("not other").unionByName(_fitting(hits))
    found = good.groupBy("doc", "item_id").agg(
        F.countDistinct("item_place").alias("n_windows"), F.max("other").alias("reparameterised")
    )
    item_sizes = item_sizes.withColumnRenamed("item_id", "item")
    whole = found.join(item_sizes, F.col("item_id").eqNullSafe(F.col("item"))).drop("item")
    return whole.where(F.col("n_windows") >= F.least(F.lit(MIN_WINDOWS), "item_windows"))


def _fitting(hits: DataFrame) -> DataFrame:
    """The windows with other values than the benchmark's that nothing in their run contradicts."""
    run = ["doc", "item_id", "offset"]
    pair = F.arrays_zip(F.col("slots").alias("value"), F.col("item_slots").alias("item_value"))
    hits = hits.withColumn("pairs", pair)
    # Rows without an id are a run as well: nulls are grouped, but joined only null-safely.
    changed = hits.where("other").select(*run).distinct()
    pairs = staged(_on(run, hits, changed).select(*run, F.explode("pairs").alias("p")).distinct())
    doubtful = [
        pairs.groupBy(*run, f"p.{side}").agg(F.collect_set("p").alias("of")).where("size(of) > 1").select(*run, F.explode("of").alias("p"))
        for side in ("value", "item_value")
    ]
    wrong = doubtful[0].unionByName(doubtful[1]).groupBy(*run).agg(F.collect_set("p").alias("wrong"))
    held = _on(run, hits.where("other"), wrong, "left")
    fits = ~F.coalesce(F.arrays_overlap("pairs", "wrong"), F.lit(False))
    return held.where(fits).drop("pairs", "wrong")


def _on(keys: list[str], left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    renamed = right.withColumnsRenamed({key: f"right_{key}" for key in keys})
    same = reduce(and_, (F.col(key).eqNullSafe(F.col(f"right_{key}")) for key in keys))
    return left.join(renamed, same, how).drop(*(f"right_{key}" for key in keys))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it.

    ``n_windows`` of the item's ``item_windows`` windows were found and fit;
    ``reparameterised`` tells whether a slot holds another value than the benchmark's.
    """
    found = _found(docs.select(F.col("doc_id").alias("doc"), "text"), benchmark)
    return found.withColumnRenamed("doc", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no item was found."""
    row = F.struct("doc_id", F.xxhash64("text").alias("mark"))
    leaks = _found(docs.select(row.alias("doc"), "text"), benchmark).select("doc").distinct()
    leak, own = free_name(docs, "leak"), free_name(docs, "own")
    leaks = leaks.withColumnRenamed("doc", leak)
    kept = docs.withColumn(own, row).join(leaks, F.col(own).eqNullSafe(F.col(leak)), "left_anti")
    return kept.drop(own)
