"""How far the sources of a language diverge in their vocabulary, by run-length columns.

Per language the vocabulary keeps the terms in at least ``min_docs`` of its documents. A group
is a language and source; its profile gives term t, seen c times there, the smoothed share
``p = 1 + floor(UNIT * (c + 2) / (N + 2 V))``; two profiles differ at a term by
``floor((p - q)^2 / (p + q))``.

Most terms of a language are seen equally often as many others, above all the rare ones. So the
pairs of sources are summed over run-length columns:

1. Reorder. Terms with equal counts in every source are one entry with a length (grouped with
   partial aggregates, so however many terms share the commonest counts, none is hot). Sorted
   by language and counts in each task, entries with equal counts in a source come together.
2. Encode. Each task cuts its ordered entries into blocks; a block has a run-length column
   for each source: where its count changes, and the share it has from there.
3. Intersect. A pair's run boundaries in a block are united; between two boundaries both shares
   stay the same, so the difference is worked out once and multiplied by the number of terms.
   Block sums are added up.

Sums over blocks are whole numbers, so the split into blocks does not matter. A language with a
third of all rows is spread like any other, since its entries are dealt by their counts. The pairs themselves number sources squared per language, as asked; a block holds
``CELLS`` counts at most, so its rows get fewer where sources are many.

Edge cases: null text, language and source count as empty ones. Groups without a term take part
with c = 0; a language without a vocabulary has value 0 for all its pairs; one with a single
source has no pairs. Repeated rows count as documents of their own. Ties are ranked by the
item's UTF-8 bytes. An empty table gives no rows. Texts are read whole, whatever their length:
a task holds one batch of them and up to ``HELD`` counters. All arithmetic is exact: counts are
whole numbers, and Python's or DECIMAL ones wherever they could pass 64 bits. Only ``text``,
``lang`` and ``source`` are read, so other columns never clash.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import staged

#: A term: letters A-Z of either case and whatever is not ASCII. On UTF-8 bytes.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of its language that a term needs; ranks that the term part keeps.
MIN_DOCS, TOP = 10, 10
#: What the shares of a profile are counted in.
UNIT = 1_000_000_000
#: Counters a task holds before it passes them on; counts in a block.
HELD, CELLS = 300_000, 1 << 21
COUNTS = "lang string, source string, term string, n long, docs long"
COLUMN = "struct<source:string, starts:array<int>, counts:array<long>>"
BLOCKS = f"lang string, lengths array<long>, columns array<{COLUMN}>"
SUMS = "lang string, a string, b string, value long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, per language and source, as far as a task sees."""
    seen, docs = defaultdict(Counter), defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in seen.items():
            own = docs[lang, source]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(counts), pa.string()),
                "source": pa.array([source] * len(counts), pa.string()),
                "term": pa.array([term.decode() for term in counts], pa.string()),
                "n": pa.array(counts.values(), pa.int64()),
                "docs": pa.array([own[term] for term in counts], pa.int64()),
            })
        seen.clear()
        docs.clear()

    for batch in batches:
        for text, lang, source in zip(*(batch.column(c) for c in ("text", "lang", "source"))):
            # Lower-casing bytes touches A-Z only.
            terms = TERM.findall(text.as_buffer().to_pybytes().lower())
            key = lang.as_py(), source.as_py()
            seen[key].update(terms)
            docs[key].update(set(terms))
        if sum(map(len, seen.values())) > HELD:
            yield from flush()
    yield from flush()


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term, as a whole number; exact for any counts."""
    n, total, terms = (x.cast("decimal(20,0)") for x in (n, total, terms))
    return 1 + _whole((n + 2) * F.lit(UNIT).cast("decimal(10,0)"), total + 2 * terms)


def difference(p: Column, q: Column) -> Column:
    return _whole((p - q) * (p - q), p + q)


def _whole(a: Column, b: Column) -> Column:
    """The quotient's whole part, cut and not rounded."""
    return F.call_function("div", a, b)


def _shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``share`` of an array of counts, worked out once for each different one."""
    different, place = np.unique(counts, return_inverse=True)
    of = [1 + UNIT * (int(n) + 2) // (total + 2 * terms) for n in different]
    return np.array(of, np.int64)[place]


def run_length(column: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1])


def pair_sum(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], ends: np.ndarray
) -> int:
    """Summed differences of two run-length columns ``(starts, shares)``.

    ``ends[i]`` is the number of terms in the entries before the i-th.
    """
    starts = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], starts, "right") - 1]
    q = b[1][np.searchsorted(b[0], starts, "right") - 1]
    length = np.diff(np.append(ends[starts], ends[-1]))
    # Shares are at most UNIT + 1, so squares and sums over a block stay within 64 bits.
    return int(((p - q) ** 2 // (p + q) * length).sum())


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut ordered entries into blocks of run-length columns, one for each source seen there."""
    lang, lengths, cells = None, [], defaultdict(list)

    def block() -> pa.RecordBatch:
        columns = []
        for source, seen in cells.items():
            counts = np.zeros(len(lengths), np.int64)
            for row, n in seen:
                counts[row] = n
            starts = run_length(counts)
            columns.append({"source": source, "starts": starts, "counts": counts[starts]})
        row = {"lang": lang, "lengths": list(lengths), "columns": columns}
        lengths.clear()
        cells.clear()
        return pa.RecordBatch.from_pylist([row], _BLOCK)

    for batch in batches:
        for row in batch.to_pylist():
            if lengths and (row["lang"] != lang or len(lengths) * len(cells) >= CELLS):
                yield block()
            lang = row["lang"]
            for cell in row["vector"]:
                cells[cell["source"]].append((len(lengths), cell["n"]))
            lengths.append(row["terms"])
    if lengths:
        yield block()


_BLOCK = pa.schema([
    ("lang", pa.string()),
    ("lengths", pa.list_(pa.int64())),
    ("columns", pa.list_(pa.struct([
        ("source", pa.string()),
        ("starts", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int64())),
    ]))),
])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each pair of a language's sources, over the blocks that a task sees."""
    sums: Counter = Counter()
    never = np.zeros(1, np.int32), np.zeros(1, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ends = np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int64))])
            held = {
                c["source"]: (np.array(c["starts"], np.int32), np.array(c["counts"], np.int64))
                for c in row["columns"]
            }
            columns = {}
            for group in row["groups"]:
                starts, counts = held.get(group["source"], never)
                columns[group["source"]] = starts, _shares(counts, group["total"], row["size"])
            for a, b in combinations(columns, 2):
                sums[row["lang"], a, b] += pair_sum(columns[a], columns[b], ends)
    both_ways = [(lang, *p, v) for (lang, a, b), v in sums.items() for p in ((a, b), (b, a))]
    lang, a, b, value = zip(*both_ways, strict=True) if both_ways else ((),) * 4
    texts = [pa.array(x, pa.string()) for x in (lang, a, b)]
    yield pa.RecordBatch.from_arrays(
        [*texts, pa.array(value, pa.int64())], ["lang", "a", "b", "value"]
    )


def vocabulary(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, vector`` of the kept terms; the vector has the sources with their counts."""
    # Tasks send a term once per source, so a term of all documents has few rows; both
    # aggregates use this one exchange.
    counted = rows.mapInArrow(_count, COUNTS).repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    return (
        by_source.groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"),
        )
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )


def profiles(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``lang, source, total, size``: each group's occurrences and its language's terms."""
    size = entries.groupBy("lang").agg(F.sum("terms").alias("size"))
    cells = entries.select("lang", "terms", F.explode("vector").alias("c"))
    total = cells.select("lang", "c.source", (F.col("c.n") * F.col("terms")).alias("n"))
    total = total.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct()
    full = groups.join(total, ["lang", "source"], "left").join(size, "lang", "left")
    return full.na.fill(0, ["total", "size"])


def blocks(entries: DataFrame) -> DataFrame:
    """The reordered vocabulary as blocks of run-length columns.

    Each task orders what it reads, as the entries are dealt by their counts already. One order
    over all tasks would give longer runs, but its range bounds need samples of whole vectors in
    the driver.
    """
    return entries.sortWithinPartitions("lang", "vector").mapInArrow(_encode, BLOCKS)


def pair_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of each ordered pair of a language's sources."""
    per_lang = groups.groupBy("lang", "size").agg(
        F.collect_list(F.struct("source", "total")).alias("groups")
    )
    sums = blocks(entries).join(per_lang, "lang").mapInArrow(_pair_sums, SUMS)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    a = groups.select("lang", F.col("source").alias("a"))
    b = groups.select("lang", F.col("source").alias("b"))
    pairs = a.join(b, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce("value", F.lit(0).cast("long")).alias("value")
    return pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value)


def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of terms that a source uses more than its language."""
    own = groups.withColumn("all", F.sum("total").over(Window.partitionBy("lang")))
    in_lang = F.aggregate("vector", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    cells = terms.select("lang", "term", in_lang.alias("in_lang"), F.explode("vector").alias("c"))
    cells = cells.select("lang", "term", "in_lang", "c.source", "c.n")
    p = share(F.col("n"), F.col("total"), F.col("size"))
    q = share(F.col("in_lang"), F.col("all"), F.col("size"))
    both = cells.join(own, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    value = difference(F.col("p"), F.col("q")).alias("value")
    return both.select("lang", "source", F.col("term").alias("item"), value)


def audited(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence of sources and their marked terms.

    Part ``pair`` lists the other sources of the language, the farthest first; part ``term`` the
    ``top`` terms that the source uses more than its language.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    terms = staged(vocabulary(rows, min_docs))
    entries = staged(terms.groupBy("lang", "vector").agg(F.count("*").alias("terms")))
    groups = staged(profiles(rows, entries))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(values: DataFrame, part: str) -> DataFrame:
        placed = values.withColumn("rank", F.row_number().over(order))
        return placed.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    marked = ranked(term_values(terms, groups), "term").where(F.col("rank") <= top)
    return ranked(pair_values(entries, groups), "pair").unionByName(marked)
