"""Fill-in-the-middle texts, cut by a piecewise-linear learned rank index.

A text is cut into units, by default its lines. Where its units begin and end (the boundary
offsets 0 to the text's length, in code points) is a sorted column. The index learns it:

* Segments. From its first rank a segment is a line that stays within ``BOUND`` code points of
  each boundary offset it covers. A segment is made as long as that allows: the range of
  slopes that fit all offsets so far shrinks with each, and the segment ends where none is
  left. Slopes are whole numbers of 2^-20 code points a unit, so predictions are exact
  arithmetic, the same wherever they are worked out.
* Residuals. What each offset differs from its prediction, one byte each.

A cut at rank k takes the last segment that starts at k or before, predicts the offset and adds
the residual of k, so it is exact. The index is built in Arrow batches; predictions, cuts,
outputs and their reversal are column expressions.

Ranks come from the sha256 of ``seed:doc_id``, so a document is cut the same way in any run and
any order of rows. Each row is on its own: nothing is shuffled, and skew of a source or a group
of copies does not matter.

Edge cases: a null text counts as empty. An empty text, and one that holds a sentinel, stays as
it is (``plain``). A null id hashes as no digits. Repeated rows give repeated rows, an empty
table none. Very long texts are taken whole: a task holds one batch of texts and, besides, four
bytes for each code point of one text that is not ASCII and eight for each of its lines.
Only the id and text columns are read; ``transformed`` returns its own columns and no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Most that a segment may miss a boundary offset by, before slopes are rounded.
BOUND = 100
#: Slopes count in code points times 2 to this power. A segment covers at most so many ranks
#: that rounding its slope moves no prediction by more than one.
SCALE_BITS = 20
LONGEST = 1 << SCALE_BITS
INDEX = "units long, ranks array<long>, offsets array<long>, slopes array<long>, residuals binary"


def boundaries(text: str) -> np.ndarray:
    """The offsets, in code points, where lines of ``text`` begin, and its length."""
    if text.isascii():
        points = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return np.concatenate([[0], ends]).astype(np.int64)


def _segment(offsets: np.ndarray, start: int) -> tuple[int, float]:
    """The rank behind the longest segment from ``start``, and a slope that fits it."""
    low, high, end, step = 0.0, np.inf, start + 1, 64
    last = min(len(offsets), start + LONGEST)
    while end < last:
        rise = offsets[end : min(end + step, last)] - offsets[start]
        run = np.arange(end - start, end - start + len(rise))
        lows = np.maximum(np.maximum.accumulate((rise - BOUND) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + BOUND) / run), high)
        bad = np.flatnonzero(lows > highs)
        fits = int(bad[0]) if len(bad) else len(rise)
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
        end += fits
        if fits < len(rise):
            break
        step *= 2
    return end, (low + high) / 2 if end > start + 1 else 0.0


def learned(offsets: np.ndarray) -> tuple[list[int], list[int], list[int], bytes]:
    """First ranks, their offsets and slopes of the segments, and the residuals of all ranks."""
    ranks, slopes, start = [], [], 0
    while start < len(offsets):
        end, slope = _segment(offsets, start)
        ranks.append(start)
        slopes.append(int(slope * (1 << SCALE_BITS)))
        start = end
    firsts = np.array(ranks)
    own = np.repeat(np.arange(len(ranks)), np.diff([*ranks, len(offsets)]))
    beyond = np.arange(len(offsets)) - firsts[own]
    predicted = offsets[firsts][own] + ((np.array(slopes)[own] * beyond) >> SCALE_BITS)
    residuals = (offsets - predicted).astype(np.int8)
    return ranks, offsets[firsts].tolist(), slopes, residuals.tobytes()


def _indexes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        parts = [[] for _ in _FIELDS]
        for text in batch:
            offsets = boundaries(text.as_py())
            for part, value in zip(parts, (len(offsets) - 1, *learned(offsets)), strict=True):
                part.append(value)
        columns = [pa.array(p, f.type) for p, f in zip(parts, _FIELDS, strict=True)]
        yield pa.StructArray.from_arrays(columns, fields=_FIELDS)


_LONGS = pa.list_(pa.int64())
_FIELDS = [
    pa.field("units", pa.int64()), pa.field("ranks", _LONGS), pa.field("offsets", _LONGS),
    pa.field("slopes", _LONGS), pa.field("residuals", pa.binary()),
]


def rank_index(text: Column | str) -> Column:
    """The learned index over the boundary offsets of each text, a struct like ``INDEX``."""
    return F.arrow_udf(_indexes, INDEX)(text)


def offset_at(index: Column, rank: Column) -> Column:
    """The boundary offset of a rank: predicted by its segment, corrected by its residual."""
    segment = F.size(F.filter(index["ranks"], lambda first: first <= rank)) - 1
    beyond = rank - F.get(index["ranks"], segment)
    predicted = F.get(index["offsets"], segment) + F.shiftright(
        F.get(index["slopes"], segment) * beyond, SCALE_BITS
    )
    stored = F.conv(F.hex(F.substring(index["residuals"], rank.cast("int") + 1, F.lit(1))), 16, 10)
    residual = stored.cast("long")
    return predicted + F.when(residual > 127, residual - 256).otherwise(residual)


def _draws(seed: int, key: Column) -> list[Column]:
    """The first four 8-digit groups of the key's sha256 as numbers."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transformed`` was made of.

    No sentinel occurs but the three put in, and none overlaps another, so the first of a kind
    is the one put in. Byte searches serve, without a regular expression over whole texts.
    """
    last = F.substring_index(output, SENTINELS[2], -1)
    front = F.substring_index(output, SENTINELS[2], 1)

    def parts(mark: str) -> tuple[Column, Column]:
        opened = F.substring_index(front, mark, 1)
        return F.substring(opened, F.lit(1 + len(mark)), F.length(opened)), F.substring_index(front, mark, -1)

    prefix, suffix = parts(SENTINELS[1])
    first, second = parts(SENTINELS[0])
    return (
        F.when(form == PSM, F.concat(prefix, last, suffix))
        .when(form == SPM, F.concat(second, last, first))
        .otherwise(output)
    )


def transformed(
    docs: DataFrame, *, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, segments, output`` of each document.

    ``n`` is the number of units, ``segments`` that of the learned segments of its index.
    ``fim_percent`` of the texts are rearranged, ``spm_percent`` of those with the suffix first.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    indexed = texts.withColumn("index", rank_index("text"))
    index = F.col("index")
    h1, h2, h3, h4 = _draws(seed, F.col("doc_id"))
    marked = reduce(or_, (F.col("text").contains(mark) for mark in SENTINELS))
    drawn = indexed.withColumns({
        "a": h1 % (index["units"] + 1),
        "b": h2 % (index["units"] + 1),
        "form": F.when(
            (F.col("text") == "") | marked | (h3 % 100 >= fim_percent),
            PLAIN,
        ).otherwise(F.when(h4 % 100 < spm_percent, SPM).otherwise(PSM)),
    })
    cut = drawn.withColumns({
        "from": offset_at(index, F.least("a", "b")),
        "to": offset_at(index, F.greatest("a", "b")),
    })
    start, end, text = F.col("from").cast("int"), F.col("to").cast("int"), F.col("text")
    prefix = F.substring(text, F.lit(1), start)
    middle = F.substring(text, start + 1, end - start)
    suffix = F.substring(text, end + 1, F.length(text))
    p, s, m = map(F.lit, SENTINELS)
    moved = F.col("form") != PLAIN
    return cut.select(
        "doc_id",
        index["units"].alias("n"),
        "form",
        F.when(moved, F.col("from")).alias("prefix_chars"),
        F.when(moved, F.col("to") - F.col("from")).alias("middle_chars"),
        F.size(index["ranks"]).alias("segments"),
        F.when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == SPM, F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(text)
        .alias("output"),
    )


def digest(rows: DataFrame) -> DataFrame:
    """The rows of ``transformed`` with hashes in place of the output and its reversal."""
    back = restored(F.col("output"), F.col("form"))
    return rows.withColumns({
        "output_sha256": F.sha2(F.col("output").cast("binary"), 256),
        "restored_sha256": F.sha2(back.cast("binary"), 256),
    }).drop("output", "segments")
