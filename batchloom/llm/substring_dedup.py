"""Removal of repeated passages, found with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one document. A word goes if some window over it
also starts in a document with a smaller id. Whole windows of all documents are judged on the
input, so which words go does not depend on any order of work.

1. Routing. Each window is routed by its minimizer: the least hash among its ``GRAM``-word
   grams. Equal windows have equal minimizers, so they meet in one shard. Neighbouring windows
   mostly share one; such a run makes a passage of ``WINDOW`` words and more. Per passage a
   document sends hashes and a position. Equal passages are combined by partial aggregates,
   whose least document stands for them, and minimizers of one document alone go.
2. Index. Each task takes whole minimizers until it has ``SHARD_WORDS`` words, and indexes the
   passages left: a wavelet matrix over the Burrows-Wheeler transform of their words, bits
   packed, with counts every 64 bits. Suffixes are sorted by their first ``WINDOW`` words, which
   is all that a search for a window reads. Rows of equal windows form an interval; the least
   document of each interval is stored.
3. Search. All passages of the shard are streamed through the index side by side, from their
   last word to the first. Each step prepends a word to the match by rank queries in the wavelet
   matrix; a match longer than a window is cut back to the interval of its first ``WINDOW``
   words. These matching statistics give the least document of each window. A passage is
   searched once for all documents that hold it; it is in the index itself, so a match never
   breaks off.
4. Report. Windows whose least document is smaller than the document that holds them are
   intervals of words to remove; they go back to the texts.

A minimizer that has over ``CROWDED`` different passages (a passage that very many documents
share, each in surroundings of its own) would fill a shard. Its passages are cut into single
windows, each of which is a group of its own with one text, and a group's least document is a
partial aggregate; there is nothing left to search. So no task holds more than
``SHARD_WORDS + CROWDED * (2 * WINDOW)`` words, whatever the share of one passage.

Edge cases: a null text has no words; fewer than ``WINDOW`` words make no window. Rows with a
null id are smaller than none and keep all words, nor do others lose theirs to them. Rows
sharing an id are one document, so they lose nothing to each other, but to smaller ids.
Repetition within one document is kept. Ties cannot occur, as only the least id counts. An empty
table gives no rows. Texts are read whole; a task holds a batch of them and, of one text at a
time, about 100 bytes a word. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import staged

WINDOW, GRAM = 50, 10
SHARD_WORDS = 300_000
CROWDED = 2_000
#: Words of which a task remembers the hash.
REMEMBERED = 500_000
RUNS = "key long, passage long, doc_id long, row long, start int, size int"
CUTS = "key long, passage long, least long, words string, windows array<long>"
ANSWERS = "key long, passage long, ends array<int>, leasts array<long>"
KEPT = "doc_id long, n_words long, n_removed long, kept string"
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# Hashes of word sequences


class _Words(dict):
    """The hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash, so that its order is as good as random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretch of a text's words, by prefix sums modulo 2^64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(_BASE, n), out=self._sums[1:])
        self._back = _powers(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        poly = (self._sums[starts + sizes] - self._sums[starts]) * self._back[starts]
        return _mixed(poly + np.asarray(sizes).astype(np.uint64)).view(np.int64)


def passages(words: list[bytes], seen: dict, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """``key, passage, start, size`` of the runs of windows that share a minimizer."""
    n = len(words)
    hashes = Hashes(np.fromiter(map(seen.__getitem__, words), np.uint64, n))
    grams = hashes.of(np.arange(n - gram + 1), gram)
    width = window - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    place = least + np.arange(len(least))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    sizes = np.diff(np.append(starts, len(place))) + window - 1
    return grams[place[starts]], hashes.of(starts, sizes), starts, sizes


def _runs(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for batch in batches:
            found, count = [], []
            for text in batch.column("text"):
                words = text.as_buffer().to_pybytes().split()
                if len(words) < window:
                    count.append(0)
                    continue
                found.append(passages(words, seen, window, gram))
                count.append(len(found[-1][0]))
            parts = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, int)] * 4
            rows = np.repeat(np.arange(len(count)), count)
            doc, row = (batch.column(c).take(pa.array(rows)) for c in ("doc_id", "row"))
            key, passage, start, size = parts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key, pa.int64()), pa.array(passage, pa.int64()), doc, row,
                    pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
                ],
                ["key", "passage", "doc_id", "row", "start", "size"],
            )

    return run


def _cut(window: int, crowded: int) -> Callable:
    """The words of the passages a text stands for; of crowded ones the hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        schema = pa.schema([
            ("key", pa.int64()), ("passage", pa.int64()), ("least", pa.int64()),
            ("words", pa.string()), ("windows", pa.list_(pa.int64())),
        ])
        for batch in batches:
            for doc, text, wanted in zip(*(batch.column(c) for c in ("doc_id", "text", "wanted"))):
                words = text.as_buffer().to_pybytes().split()
                hashes, rows = None, []
                for want in wanted.as_py():
                    start, size = want["start"], want["size"]
                    row = {"key": want["key"], "passage": want["passage"], "least": doc.as_py()}
                    if want["passages"] > crowded:
                        hashes = hashes or Hashes(
                            np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
                        )
                        row["windows"] = hashes.of(np.arange(start, start + size - window + 1), window)
                    else:
                        row["words"] = b" ".join(words[start : start + size]).decode()
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


# The index of a shard


class WaveletMatrix:
    """Rank queries on a sequence of whole numbers: one packed bit vector for each bit."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self._levels = []
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = (sequence >> bit) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            words = np.zeros(len(packed) // 8 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self._levels.append((bit, words, before, len(bits) - int(bits.sum())))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        every = np.arange(symbols)
        self._starts = self._descend(every, np.zeros(symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, words, before, zeros in self._levels:
            block, below = at >> 6, (at & 63).astype(np.uint64)
            mask = (np.uint64(1) << below) - np.uint64(1)
            ones = before[block] + np.bitwise_count(words[block] & mask)
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._descend(symbols, at) - self._starts[symbols]


class FmIndex:
    """Backward search for windows of ``depth`` symbols in texts of whole numbers above zero."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, depth: int):
        symbols = 1 + max(int(t.max()) for t in texts)
        joined = np.concatenate([x for t in texts for x in (t, [0])])
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        n, self.depth = len(joined), depth
        window = _window_ranks(joined, depth)
        rows = np.argsort(window, kind="stable")
        ordered = window[rows]
        self._bwt = WaveletMatrix(joined[rows - 1], symbols)
        self._before = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=symbols))])
        heads = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
        #: The interval of equal windows that each row lies in, and where intervals begin.
        self._interval = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))
        self._heads = heads
        self.least = np.minimum.reduceat(owners[owner[rows]], heads)
        self._rows = n

    def search(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The interval of each window of each text; all texts must be in the index.

        Step by step one more word is put in front of all matches at once.
        """
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        ends, flat = np.cumsum(sizes), np.concatenate(texts)
        found = np.full(len(flat), -1)
        low = np.zeros(len(texts), np.int64)
        high = np.full(len(texts), self._rows)
        for matched in range(1, int(sizes.max()) + 1):
            order = order[: np.searchsorted(-sizes[order], -matched, "right")]
            at = ends[order] - matched
            symbol = flat[at]
            first = self._before[symbol]
            low[order] = first + self._bwt.rank(symbol, low[order])
            if matched <= self.depth:
                high[order] = first + self._bwt.rank(symbol, high[order])
                if (low[order] >= high[order]).any():
                    raise ValueError("a text is not in the index")
            if matched >= self.depth:
                # The match is cut back to its first words, whose interval starts here.
                interval = self._interval[low[order]]
                low[order] = self._heads[interval]
                found[at] = interval
        windows = sizes - self.depth + 1
        return [found[e - s : e - s + w] for e, s, w in zip(ends, sizes, windows, strict=True)]


def _window_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix by its first ``depth`` symbols, by prefix doubling."""
    ranks, covered = text.astype(np.int64), 1
    while covered < depth:
        step = min(covered, depth - covered)
        later = np.zeros_like(ranks)
        later[:-step] = ranks[step:] + 1
        pairs = ranks * (int(later.max()) + 1) + later
        order = np.argsort(pairs, kind="stable")
        ranks = np.empty_like(ranks)
        ranks[order] = np.concatenate([[0], np.cumsum(np.diff(pairs[order]) != 0)])
        covered += step
    return ranks


def _search(window: int, shard_words: int) -> Callable:
    """Least documents of the windows of passages, which come ordered by their key."""

    def answers(keys: list, names: list, owners: list, texts: list) -> pa.RecordBatch:
        vocabulary: defaultdict = defaultdict()
        vocabulary.default_factory = lambda: len(vocabulary) + 1
        coded = [np.fromiter(map(vocabulary.__getitem__, t), np.int64, len(t)) for t in texts]
        index = FmIndex(coded, np.array(owners), window)
        ends, leasts = [], []
        for intervals in index.search(coded):
            least = index.least[intervals]
            change = np.append(np.flatnonzero(np.diff(least)) + 1, len(least))
            ends.append(change)
            leasts.append(least[change - 1])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()), pa.array(names, pa.int64()),
                pa.array(ends, pa.list_(pa.int32())), pa.array(leasts, pa.list_(pa.int64())),
            ],
            ["key", "passage", "ends", "leasts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], [], []), 0
        for batch in batches:
            columns = (batch.column(c) for c in ("key", "passage", "least", "words"))
            for key, name, owner, text in zip(*columns, strict=True):
                key = key.as_py()
                if size >= shard_words and key != held[0][-1]:
                    yield answers(*held)
                    held, size = ([], [], [], []), 0
                words = text.as_buffer().to_pybytes().split()
                size += len(words)
                for into, x in zip(held, (key, name.as_py(), owner.as_py(), words), strict=True):
                    into.append(x)
        if size:
            yield answers(*held)

    return run


# The job


def shared_passages(runs: DataFrame) -> DataFrame:
    """``key, passage, least, row, start, size, passages`` where a key is in several documents.

    One row for each different passage, with a place in its least document; ``passages`` counts
    those of the key.
    """
    different = runs.groupBy("key", "passage").agg(
        F.min("doc_id").alias("least"),
        F.max("doc_id").alias("most"),
        # Both follow the same comparison, so they come from one row.
        F.min_by("row", "doc_id").alias("row"),
        F.min_by("start", "doc_id").alias("start"),
        F.min("size").alias("size"),
    )
    keys = different.groupBy("key").agg(
        F.min("least").alias("low"), F.max("most").alias("high"), F.count("*").alias("passages")
    )
    keys = keys.where("low < high").select("key", "passages")
    return different.drop("most").join(keys, "key")


def least_documents(
    shared: DataFrame, texts: DataFrame, *, window: int, shard_words: int, crowded: int
) -> DataFrame:
    """``key, passage, ends, leasts``: the windows up to each end have that least document."""
    place = F.struct("key", "passage", "start", "size", "passages")
    wanted = shared.groupBy(F.col("least").alias("doc_id"), "row").agg(
        F.collect_list(place).alias("wanted")
    )
    cuts = staged(
        texts.join(wanted, ["doc_id", "row"])
        .dropDuplicates(["doc_id", "row"])
        .select("doc_id", "text", "wanted")
        .mapInArrow(_cut(window, crowded), CUTS)
    )
    plain = cuts.where("words is not null").drop("windows")
    ordered = plain.repartition("key").sortWithinPartitions("key")
    searched = ordered.mapInArrow(_search(window, shard_words), ANSWERS)

    single = cuts.where("windows is not null").select(
        "key", "passage", "least", F.posexplode("windows").alias("at", "window")
    )
    first = single.groupBy("key", "window").agg(
        F.min("least").alias("first"), F.max("least").alias("last")
    )
    first = first.where("first < last").drop("last")
    earlier = single.join(first, ["key", "window"], "left")
    earlier = earlier.groupBy("key", "passage").agg(
        F.array_sort(
            F.collect_list(F.struct("at", F.coalesce("first", "least").alias("least")))
        ).alias("found")
    )
    alone = earlier.select(
        "key",
        "passage",
        F.transform("found", lambda x: x["at"] + 1).alias("ends"),
        F.transform("found", lambda x: x["least"]).alias("leasts"),
    )
    return searched.unionByName(alone)


def _keep(window: int) -> Callable:
    """Drop the words under the reported windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
                words = text.as_buffer().to_pybytes().split()
                total.append(len(words))
                if gone.is_valid:
                    first, behind = (x.to_numpy() for x in gone.values.flatten())
                    edges = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edges, first, 1)
                    np.add.at(edges, behind + (window - 1), -1)
                    open_windows = np.cumsum(edges[:-1])
                    words = [words[i] for i in np.flatnonzero(open_windows == 0)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def without_repeats(
    docs: DataFrame,
    *,
    window: int = WINDOW,
    gram: int = GRAM,
    shard_words: int = SHARD_WORDS,
    crowded: int = CROWDED,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of each row; ``kept`` joins the words by blanks."""
    text = F.coalesce("text", F.lit("")).alias("text")
    texts = docs.select(F.col("doc_id").cast("long"), text).withColumn("row", F.xxhash64("text"))
    named = texts.where("doc_id is not null")
    runs = staged(named.mapInArrow(_runs(window, gram), RUNS))
    shared = staged(shared_passages(runs))
    answers = staged(
        least_documents(shared, named, window=window, shard_words=shard_words, crowded=crowded)
    )
    # Of each occurrence the stretches of windows, from and to, that a smaller document has.
    stretches = F.transform(
        F.sequence(F.lit(1), F.size("ends")),
        lambda i: F.struct(
            (F.col("start") + F.when(i > 1, F.get("ends", i - 2)).otherwise(0)).alias("from"),
            (F.col("start") + F.get("ends", i - 1)).alias("to"),
            (F.get("leasts", i - 1) < F.col("doc_id")).alias("gone"),
        ),
    )
    gone = F.transform(
        F.filter(stretches, lambda s: s["gone"]), lambda s: F.struct(s["from"], s["to"])
    )
    found = (
        runs.join(answers, ["key", "passage"])
        .where(F.exists("leasts", lambda least: least < F.col("doc_id")))
        .select("doc_id", "row", gone.alias("gone"))
        .groupBy("doc_id", "row")
        .agg(F.flatten(F.collect_list("gone")).alias("gone"))
    )
    marked = texts.join(found, ["doc_id", "row"], "left").select("doc_id", "text", "gone")
    return marked.mapInArrow(_keep(window), KEPT)


def digest(rows: DataFrame) -> DataFrame:
    """The rows of ``without_repeats`` with a hash in place of the words kept."""
    return rows.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")
