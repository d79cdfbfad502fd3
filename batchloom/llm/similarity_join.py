"""Jaccard self-join on word shingles with prefix filters under several global orders.

Two sets with a Jaccard similarity of t or more share a token among the first
``n - ceil(t * n) + 1`` tokens of each, whatever global order the tokens are put in. So a
candidate must pass this filter under every one of several orders, and only then are the two
sets intersected.

* The first order is by frequency, rarest first, with the hash of the shingle as tie-break.
  It makes the join. Any order is right; frequencies of hash buckets over all documents
  (a table of fixed size) are near enough to put widely shared passages last.
* The other orders are hashes with different seeds. They are tried on each candidate.

Steps: documents with equal sets are one node. Each task packs the prefix tokens of its
nodes by hash range, so that tokens only one node has (nearly all) leave the exchange as
plain arrays and never become rows. Nodes sharing a token are first compared with one hub
of that token; the links found give components. Then only pairs whose nodes lie in different
components are still open, and only those are joined on the token, with the sizes and the
parity bitmap of the sets (whose distance never exceeds that of the sets) in the join
condition. So a group of near copies gives a star, not all its pairs, and no link that could
join two components is left out.

Edge cases: a null text or one without words has the empty set, is linked with nothing and is
its own component; a text of one to four words has one shingle, its whole sequence. Repeated
rows are equal sets. A null doc_id takes part, but never names a component: the least id that
is not null does. Word order, case beyond A-Z and punctuation count. Only ``doc_id`` and
``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import staged, tidy
from batchloom.llm.components import components

SHINGLE = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Hash buckets of the frequency table, as powers of two: a quarter of the shingles, within
#: these bounds. A bucket takes one byte where the table is sent to tasks.
LEAST_BITS, MOST_BITS = 16, 24
#: Code points that a word of the text takes, by which shingles are counted beforehand.
WORD_BYTES = 6
#: Pieces in which tasks hand in their frequency tables.
PIECES = 64
#: A token of a bucket beyond this count, and so many times the mean, is spread by Spark's
#: joins, not packed.
COMMON, TIMES_MEAN = 4_096, 64
#: Bits for each document of the filter that tells whose sets are wanted, and most bits in all.
BLOOM_EACH, BLOOM_MOST = 16, 1 << 29
BITMAP_WORDS = 16
#: Orders of the nodes by which hubs are chosen; a node of a group meets so many of its others.
HUBS = 16
#: Prefix tokens that a task packs at a time.
HELD = 1_000_000
#: Tokens of a node by which pairs are told to have met before.
FIRST = 8
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        mixed = np.full(n, size, np.uint64)
        for i in range(size):
            mixed = (mixed ^ hashes[i : i + n]) * MIX
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def node_of(tokens: np.ndarray, seed: int) -> int:
    """A signed 64-bit id of the set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def short_length(n: int) -> int:
    """Of the prefix, the tokens that a set as large or larger must share one of."""
    return n + 2 * PERCENT * -n // (100 + PERCENT) + 1


def bucket_bits(shingles: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, shingles.bit_length() - 2))


def buckets(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, in steps of an eighth of a doubling, so they never run full."""
    return np.round(8 * np.log2(1 + counts)).astype(np.uint8)


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bitmap in which each token flips one bit."""
    bits = np.bincount((tokens & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS)
    return np.packbits((bits & 1).astype(np.uint8)).view("<i8")


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    for x in batch.column("text"):
        yield x.as_py()


def _survey(seed: int, bits: int) -> Callable:
    """Rows of every document, then the task's frequency table in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        met: set[int] = set()
        for batch in batches:
            sizes, nodes, checks, maps = [], [], [], []
            for text in _texts(batch):
                tokens = shingle_set(text)
                node = node_of(tokens, seed)
                if node not in met:
                    met.add(node)
                    at = buckets(tokens, bits)
                    # A task's count stays where it is before it could run over.
                    np.add.at(counts, at[counts[at] < 60_000], 1)
                sizes.append(len(tokens))
                nodes.append(node if len(tokens) else None)
                checks.append(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed + 1) - (1 << 63))
                maps.append(parity(tokens))
            none = [None] * len(sizes)
            yield _survey_rows(batch.column("doc_id"), sizes, nodes, checks, maps, none, none)
        if met:
            pieces = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PIECES)]
            none = [None] * PIECES
            yield _survey_rows(pa.nulls(PIECES, pa.int64()), none, none, none, none, range(PIECES), pieces)

    return run


SURVEY = "doc_id long, n long, node long, mark long, bitmap array<long>, piece int, counts binary"


def _survey_rows(ids, *columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
    arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds)]
    names = ["doc_id", "n", "node", "mark", "bitmap", "piece", "counts"]
    return pa.RecordBatch.from_arrays([ids, *arrays], names=names)


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts")):
            more = np.frombuffer(zlib.decompress(counts.as_py()), np.uint16).astype(np.int64)
            total[piece] = total[piece] + more if piece in total else more
    for piece, counts in total.items():
        yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "counts": pa.array([level(counts).tobytes()], pa.binary())})


def frequencies(survey: DataFrame, bits: int) -> np.ndarray:
    """The levels of the bucket counts of all documents: a table of bounded size."""
    summed = (
        survey.where("piece is not null").select("piece", "counts")
        .repartition(PIECES, "piece")
        .mapInArrow(tidy(_sum_pieces), "piece int, counts binary")
        .collect()
    )
    table = np.zeros((PIECES, (1 << bits) // PIECES), np.uint8)
    for row in summed:
        table[row.piece] = np.frombuffer(row.counts, np.uint8)
    return table.ravel()


def _pack(table: np.ndarray, common_from: int, seed: int, ranges: int) -> Callable:
    """For each hash range, the prefix tokens of the task's nodes beside their nodes."""
    bits = len(table).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        found, owner, held = [], [], 0

        def packed() -> pa.RecordBatch:
            tokens = np.concatenate(found)
            nodes = np.concatenate(owner)
            common = table[buckets(tokens, bits)] > common_from
            out = [(-1, *np.stack([tokens[common].view(np.int64), nodes[common]]))] if common.any() else []
            tokens, nodes = tokens[~common], nodes[~common]
            order = np.argsort(tokens)
            tokens, nodes = tokens[order], nodes[order]
            # The high bits choose the range, so that a range is a run of the sorted tokens.
            part = (tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            ends = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            out += [(i, tokens[a:b].view(np.int64), nodes[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k].astype("<i8").tobytes() for x in out], pa.binary()) for k in (1, 2))],
                names=["part", "tokens", "nodes"],
            )

        for batch in batches:
            for text in _texts(batch):
                tokens = shingle_set(text)
                if not len(tokens) or (node := node_of(tokens, seed)) in met:
                    continue
                met.add(node)
                first = np.argsort(table[buckets(tokens, bits)], kind="stable")[: prefix_length(len(tokens))]
                # The last bit tells whether the token is in the short prefix.
                short = np.arange(len(first)) < short_length(len(tokens))
                found.append(tokens[first] & ~np.uint64(1) | short.astype(np.uint64))
                owner.append(np.full(len(first), node, np.int64))
                held += len(first)
                if held >= HELD:
                    yield packed()
                    found, owner, held = [], [], 0
        if found:
            yield packed()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node that shares a token, but for the token's hub, beside that hub.

    A range has all rows of its tokens, so hubs are chosen here. Common tokens (part -1) are
    spread over tasks; their rows have no hub yet.
    """
    parts: dict[int, list] = {}
    for batch in batches:
        for part, tokens, nodes in zip(*(batch.column(c).to_pylist() for c in ("part", "tokens", "nodes"))):
            pair = np.stack([np.frombuffer(tokens, "<i8"), np.frombuffer(nodes, "<i8")])
            if part < 0:
                yield _token_rows(*pair)
            else:
                parts.setdefault(part, []).append(pair)
    while parts:
        tokens, nodes = np.concatenate(parts.popitem()[1], axis=1)
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
        tokens, nodes = tokens[new], nodes[new]
        starts = np.flatnonzero(np.append(True, tokens[1:] | 1 != tokens[:-1] | 1))
        sizes = np.diff(np.append(starts, len(tokens)))
        wanted = (sizes > 1) & (np.bitwise_or.reduceat(tokens & 1, starts) == 1)
        hubs = _hubs(tokens, nodes, starts, sizes)
        keep = np.repeat(wanted, sizes) & (nodes != hubs)
        yield _token_rows(tokens[keep], nodes[keep], hubs[keep], np.repeat(sizes > 2, sizes)[keep])


def _hubs(tokens: np.ndarray, nodes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each row the hub of its token: the first node in one of a few orders of the nodes,
    which the token chooses."""
    with np.errstate(over="ignore"):
        chosen = (tokens.view(np.uint64) >> np.uint64(7)) % np.uint64(HUBS) + np.uint64(1)
        rank = (nodes.view(np.uint64) ^ chosen * MIX) * MIX
        rank ^= rank >> np.uint64(29)
    first = np.lexsort((rank, np.repeat(np.arange(len(starts)), sizes)))[starts]
    return np.repeat(nodes[first], sizes)


def _token_rows(tokens, nodes, hubs=None, more=None) -> pa.RecordBatch:
    """The last bit of the tokens is taken off as the flag it is."""
    columns = [pa.array(tokens | 1, pa.int64()), pa.array(nodes, pa.int64()), pa.array(tokens & 1 == 1)]
    columns += [pa.nulls(len(tokens), pa.int64()) if hubs is None else pa.array(hubs, pa.int64())]
    columns += [pa.nulls(len(tokens), pa.bool_()) if more is None else pa.array(more)]
    return pa.RecordBatch.from_arrays(columns, names=["token", "node", "short", "hub", "more"])


def with_hubs(found: DataFrame) -> DataFrame:
    """The rows of ``_shared``, those of common tokens with their hubs as well."""
    common = found.where("hub is null").select("token", "node", "short").distinct()
    rank = F.xxhash64(F.col("node"), F.pmod(F.shiftright("token", 7), F.lit(HUBS)))
    hubs = common.groupBy("token").agg(
        F.min_by("node", rank).alias("hub"), F.min("node").alias("first"), F.max("node").alias("last"),
        (F.count("*") > 2).alias("more"), F.max("short").alias("any_short"),
    )
    hubs = hubs.where("first < last and any_short").drop("first", "last", "any_short")
    # A hub's own row is not needed: every pair with it is a pair of the star.
    spread = common.join(hubs, "token").where("node <> hub")
    return found.where("hub is not null").unionByName(spread)


def _sets(bloom: np.ndarray, seed: int) -> Callable:
    """The sets of the documents whose ids the filter knows, once for each node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            place = batch.column("place").to_numpy()
            known = pa.array((bloom[place >> 3] >> (place & 7)) & 1 == 1)
            sets = {}
            for text in batch.column("text").filter(known):
                tokens = shingle_set(text.as_py())
                sets[node_of(tokens, seed)] = tokens
            sets = {node: tokens for node, tokens in sets.items() if node not in met}
            met.update(sets)
            columns = {
                "node": pa.array(sets, pa.int64()),
                "tokens": pa.array([x.tobytes() for x in sets.values()], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of the hashed ids; of bounded size, so that it may go to every task."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column("place").to_numpy()
            for piece in np.unique(place >> 20):
                own = marks.setdefault(int(piece), np.zeros(1 << 17, np.uint8))
                at = place[place >> 20 == piece] & ((1 << 20) - 1)
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for piece, own in marks.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "bits": pa.array([own.tobytes()], pa.binary())})

    places = ids.select(_place(bits)).distinct()
    pieces = places.repartition(bits >> 20, F.shiftright("place", 20)).mapInArrow(mark, "piece int, bits binary")
    table = np.zeros((bits >> 20, 1 << 17), np.uint8)
    for row in pieces.collect():
        table[row.piece] |= np.frombuffer(row.bits, np.uint8)
    return table.ravel()


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("place")


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    """The filters of the further orders, then the sets themselves."""
    with np.errstate(over="ignore"):
        for seed in SEEDS:
            a, b = ((x * np.uint64(seed)) ^ (x * np.uint64(seed) >> np.uint64(31)) for x in (one, two))
            a, b = (np.partition(x, (k := prefix_length(len(x))) - 1)[:k] for x in (a, b))
            if not len(np.intersect1d(a, b, assume_unique=True)):
                return False
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * shared >= PERCENT * (len(one) + len(two) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("tokens_a"), batch.column("tokens_b"))
        keep = [linked(*(np.frombuffer(x.as_py(), "<u8") for x in pair)) for pair in pairs]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, seed: int) -> DataFrame:
    """The linked ones of the pairs ``a, b``; only the sets of their nodes are made."""
    pairs = staged(pairs)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = staged(ends.join(nodes.select("node", "doc_id"), "node"))
    bits = min(BLOOM_MOST, 1 << max(20, (BLOOM_EACH * wanted.count()).bit_length()))
    made = staged(
        texts.select("text", _place(bits))
        .mapInArrow(tidy(_sets(_bloom(wanted, bits), seed)), "node long, tokens binary")
        .join(wanted.select("node"), "node")
    )
    # Dealt by node once, for both sides of the pairs.
    sets = made.dropDuplicates(["node"])
    for side in ("a", "b"):
        own = sets.select(F.col("node").alias(side), F.col("tokens").alias(f"tokens_{side}"))
        pairs = pairs.join(own, side)
    return staged(pairs.mapInArrow(tidy(_verify), "a long, b long"))


def near(x: str, y: str) -> Column:
    """Whether sizes and bitmaps of two nodes allow a link."""
    flips = " + ".join(f"bit_count({x}.bitmap[{i}] ^ {y}.bitmap[{i}])" for i in range(BITMAP_WORDS))
    return F.expr(
        f"100 * least({x}.n, {y}.n) >= {PERCENT} * greatest({x}.n, {y}.n)"
        f" and {100 + PERCENT} * ({flips}) <= {100 - PERCENT} * ({x}.n + {y}.n)"
    )


def cluster(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id, text``)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    seed, size = 0, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(size // WORD_BYTES)
    while True:
        survey = staged(texts.mapInArrow(tidy(_survey(seed, bits)), SURVEY))
        rows = survey.where("n is not null")
        nodes = staged(
            rows.where("n > 0").groupBy("node")
            .agg(
                F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("bitmap").alias("bitmap"),
                F.min("mark").alias("low"), F.max("mark").alias("high"),
            )
        )
        # Two sets with one id are told apart by a second hash; then another seed is taken.
        total = nodes.agg(F.sum("n"), F.max(F.expr("low <> high"))).first()
        if not total[1]:
            break
        seed += 2
    table = frequencies(survey, bits)
    ranges = max(12, (total[0] or 0) // 2_000_000)
    common_from = int(level(np.array(max(COMMON, TIMES_MEAN * (total[0] or 0) >> bits))))
    packed = texts.mapInArrow(tidy(_pack(table, common_from, seed, ranges)), "part int, tokens binary, nodes binary")
    # Packs of common tokens (part -1) are dealt out anyhow; they pass through.
    dealt = packed.repartition(ranges, F.when(F.col("part") < 0, F.xxhash64("nodes")).otherwise(F.col("part")))
    found = dealt.mapInArrow(tidy(_shared), "token long, node long, short boolean, hub long, more boolean")
    shared = staged(with_hubs(staged(found)))
    links = verified(star_pairs(shared, nodes), nodes, texts, seed)
    labels = components(links)
    more = verified(open_pairs(shared, nodes, labels), nodes, texts, seed)
    return _named(rows, nodes, components(links.unionByName(more)))


def star_pairs(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with the hub of each of its tokens, where the filters let the pair pass."""
    about = nodes.select("node", "n", "bitmap")
    pairs = shared.select("node", "hub").distinct().join(about, "node").alias("x")
    pairs = pairs.join(about.alias("y"), (F.col("x.hub") == F.col("y.node")) & near("x", "y"))
    return pairs.select(F.col("x.hub").alias("a"), F.col("x.node").alias("b"))


def open_pairs(shared: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with a common token and no common component that the filters let pass.

    The smaller set of a linked pair shares a token of its short prefix. Of all such tokens of a
    pair only the first by value is wanted, or else a pair of near copies comes once for each.
    So every node carries the first few of its tokens, and a pair is passed over at a token
    where these show an earlier one that brings it.
    """
    comps = nodes.select("node").join(labels, "node", "left")
    comps = comps.select("node", F.coalesce("comp", "node").alias("comp"))
    of_hub = comps.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    # Where a token has one node beside its hub, their pair is settled.
    rows = shared.where("more").drop("more")
    narrow = staged(
        rows.join(comps, "node").join(of_hub, "hub")
        .select("token", "node", "short", "comp", (F.col("comp") != F.col("hub_comp")).alias("outside"))
    )
    # Tokens whose nodes are all in one component are done; the others' rows get what filters need.
    narrow = narrow.join(narrow.where("outside").select("token").distinct(), "token", "left_semi")
    first = narrow.groupBy("node").agg(
        F.slice(F.array_sort(F.collect_list("token")), 1, FIRST).alias("firsts"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("short"), F.col("token")))), 1, FIRST).alias("shorts"),
    )
    about = nodes.select("node", "n", "bitmap").join(first, "node")
    every = staged(narrow.join(about, "node"))
    # One side holds the nodes outside the component of the token's hub: nodes of a large
    # group of near copies never meet each other here. Two outside meet once.
    meet = F.expr(
        "x.token = y.token and x.comp <> y.comp and (not y.outside or x.node < y.node)"
        " and (x.short and x.n <= y.n or y.short and y.n <= x.n)"
    )
    earlier = [
        F.when(F.expr(f"{a}.n <= {b}.n"), F.array_min(F.array_intersect(f"{a}.shorts", f"{b}.firsts")))
        for a, b in (("x", "y"), ("y", "x"))
    ]
    wanted = ~F.coalesce(F.least(*earlier) < F.col("x.token"), F.lit(False))
    pairs = every.where("outside").alias("x").join(every.alias("y"), meet & near("x", "y") & wanted)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _named(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The least doc_id of each component for every document."""
    of = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = of.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = of.join(least, "comp").select("node", "component_id")
    full = rows.join(named, "node", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
