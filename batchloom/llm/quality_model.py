"""Quality classifier from weak labels: labellers whose accuracies are learned teach a scorer.

Heuristic labellers that overlap call a document good, bad or abstain. Their votes are counted
by pattern over all documents; expectation-maximisation on these few counts estimates each
labeller's votes on good and bad documents, and so a posterior label for each pattern. A linear
scorer over hashed features is then fitted to the posterior labels of a bounded sample: at
most ``sample`` documents, the smallest by a hash of their id. Features are the words, their
shapes and pairs of neighbouring shapes, as shares of the document (short ones damped), so the scorer also tells
documents on which most labellers abstain. Every document is scored whole, in one pass.

The labeller on variety calls no text of 2,000 words or more bad: that few of their words differ
is usual.

Tasks take texts in groups, find out what there is to know of a word once, and sum by arrays.

Edge cases: null and empty texts have no features; they are called bad with the score 0.
Repeated rows give equal rows. Sampled rows that tie by hash and id are taken by the hash of their
text. A score of exactly ``MIN_SCORE`` keeps the document. With no documents at all there is
nothing to score. Texts are read whole, whatever their length; a task holds the words of one
and, for the fit, the features of the sample. Only ``doc_id`` and ``text`` are read, so other
columns never clash.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ROUNDS = 30
EPOCHS = 20
MIN_SCORE = 0.5
GOOD, NONE, BAD = 1, 0, -1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS, BLANKS = frozenset("#*$%&|<>~^=\\{}"), frozenset(" \t\n\v\f\r")
#: Of good and bad documents, the shares of votes (bad, none, good) before the first round.
START = ((0.02, 0.48, 0.5), (0.3, 0.5, 0.2))
KEPT_WORDS = 400_000
#: Words of the texts that a task takes together.
GROUP = 50_000


class _Kinds(dict):
    """For ``str.translate``: what each character counts as."""

    def __init__(self, kind: Callable[[str], str]) -> None:
        self.kind = kind

    def __missing__(self, point: int) -> str:
        self[point] = found = self.kind(chr(point))
        return found


_SHAPES = _Kinds(lambda c: "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c)
RUN = re.compile(r"(.)\1{2,}", re.DOTALL)


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs cut short; other characters as they are."""
    return RUN.sub(r"\1\1", word[:24].translate(_SHAPES))


def grouped(texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[list[bytes]]]]:
    """The texts in groups of some ``GROUP`` words, and their words. A null text is an empty one."""
    group: list[str] = []
    words: list[list[bytes]] = []
    size = 0
    for text in texts:
        group.append(text or "")
        # Bytes are split at the white space between words and nowhere else.
        words.append(group[-1].encode().split())
        size += len(words[-1])
        if size >= GROUP:
            yield group, words
            group, words, size = [], [], 0
    if group:
        yield group, words


class Words(dict):
    """Places of the words met, in a table with a row for each thing that ``look`` finds out."""

    def __init__(self, look: Callable[[str], tuple[int, ...]]) -> None:
        self.look = look
        self.new: list[tuple[int, ...]] = []
        self.table = np.empty((len(look("a")), 1024), np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.new.append(self.look(word.decode()))
        return place

    def places(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of the texts its text's number and its place."""
        if len(self) >= KEPT_WORDS:
            self.clear()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        places = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
        if self.new:
            more = len(self) - self.table.shape[1]
            if more > 0:
                room = np.empty((len(self.table), max(more, self.table.shape[1])), np.int64)
                self.table = np.concatenate([self.table, room], axis=1)
            self.table[:, len(self) - len(self.new) : len(self)] = np.array(self.new).T
            self.new = []
        return np.repeat(np.arange(len(words)), sizes), places


class _Traits:
    """What code points are: bits for a blank, a letter, an upper-case character, a symbol and the
    end of a sentence. A code point is looked up once."""

    def __init__(self) -> None:
        self.known = np.full(sys.maxunicode + 1, 255, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.known[points]
        if (found == 255).any():
            for point in np.unique(points[found == 255]).tolist():
                c = chr(point)
                traits = c in BLANKS, c.isalpha(), c.isupper(), c in SYMBOLS, c in ".!?"
                self.known[point] = sum(bit << i for i, bit in enumerate(traits))
            found = self.known[points]
        return found


@dataclass
class Facts:
    """What labellers look at."""

    words: int
    letters: int
    upper: int
    symbols: int
    bare: int
    distinct: int
    repeated: int
    lines: int
    distinct_lines: int
    ends: int

    @classmethod
    def of(cls, text: str) -> Facts:
        return next(cls.all([text]))

    @classmethod
    def all(cls, texts: Iterable[str | None]) -> Iterator[Facts]:
        """Of each text."""
        traits = _Traits()
        for group, words in grouped(texts):
            points = np.frombuffer(" ".join([*group, ""]).encode("utf-32-le"), np.uint32)
            sizes = np.fromiter(map(len, group), np.int64, len(group)) + 1
            found = traits.of(points)
            starts = np.cumsum(sizes) - sizes
            count = lambda has: np.add.reduceat(has, starts, dtype=np.int64).tolist()
            inside, letter = found & 1 == 0, found & 2 > 0
            # A blank follows each text, so that every word has an end.
            first, last = np.flatnonzero(inside[1:] > inside[:-1]) + 1, np.flatnonzero(inside[1:] < inside[:-1])
            first = np.concatenate([np.flatnonzero(inside[:1]), first])
            so_far = np.cumsum(letter)
            bare, ends = np.zeros(len(points), bool), np.zeros(len(points), bool)
            bare[first] = so_far[last] - so_far[first] + letter[first] == 0
            ends[last] = found[last] & 16 > 0
            columns = count(letter), count(found & 4 > 0), count(found & 8 > 0), count(bare), count(ends)
            for text, own, letters, upper, symbols, plain, done in zip(group, words, *columns):
                lines = [x for x in text.split("\n") if x.strip()]
                repeated = sum(map(eq, own, own[1:]))
                yield cls(
                    len(own), letters, upper, symbols, plain, len(set(own)), repeated, len(lines), len(set(lines)), done
                )


def labels(f: Facts) -> tuple[int, ...]:
    """The votes of the labellers on one document."""
    n = max(1, f.words)
    # What is good in one way does not speak for a text that is odd in another.
    plain = (
        f.symbols <= 0.05 * n and f.bare <= 0.1 * max(n, 20)
        and f.upper <= 0.2 * f.letters and f.repeated <= 0.1 * n
    )

    def vote(good: bool, bad: bool) -> int:
        return BAD if bad else GOOD if good and plain else NONE

    return (
        vote(False, f.symbols > 0.1 * n),
        vote(False, f.symbols + f.bare > 0.15 * max(n, 20)),
        vote(False, f.upper > 0.4 * max(1, f.letters)),
        vote(0.005 * f.letters <= f.upper <= 0.15 * f.letters and f.words >= 20, f.upper > 0.6 * max(1, f.letters)),
        vote(False, f.repeated > 0.2 * n),
        vote(f.repeated <= 0.02 * n and f.distinct > 0.4 * n, f.distinct < 0.25 * n and n < 2_000),
        vote(False, 3 * f.distinct_lines < 2 * f.lines),
        vote(0.01 * n <= f.ends <= 0.4 * n, f.ends < 0.005 * n and n >= 50),
        vote(3 * n <= f.letters <= 12 * n, not 2 * n <= f.letters <= 16 * n),
    )


LABELLERS = len(labels(Facts.of("")))


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each pattern of votes with its documents in the batch."""
    for batch in batches:
        found = Counter(map(labels, Facts.all(text for text in batch.text if text)))
        rows = [(",".join(map(str, votes)), n) for votes, n in found.items()]
        yield pd.DataFrame(rows, columns=["votes", "n"])


def estimate(patterns: dict[tuple[int, ...], int]) -> tuple[float, np.ndarray]:
    """Share of good documents and, for good and bad ones, each labeller's vote shares."""
    votes = np.array(list(patterns), dtype=int).reshape(-1, LABELLERS) + 1
    n = np.array(list(patterns.values()), dtype=float)
    start = np.array(START)[:, None, :].repeat(LABELLERS, axis=1)
    prior, shares = 0.8, start
    for _ in range(ROUNDS):
        good = posterior(votes, prior, shares) * n
        prior = (good.sum() + 3.2) / (n.sum() + 4)
        weights = np.stack([good, n - good])
        # Four made-up documents of each kind, voted on as at the start.
        counts = np.stack([(weights[:, :, None] * (votes == v)).sum(axis=1) for v in range(3)], axis=2)
        shares = counts + 4 * start
        shares /= shares.sum(axis=2, keepdims=True)
    return prior, shares


def posterior(votes: np.ndarray, prior: float, shares: np.ndarray) -> np.ndarray:
    """The probability of being good for rows of votes from 0 to 2."""
    at = np.arange(votes.shape[1])
    gain = np.log(shares[0][at, votes] / shares[1][at, votes]).sum(axis=1)
    return 1 / (1 + np.exp(-(gain + math.log(prior / (1 - prior)))))


def _bucket(text: str) -> int:
    return xxhash.xxh32_intdigest(text) % BUCKETS


class Hasher:
    """Hashed features of texts; keeps what it has worked out for words and forms."""

    def __init__(self) -> None:
        self.forms: dict[str, tuple[int, int]] = {}
        self.words = Words(self.word)

    def word(self, word: str) -> tuple[int, int, int]:
        """The buckets of the word and of its form, and the hash of the form in pairs."""
        raw = word[:24].translate(_SHAPES)
        found = self.forms.get(raw)
        if found is None:
            if len(self.forms) >= KEPT_WORDS:
                self.forms = {}
            form = shape(word)
            self.forms[raw] = found = _bucket("s" + form), xxhash.xxh32_intdigest("p" + form)
        return _bucket("w" + word.lower()), *found

    def groups(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By groups of texts: how many they are, each word's text, bucket and form's bucket, and
        for each word but the first one of a text the pair's bucket and whether it repeats."""
        for group, words in grouped(texts):
            doc, at = self.words.places(words)
            word, form, hashed = (row[at] for row in self.words.table)
            inside = doc[1:] == doc[:-1]
            pairs = np.where(inside, (hashed[:-1] * 31 + hashed[1:]) % BUCKETS, -1)
            yield len(group), doc, word, form, pairs, inside & (word[1:] == word[:-1])

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their shares of the text."""
        _, doc, word, form, pairs, same = next(self.groups([text]))
        if not len(doc):
            return np.empty(0, np.int64), np.empty(0)
        buckets, counts = np.unique(np.concatenate([word, form, pairs]), return_counts=True)
        # Two buckets of their own: repeated neighbours and a constant.
        damped = len(doc) + 5  # a few words say little
        return np.append(buckets, [0, 1]), np.append(counts / damped, [same.sum() / damped, 1.0])

    def sums(self, texts: Iterable[str | None], weights: np.ndarray) -> Iterator[np.ndarray]:
        """The weighted sums of the texts' features, by groups; minus infinity without words."""
        for n, doc, word, form, pairs, same in self.groups(texts):
            total = np.bincount(doc, weights[word] + weights[form], n)
            more = np.where(pairs >= 0, weights[pairs], 0.0) + same * weights[0]
            total += np.bincount(doc[1:], more, n)
            sizes = np.bincount(doc, minlength=n)
            yield np.where(sizes > 0, total / (sizes + 5) + weights[1], -np.inf)


@dataclass
class Model:
    weights: np.ndarray
    prior: float
    shares: np.ndarray


def fit(docs: DataFrame, sample: int = 12_000) -> Model:
    """Learn from the texts of ``docs`` alone."""
    texts = docs.select("doc_id", "text")
    rows = (
        texts.select("text").mapInPandas(_vote, "votes string, n long")
        .groupBy("votes").agg(F.sum("n").alias("n")).collect()
    )
    patterns = {tuple(map(int, row.votes.split(","))): row.n for row in rows}
    prior, shares = estimate(patterns)
    total = sum(patterns.values())
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    near = texts.where("text <> ''").where(hashed * total < 2_000_000 * sample)
    chosen = near.orderBy(hashed, "doc_id", F.xxhash64("text")).limit(sample)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        sampled = [text for batch in batches for text in batch.text]
        if not sampled:
            return
        votes = np.array([*map(labels, Facts.all(sampled))], dtype=int) + 1
        weights = train([*map(hasher.features, sampled)], posterior(votes, prior, shares))
        yield pd.DataFrame({"weights": [weights.tobytes()]})

    # The sample has a fixed bound, so one task may see all of it.
    learned = chosen.repartition(1).mapInPandas(learn, "weights binary").collect()
    weights = np.frombuffer(learned[0].weights, float) if learned else np.zeros(BUCKETS)
    return Model(weights, prior, shares)


def train(features: list, target: np.ndarray) -> np.ndarray:
    """Logistic regression with soft labels by stochastic gradient steps, averaged."""
    weights, mean, scale = np.zeros(BUCKETS), np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    order, steps = np.random.default_rng(7), 0
    for epoch in range(EPOCHS):
        for i in order.permutation(len(features)):
            at, x = features[i]
            score = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[at] @ x)))))
            slope = (score - target[i]) * x
            scale[at] += slope * slope
            weights[at] -= 0.5 * slope / np.sqrt(scale[at])
        if epoch >= EPOCHS // 2:
            mean, steps = mean + weights, steps + 1
    return mean / steps


def score_of(model: Model, text: str = "text") -> Column:
    """The score of the text from 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for batch in batches:
            sums = np.concatenate([np.empty(0), *hasher.sums(batch, model.weights)])
            yield pd.Series(1 / (1 + np.exp(-np.maximum(sums, -700.0))) * (sums > -np.inf))

    return score(F.col(text))


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, kept`` of each row."""
    scored = docs.select("doc_id", score_of(model).alias("score"))
    return scored.withColumn("kept", F.col("score") >= MIN_SCORE)
