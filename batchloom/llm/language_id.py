"""Language identification: known words first, then ever shorter character n-grams.

A word the model knows costs the negative log10 of its relative frequency in each language.
An unseen word is cut into n-grams of the longest order of which at least one is known, and
costs the mean of those. A text costs the mean over its words, and the cheapest language
wins; equal costs go to the first language in alphabetical order.

The model is fitted on a bounded sample: at most ``sample_per_language`` labelled rows of
each language, the smallest by a hash of their id, and ``SAMPLE`` rows in all. It keeps at most
``max_words`` words (of those seen more than once in the sample) and ``max_grams`` n-grams of
each order for each language, and ``UNITS`` costs in all, so its size has a fixed bound and it
may travel to every task. Only costs of units that a language has are kept; all others share one.
Beyond ``max_languages`` labels only the commonest are learned. Every text is scored whole; a
task holds the costs of ``KEPT_WORDS`` words, or of one group of texts if that has more.

Edge cases: ties go to the first language in alphabetical order; an empty table teaches and gives
nothing; repeated rows are scored alike; further columns of any name pass through, but for those
that the operator itself adds, which are replaced. a null text or one without a letter gives ``und`` with score 0. A text whose
letters are all unknown gives the language with the most labelled rows, with that share as
score. Without any labelled row every text gives ``und``.

``judge`` also holds a text against the languages themselves. Its n-grams of order ``LOOK``
cost about the entropy of their language if it is written in it and far more if it is in none
that the model knows, however clearly one of these is the cheapest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import staged, tidy
from batchloom.llm.substring_dedup import Hashes
from batchloom.operators.ordering import free_name
from batchloom.sources.catalog import quoted

ORDERS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
#: Rows of the sample and costs of the model, in all.
SAMPLE, UNITS = 600_000, 2_000_000
#: Words whose costs a task keeps; it starts anew beyond that.
KEPT_WORDS = 60_000
#: Different words of the texts that a task scores together; texts it counts at a time.
GROUP, COUNTED = 20_000, 250
WORD = re.compile(r"[^\W\d_]+")
RESULT = "lang_pred string, score double"
VERDICT = f"{RESULT}, strange double, against double"
#: The order of n-grams by which a text is held against the language found.
LOOK = 3
#: By how much single n-grams scatter, three times over.
SPREAD = 3.0
#: Rows by which a language is known well enough to doubt one of them.
FEW = 50


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str, order: int) -> list[str]:
    """The n-grams of the word between blanks; at order 1, its letters."""
    padded = f" {word} " if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class Costs:
    """Rows of costs, one for each language; most are ``absent`` and not held."""

    def __init__(self, ends: np.ndarray, languages: np.ndarray, below: np.ndarray, absent: float):
        self.ends, self.languages, self.below, self.absent = ends, languages, below, absent

    @classmethod
    def of(cls, rows: np.ndarray, languages: np.ndarray, costs: np.ndarray, n: int) -> Costs:
        """From single costs; a language that a row lacks costs more than any unit costs."""
        absent = float(costs.max() if len(costs) else 0) + 1
        order = np.argsort(rows, kind="stable")
        ends = np.cumsum(np.bincount(rows, minlength=n))
        return cls(ends, languages[order].astype(np.int32), costs[order] - absent, absent)

    @classmethod
    def dense(cls, table: np.ndarray) -> Costs:
        absent = float(table.max()) if table.size else 0.0
        rows, languages = np.nonzero(table < absent)
        ends = np.cumsum(np.bincount(rows, minlength=len(table)))
        return cls(ends, languages.astype(np.int32), table[rows, languages] - absent, absent)

    def __len__(self) -> int:
        return len(self.ends)

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of what these rows hold, and for each the position of its row."""
        starts = np.where(rows > 0, self.ends[rows - 1], 0) if len(rows) else rows
        sizes = self.ends[rows] - starts
        owner = np.repeat(np.arange(len(rows)), sizes)
        return np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), owner

    def mixed(self, rows: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, width: int) -> Costs:
        """``n`` new rows, each the weighted sum of those rows here that it owns."""
        at, which = self.entries(rows)
        keys = owner[which] * width + self.languages[at]
        found, place = np.unique(keys, return_inverse=True)
        below = np.bincount(place, self.below[at] * weight[which], len(found))
        ends = np.cumsum(np.bincount(found // width, minlength=n))
        return Costs(ends, (found % width).astype(np.int32), below, self.absent)

    def extended(self, more: Costs) -> Costs:
        last = self.ends[-1] if len(self.ends) else 0
        return Costs(
            np.concatenate([self.ends, more.ends + last]),
            np.concatenate([self.languages, more.languages]),
            np.concatenate([self.below, more.below]),
            self.absent,
        )

    def total(self, rows: np.ndarray, times: np.ndarray, width: int) -> np.ndarray:
        """What the rows hold, so many times each, by language."""
        at, which = self.entries(rows)
        return np.bincount(self.languages[at], self.below[at] * times[which], width)


def no_costs(absent: float) -> Costs:
    return Costs(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), absent)


class Spelled:
    """Words as code points with a blank around each; hashes of all their n-grams at once."""

    def __init__(self, words: Sequence[str]):
        joined = f" {' '.join(words)} ".encode("utf-32-le")
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = 1 + np.cumsum(self.sizes + 1) - (self.sizes + 1)
        points = np.frombuffer(joined, np.uint32).astype(np.uint64) + np.uint64(1)
        self._hashes = Hashes(points * np.uint64(0xD6E8FEB86659FD93))

    def whole(self) -> np.ndarray:
        """The hash of each word."""
        return self._hashes.of(self.starts, self.sizes)

    def grams(self, order: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the n-grams of some words, and whose each is."""
        pad = int(order > 1)
        counts = np.maximum(self.sizes[which] + 2 * pad - order + 1, 0)
        owner = np.repeat(which, counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self._hashes.of(self.starts[owner] - pad + place, order), owner


class Units:
    """Rows of words or n-grams, looked up by their hash."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.rows = hashes[order], rows[order].astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rows[at], -1)


def _units(rows: dict[str, int]) -> Units:
    return Units(Spelled(list(rows)).whole(), np.fromiter(rows.values(), np.int64, len(rows)))


class Model:
    """What is known of languages. ``words`` and ``grams`` give the row in ``costs`` of each; a
    blank at an end tells n-grams apart. ``costs`` may be a full table, by unit and language."""

    def __init__(
        self,
        languages: list[str],
        words: dict[str, int],
        grams: dict[str, int],
        costs: Costs | np.ndarray,
        share: np.ndarray,
    ):
        self.languages, self.share = languages, share
        self.costs = Costs.dense(costs) if isinstance(costs, np.ndarray) else costs
        self.words = _units(words)
        self.grams = {n: _units({g: i for g, i in grams.items() if len(g) == n}) for n in ORDERS}


def sample(labelled: DataFrame, sizes: dict[str, int], per_language: int) -> DataFrame:
    """At most so many rows of each language, of ``doc_id, text, lang``."""
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    # Twice the rows wanted survive this cheap filter, so that no large group is sorted.
    cuts = [F.lit(x) for size in sizes.items() for x in (size[0], 2_000_000 * per_language // size[1])]
    near = labelled.where(hashed <= F.try_element_at(F.create_map(*cuts), F.col("lang"))) if cuts else labelled
    first = Window.partitionBy("lang").orderBy(hashed, "doc_id", F.xxhash64("text"))
    return (
        near.withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= per_language)
        .select("doc_id", "lang", "text")
    )


def sizes_of(labelled: DataFrame, max_languages: int) -> dict[str, int]:
    """Rows of each language; of the ``max_languages`` commonest if there are more."""
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    return {row["lang"]: row["count"] for row in counts.limit(max_languages).collect()}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams with their counts by language, handed in after every few texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, COUNTED):
            found: dict[str, Counter] = {}
            part = batch.slice(start, COUNTED)
            for language, text in zip(part.column("lang"), part.column("text"), strict=True):
                found.setdefault(language.as_py(), Counter()).update(words(text.as_py()))
            for language, seen in found.items():
                for kind in (0, *ORDERS):
                    units = seen if kind == 0 else Counter()
                    for word, n in seen.items() if kind else ():
                        for gram in grams(word, kind):
                            units[gram] += n
                    columns = {
                        "lang": pa.array([language] * len(units), pa.string()),
                        "kind": pa.array([kind] * len(units), pa.int32()),
                        "unit": pa.array(units.keys(), pa.string()),
                        "n": pa.array(units.values(), pa.int64()),
                    }
                    yield pa.RecordBatch.from_pydict(columns)


def fit(
    labelled: DataFrame,
    sample_per_language: int = 1_500,
    max_words: int = 40_000,
    max_grams: int = 10_000,
    max_languages: int = 2_000,
) -> Model:
    """Learn from ``doc_id, text, lang``; rows without text or language teach nothing."""
    labelled = labelled.select("doc_id", "text", "lang").dropna(subset=["text", "lang"])
    size = sizes_of(labelled, max_languages)
    fraction = min(1, UNITS / max(1, len(size) * (max_words + len(ORDERS) * max_grams)))
    max_words, max_grams = round(max_words * fraction), round(max_grams * fraction)
    counts = (
        sample(labelled, size, _rows_each(sample_per_language, size))
        .select("lang", "text")
        .mapInArrow(tidy(_count), "lang string, kind int, unit string, n long")
        .groupBy("lang", "kind", "unit")
        .agg(F.sum("n").alias("n"))
    )
    group = Window.partitionBy("lang", "kind")
    kept = F.when(F.col("kind") == 0, max_words).otherwise(max_grams)
    rows = (
        counts.withColumn("total", F.sum("n").over(group))
        .withColumn("place", F.row_number().over(group.orderBy(F.desc("n"), "unit")))
        .where((F.col("place") <= kept) & ((F.col("n") > 1) | (F.col("kind") > 0)))
        .select("lang", "kind", "unit", "n", "total")
        .toArrow()
    )
    kinds, units = (rows.column(k).to_pylist() for k in ("kind", "unit"))
    languages = sorted(size)
    index: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for kind, unit in zip(kinds, units):
        index[kind > 0].setdefault(unit, len(index[0]) + len(index[1]))
    at = np.fromiter((index[kind > 0][unit] for kind, unit in zip(kinds, units)), np.int64, len(kinds))
    column = {language: i for i, language in enumerate(languages)}
    costs = Costs.of(
        at,
        np.fromiter(map(column.__getitem__, rows.column("lang").to_pylist()), np.int32, len(kinds)),
        -np.log10(rows.column("n").to_numpy() / rows.column("total").to_numpy()),
        len(index[0]) + len(index[1]),
    )
    rows_of = np.array([size[x] for x in languages], dtype=float)
    return Model(languages, *index, costs, rows_of / max(1, rows_of.sum()))


def _rows_each(sample_per_language: int, sizes: dict[str, int]) -> int:
    return min(sample_per_language, SAMPLE // max(1, len(sizes)))


def fit_agreed(labelled: DataFrame, sample_per_language: int = 1_500, max_languages: int = 2_000) -> Model:
    """Learn from the rows of a sample whose label a model of the other half finds again, so
    that mislabelled rows do not speak for themselves. Languages of fewer than ``FEW`` rows keep
    all of theirs: half of those would be too little to judge by."""
    labelled = labelled.select("doc_id", "text", "lang").dropna(subset=["text", "lang"])
    sizes = sizes_of(labelled, max_languages)
    rows = sample(labelled, sizes, _rows_each(sample_per_language, sizes))
    rows = staged(rows.withColumn("half", F.pmod(F.xxhash64("text", "doc_id"), F.lit(2))))
    agreed = []
    for half in (0, 1):
        model = fit(rows.where(F.col("half") != half), sample_per_language)
        known = [x for x in model.languages if sizes[x] >= FEW]
        same = (F.col("lang_pred") == F.col("lang")) | ~F.col("lang").isin(known)
        agreed.append(identify(rows.where(F.col("half") == half), model).where(same))
    return fit(staged(agreed[0].unionByName(agreed[1])), sample_per_language)


class Scorer:
    """A task's copy of the model, with the costs of the words that it has met.

    Words are learned and texts scored in groups, so that costs are summed by arrays.
    """

    def __init__(self, model: Model, looks: bool = False) -> None:
        self.model, self.by_look = model, looks
        self.width = len(model.languages)
        costs = model.costs
        self.unseen = costs.absent + 1
        if looks:
            at = model.grams[LOOK].rows
            places, _ = costs.entries(at)
            own, of = costs.below[places] + costs.absent, costs.languages[places]
            lacking = (len(at) - np.bincount(of, minlength=self.width)) * 10.0**-costs.absent
            part = np.bincount(of, 10.0**-own, self.width) + lacking
            whole = np.bincount(of, 10.0**-own * own, self.width) + lacking * costs.absent
            #: Of each language, the mean cost of its own n-grams of the order LOOK.
            self.usual = whole / np.maximum(part, 1e-300)
        self.start()

    def start(self) -> None:
        #: Rows of the words met; -1 where not even a letter is known.
        self.index: dict[str, int] = {}
        self.costs = no_costs(self.model.costs.absent)
        #: What the n-grams of order LOOK of a word cost, how many they are and how many unknown.
        self.looks = no_costs(self.model.costs.absent)
        self.cuts = np.zeros((2, 0), np.int64)

    def learn(self, new: list[str]) -> None:
        """Work out the costs of words not met so far."""
        model, spelled = self.model, Spelled(new)
        row = model.words.find(spelled.whole())
        found = [(row[row >= 0], np.flatnonzero(row >= 0))]
        rest = np.flatnonzero(row < 0)
        for order in ORDERS:
            hashes, owner = spelled.grams(order, rest)
            row = model.grams[order].find(hashes)
            found.append((row[row >= 0], owner[row >= 0]))
            rest = np.setdiff1d(rest, found[-1][1])
        rows, owner = map(np.concatenate, zip(*found, strict=True))
        start = len(self.costs)
        weight = 1 / np.maximum(np.bincount(owner, minlength=len(new)), 1)[owner]
        mixed = model.costs.mixed(rows, owner, weight, len(new), self.width)
        self.costs = self.costs.extended(mixed)
        self.index.update(zip(new, range(start, start + len(new)), strict=True))
        if self.by_look:
            self._learn_looks(spelled, len(new))
        for i in rest.tolist():
            self.index[new[i]] = -1 - (start + i)

    def _learn_looks(self, spelled: Spelled, n: int) -> None:
        hashes, owner = spelled.grams(LOOK, np.arange(n))
        row = self.model.grams[LOOK].find(hashes)
        known = row >= 0
        mixed = self.model.costs.mixed(row[known], owner[known], np.ones(known.sum()), n, self.width)
        self.looks = self.looks.extended(mixed)
        cuts = np.bincount(owner, minlength=n)
        cuts = np.stack([cuts, cuts - np.bincount(owner[known], minlength=n)])
        self.cuts = np.concatenate([self.cuts, cuts], axis=1)

    def prepare(self, group: list[Counter]) -> None:
        new = {word for found in group for word in found if word not in self.index}
        if len(self.index) + len(new) > KEPT_WORDS:
            self.start()
            new = {word for found in group for word in found}
        if new and self.width:
            self.learn(list(new))

    def predict(self, text: str | None) -> tuple[str, float]:
        return next(self.verdicts([text], None))[:2]

    def verdicts(self, texts: Iterable[str | None], stated: Iterable[str | None] | None) -> Iterator[tuple]:
        """``lang_pred, score`` of each text; with ``stated`` languages also ``strange`` and
        ``against`` as in ``judge``."""
        group: list[tuple[Counter, str | None]] = []
        size = 0
        for text, lang in zip(texts, stated if stated is not None else repeat(None)):
            found = Counter(words(text))
            group.append((found, lang))
            size += len(found)
            if size >= GROUP:
                yield from self._scored(group)
                group, size = [], 0
        yield from self._scored(group)

    def _scored(self, group: list[tuple[Counter, str | None]]) -> Iterator[tuple]:
        self.prepare([found for found, _ in group])
        return (self.verdict(found, lang) for found, lang in group)

    def verdict(self, found: Counter, stated: str | None) -> tuple:
        """The language, its score, what the text's look costs beyond the language's own, and
        what its words cost more in the stated language."""
        model = self.model
        if not self.width or not any(c.isalpha() for word in found for c in word):
            return UNDETERMINED, 0.0, math.inf, 0.0
        rows = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        times = np.fromiter(found.values(), np.int64, len(found))
        known = rows >= 0
        n = int(times[known].sum())
        if not n:
            best = int(model.share.argmax())
            return model.languages[best], float(model.share[best]), math.inf, 0.0
        mean = self.costs.total(rows[known], times[known], self.width) / n + self.costs.absent
        best = int(mean.argmin())
        # Words lean on each other, so a long text is no surer than one of 30 words.
        chance = np.exp((mean[best] - mean) * np.log(10) * min(n, 30))
        told = model.languages[best], float(1 / chance.sum())
        if not self.by_look:
            return *told, 0.0, 0.0
        places = np.where(known, rows, -1 - rows)
        size, unknown = (self.cuts[:, places] * times).sum(axis=1)
        cost = self.looks.total(places, times, self.width)[best]
        cost += (size - unknown) * self.costs.absent + unknown * self.unseen
        # So few n-grams may cost more by chance.
        strange = cost / size - self.usual[best] - SPREAD / math.sqrt(size)
        at = self.place_of.get(stated)
        return *told, float(strange), 0.0 if at is None else float(mean[at] - mean[best])

    @cached_property
    def place_of(self) -> dict[str, int]:
        return {language: i for i, language in enumerate(self.model.languages)}


def _struct(rows: list[tuple], fields: list[pa.Field]) -> pa.StructArray:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.StructArray.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields
    )


_FIELDS = [
    pa.field("lang_pred", pa.string()),
    *(pa.field(name, pa.float64()) for name in ("score", "strange", "against")),
]


def language_of(model: Model, text: str = "text") -> Column:
    """A struct of ``lang_pred`` and ``score`` for the text column."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            found = [x[:2] for x in scorer.verdicts((x.as_py() for x in batch), None)]
            yield _struct(found, _FIELDS[:2])

    return F.arrow_udf(tidy(predict), RESULT)(F.col(text))


def _with_fields(docs: DataFrame, found: Column, names: list[str]) -> DataFrame:
    """``docs`` with the fields of a struct in place of columns of their names."""
    kept = docs.drop(*names)
    verdict = free_name(kept, "verdict")
    full = kept.withColumn(verdict, found)
    return full.select(*(F.col(quoted(c)) for c in kept.columns), f"{verdict}.*")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    return _with_fields(docs, language_of(model), ["lang_pred", "score"])


def judged(model: Model, text: str = "text", lang: str = "lang") -> Column:
    """A struct of ``lang_pred`` and ``score``, ``strange`` and ``against`` for a text and the
    language that it is said to be in.

    ``strange`` is what the text's n-grams cost beyond those of the language found (infinite
    if no letter is known), ``against`` what its words cost more in the stated language.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = Scorer(model, looks=True)
        for texts, stated in batches:
            pairs = (x.as_py() for x in texts), (x.as_py() for x in stated)
            yield _struct(list(scorer.verdicts(*pairs)), _FIELDS)

    return F.arrow_udf(tidy(run), VERDICT)(F.col(text), F.col(lang))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the fields of ``judged``; columns of their names are replaced."""
    return _with_fields(docs, judged(model), ["lang_pred", "score", "strange", "against"])
