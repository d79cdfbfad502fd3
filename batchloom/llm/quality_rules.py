"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are learned.

Each rule calls a document good (1), bad (-1) or abstains (0). Expectation-maximisation over
the vote patterns estimates the share of good documents and, for each rule, how often it votes
either way or abstains on good and on bad documents. The posterior probability that a document
is good replaces the demand that every rule be met.

Only DataFrame functions are used. The patterns are at most 3 to the number of rules; every
round is one aggregate over them that returns one row.

The rule on variety abstains on texts of 2,000 words and more: that few of their words differ
is usual, and says nothing of them.

Edge cases: null and empty texts have no word and fail the base rule. Repeated rows give
equal rows. Rules that never vote say nothing. A posterior of exactly ``MIN_POSTERIOR`` keeps the
document. An empty table gives an empty one. Texts are read whole, whatever their length; a task
holds the words of one. Only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import staged, words_of

ROUNDS = 15
MIN_POSTERIOR = 0.5
MADE_UP = 4
MIN_WORDS = 50
#: A word without a letter.
BARE = (
    r"[^\p{L}\x20\x09-\x0D](?<=(?:\A|[\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D])"
    r"[^\p{L}\x20\x09-\x0D]*+(?![^\x20\x09-\x0D])"
)


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside three-word windows that the text has twice or more.

    ``hashes`` holds the words' hashes. Each step is a projection of its own, so that what
    several expressions need is made once.
    """
    size = lambda c: F.greatest(F.size(c), F.lit(1))
    later = lambda c, i: F.slice(c, i, size(c))
    pair = F.zip_with("hashes", later("hashes", 2), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with("_w", later("hashes", 3), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("_w", pair).withColumn("_w", three)
    rows = rows.withColumn("_w", F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))))
    # Only texts that repeat a window are sorted.
    placed = F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("_w", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), placed))
    none = F.expr("array(cast(null as struct<w:bigint,i:int>))")
    beside = F.arrays_zip(
        F.col("_w").alias("own"), F.concat(none, "_w").alias("last"), later("_w", 2).alias("next")
    )
    twice = F.filter(
        beside,
        lambda x: x["own"].isNotNull()
        & (x["own"]["w"].eqNullSafe(x["last"]["w"]) | x["own"]["w"].eqNullSafe(x["next"]["w"])),
    )
    rows = rows.withColumn("_w", F.sort_array(F.transform(twice, lambda x: x["own"]["i"])))
    # A window adds three words, or as many as lie before the next one.
    added = F.zip_with("_w", later("_w", 2), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    total = F.aggregate(added, F.lit(0), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_w")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that the rules need, of whole texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    rows = rows.select(
        "doc_id", "text",
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
    )
    rows = rows.select(
        "doc_id", "hashes",
        long(F.size("hashes")).alias("n_words"),
        long(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.array_distinct("hashes"))).alias("n_distinct"),
        long(F.regexp_count("text", F.lit(r"\p{Lu}\p{Lu}"))).alias("n_upper_pairs"),
        long(F.regexp_count("text", F.lit(BARE))).alias("n_bare"),
        long(F.regexp_count("text", F.lit(r"[.!?](?:[\x20\x09-\x0D]|\z)"))).alias("n_ends"),
        long(F.regexp_count("text", F.lit(r"!!|\?\?|\*\*\*|[#$%&]{2}"))).alias("n_bursts"),
    )
    return with_repeated_words(rows).drop("hashes")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """The votes of each rule on the counts of a document."""
    per = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    letters = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    no = F.lit(False)
    return {
        "length": _vote(no, F.col("n_words") < MIN_WORDS),
        "symbols": _vote(no, per("n_symbols") > 0.1),
        "bursts": _vote(no, per("n_bursts") > 0.1),
        "dup_lines": _vote(no, 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": _vote(no, per("n_repeat_words") > 0.3),
        "variety": _vote(no, (per("n_distinct") < 0.25) & (F.col("n_words") < 2_000)),
        "shouting": _vote(no, per("n_upper_pairs") > 0.3),
        "bare": _vote(no, per("n_bare") > 0.2),
        "sentences": _vote(
            per("n_ends").between(0.02, 0.5) & (per("n_symbols") < 0.05),
            (F.col("n_ends") * 100 < F.col("n_words")) & (F.col("n_words") >= MIN_WORDS),
        ),
        "plain": _vote(
            letters.between(3, 12) & (per("n_bare") < 0.1) & (per("n_upper_pairs") < 0.1)
            & (per("n_repeat_words") < 0.2) & (per("n_bursts") < 0.05),
            ~letters.between(2, 20),
        ),
    }


#: Of good and of bad documents, the shares that a rule calls bad, abstains on and calls good,
#: before the first round: rules are taken to be right more often than wrong.
START = {"good": (0.02, 0.48, 0.5), "bad": (0.3, 0.5, 0.2)}
VOTES = (-1, 0, 1)


@dataclass
class Accuracies:
    #: Share of good documents.
    prior: float
    #: For each rule, the shares of its votes (bad, none, good) on good and on bad documents.
    good: dict[str, tuple[float, float, float]]
    bad: dict[str, tuple[float, float, float]]


def posterior(a: Accuracies) -> Column:
    """The probability that a row with these votes is good."""
    odds = F.lit(math.log(a.prior / (1 - a.prior)))
    for rule in a.good:
        gain = [math.log(g / b) for g, b in zip(a.good[rule], a.bad[rule])]
        odds += F.when(F.col(rule) < 0, gain[0]).when(F.col(rule) > 0, gain[2]).otherwise(gain[1])
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, names: list[str]) -> Accuracies:
    """Expectation-maximisation over the vote patterns of all documents."""
    patterns = staged(votes.groupBy(*names).agg(F.count("*").alias("n")))
    a = Accuracies(0.8, dict.fromkeys(names, START["good"]), dict.fromkeys(names, START["bad"]))
    for _ in range(ROUNDS):
        weighed = patterns.select(*names, "n", (posterior(a) * F.col("n")).alias("good"))
        weighed = weighed.withColumn("bad", F.col("n") - F.col("good"))
        sums = [
            F.sum(F.when(F.col(rule) == vote, F.col(side))).alias(f"{side}{vote}_{rule}")
            for side in START for rule in names for vote in VOTES
        ]
        row = weighed.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), *sums).first()
        row = {k: v or 0.0 for k, v in row.asDict().items()}

        def shares(side: str, rule: str) -> tuple[float, ...]:
            # A few made-up documents, voted on as at the start, keep rates from extremes.
            have = [row[f"{side}{v}_{rule}"] + MADE_UP * s for v, s in zip(VOTES, START[side])]
            return tuple(x / sum(have) for x in have)

        prior = (row["good"] + 0.8 * MADE_UP) / (row["n"] + MADE_UP)
        a = Accuracies(prior, *({rule: shares(side, rule) for rule in names} for side in START))
    return a


def judged(docs: DataFrame) -> DataFrame:
    """The counts of each document, ``base_failed``, the ``posterior`` and ``kept``."""
    counts = staged(measured(docs))
    votes = rules()
    voted = counts.withColumns(votes)
    learned = estimate(voted, list(votes))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("posterior", posterior(learned))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= MIN_POSTERIOR))
    )
