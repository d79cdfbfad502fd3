"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed in cells of source, language and topic. Raking scales the weights of
the cells, one margin after the other, until the weighted tokens of every source, language
and topic have their target shares. A document is then wanted ``rate`` times, the weight of
its cell times the wanted share of all tokens; it is drawn ``floor(rate)`` times and once more
with the probability of the rest. So expected tokens keep all three margins, also where
``rate`` is above one. The draw is a hash of the row, the same on every run.

Only DataFrame functions are used. Cells are few next to documents, but no bound is assumed:
they stay a table, and each raking step is a partial aggregate and a join, written before the
next one so that plans stay small on the driver.

Edge cases: a null source or language counts as the label ``(none)``. A text without words has
no tokens; it takes the weight of its cell. Labels without a target keep their own weight
share among each other; targets for labels without tokens are left out, and the rest is scaled
to one. Targets that no weights can meet are met as nearly as ``ROUNDS`` rounds allow, topics
last; ``margin_error`` tells. Equal rows are drawn alike, and ties cannot occur. An empty table
gives an empty one. Texts are counted whole, whatever their length. Columns named like the
result's are replaced; all others pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import GAP, staged
from batchloom.operators.ordering import free_name
from batchloom.sources.catalog import quoted

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 60
#: Greatest relative error of a margin at which raking ends.
TOLERANCE = 1e-4
#: What ``mixed`` adds to the columns of the documents.
ADDED = ("topic", "tokens", "rate", "copies", "margin_error")
#: Without given targets, shares are the tokens to this power: small groups gain.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}


def token_count(text: Column) -> Column:
    """Words of the text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{GAP}|{GAP}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def topic(text: Column) -> Column:
    """What kind of text it is, from its whole wording."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bars = F.length(low) - F.length(F.replace(low, F.lit("|"), F.lit("")))
    return (
        F.when(bars * 20 > F.length(low), "table")
        .when(low.contains("licen"), "licence")
        .when(low.contains("@") | low.contains("phone"), "contact")
        .when(F.length(low) < 500, "note")
        .otherwise("prose")
    )


def _label(dimension: str) -> Column:
    return F.coalesce(F.col(dimension), F.lit("(none)"))


def cells(measured: DataFrame) -> DataFrame:
    """Tokens of each cell; ``measured`` has the dimensions and ``tokens``."""
    return staged(measured.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens")))


def default_targets(table: DataFrame) -> dict[str, DataFrame]:
    """``label, share`` for each dimension, by ``TEMPER``."""
    return {
        d: table.groupBy(F.col(d).alias("label")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share"))
        for d, power in TEMPER.items()
    }


def _shares(table: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Wanted tokens of each label that has any, summing to all tokens."""
    wanted = {}
    for d in DIMENSIONS:
        own = table.groupBy(d).agg(F.sum("tokens").alias("own")).where("own > 0")
        if d in targets:
            given = targets[d].select(F.col("label").alias(d), "share")
            own = own.join(given, d, "left")
        else:
            own = own.withColumn("share", F.lit(None).cast("double"))
        # Labels without a target share what is theirs already; the others share the rest.
        totals = own.agg(
            F.sum("own").alias("all"),
            F.sum(F.when(F.col("share").isNull(), F.col("own"))).alias("free"),
            F.sum("share").alias("shares"),
        ).first()
        rest = (totals["all"] or 0.0) - (totals["free"] or 0.0)
        part = F.col("share") / F.lit(totals["shares"] or 1.0)
        goal = F.coalesce(part * F.lit(rest), F.col("own"))
        wanted[d] = staged(own.select(d, goal.alias("goal")))
    return wanted


def rake(table: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """The cells with the ``weight`` that gives every margin its target.

    ``margin_error`` is the greatest relative change that a margin still needed in the last
    round: above ``TOLERANCE`` only if ``ROUNDS`` rounds were not enough, as with targets that
    no weights can meet.
    """
    wanted = _shares(table, targets)
    current, worst = table.withColumn("weight", F.lit(1.0)), None
    goals = {d: f"goal_{d}" for d in DIMENSIONS}
    # With the goals in the cells, each step of a round is left with one join.
    for d, goal in goals.items():
        current = staged(current.join(wanted[d].withColumnRenamed("goal", goal), d, "left"))
    for _ in range(ROUNDS):
        errors = []
        for d, goal in goals.items():
            margin = current.groupBy(d).agg(F.sum(F.col("weight") * F.col("tokens")).alias("have"))
            current = current.join(margin, d, "left")
            factor = F.when(F.col(goal).isNotNull(), F.col(goal) / F.col("have"))
            current = current.withColumn("factor", F.coalesce(factor, F.lit(1.0)))
            errors.append(f"off_{d}")
            current = current.withColumn("weight", F.col("weight") * F.col("factor"))
            current = current.withColumn(errors[-1], F.abs(F.col("factor") - 1)).drop("factor", "have")
            # The margin reads the cells twice, so plans of several dimensions would double each time.
            current = staged(current)
        # One row: the largest change that a margin of this round still needed.
        worst = current.agg(F.max(F.greatest(*errors))).first()[0]
        current = current.drop(*errors)
        if worst is None or worst < TOLERANCE:
            break
    return current.drop(*goals.values()).withColumn("margin_error", F.lit(worst).cast("double"))


def mixed(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    share: float = 1.0,
    seed: int = 17,
    topic_of: Column | None = None,
) -> DataFrame:
    """The drawn rows of ``docs`` with ``topic, tokens, rate, copies`` (one or more) and
    ``margin_error`` as in ``rake``.

    ``share`` is the wanted number of tokens as a share of all.
    """
    docs = docs.drop(*ADDED)
    text = F.col("text")
    measured = docs.withColumns({"topic": topic(text) if topic_of is None else topic_of, "tokens": token_count(text)})
    weight = free_name(docs, "weight")
    key = {d: free_name(docs, f"{d}_label") for d in DIMENSIONS}
    table = cells(measured.select(_label("source").alias("source"), _label("lang").alias("lang"), "topic", "tokens"))
    weights = rake(table, default_targets(table) if targets is None else targets)
    weights = weights.select(*(F.col(d).alias(key[d]) for d in DIMENSIONS), F.col("weight").alias(weight), "margin_error")
    same = reduce(Column.__and__, (_label(d) == F.col(key[d]) for d in DIMENSIONS))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 53)) / float(1 << 53)
    rated = measured.join(weights, same).withColumn("rate", F.col(weight) * share)
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return rated.withColumn("copies", copies).where("copies > 0").select(*map(quoted, docs.columns), *ADDED)
