"""The corpus pipeline: STAGES turn the documents table into a training mix.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All
but the last return the columns of ``documents``. Stages survive null ids and texts, repeated
rows and empty tables as their operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import decontaminate, language_id, mixing, private_data, similarity_join
from batchloom.llm.common import staged, table
from batchloom.operators.ordering import free_name


#: Most that a text's n-grams may cost beyond the usual of its language, and least that its
#: words cost more under a wrong label, in log10 each.
MAX_STRANGE, MIN_AGAINST = 1.4, 1.5
#: Scores needed to overrule a label, and to name a language where there is none.
SURE, LIKELY = 0.99, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a language of the corpus, under that language.

    The model learns from documents that name their language and whose label it finds again. A label that the model
    surely contradicts is replaced by the language found; one that names none gets it, or goes
    if no language is likelier than all others together. Texts without a letter and those that
    look like none of the languages go, whatever their label.
    """
    verdict = free_name(docs, "verdict")
    found = docs.withColumn(verdict, language_id.judged(language_id.fit_agreed(docs)))
    of = F.col(verdict)
    wrong = (of["score"] >= SURE) & (of["against"] >= MIN_AGAINST)
    lang = F.when(F.col("lang").isNull() | wrong, of["lang_pred"]).otherwise(F.col("lang"))
    told = F.col("lang").isNotNull() | (of["score"] > LIKELY)
    known = (of["lang_pred"] != language_id.UNDETERMINED) & (of["strange"] <= MAX_STRANGE)
    return found.where(known & told).withColumn("lang", lang).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the least id.

    Rows that share an id stay or go together, equal ones once. A group without any id keeps
    one row of each of its texts.
    """
    groups = staged(similarity_join.cluster(docs))
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    least, rows = free_name(docs, "least"), free_name(docs, "rows")
    kept = kept.groupBy(F.col("doc_id").alias(least)).agg(F.count("*").alias(rows))
    own = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(least))).drop(least)
    once = own.where(F.col(rows) == 1).drop(rows)
    again = own.where(F.col(rows) > 1).drop(rows).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no benchmark item was found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, personal data replaced by its kind and ``n_chars`` counted anew."""
    return private_data.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that sources, languages and topics have their target weights."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mix),
]
#: Fitted models and 64-bit hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each writes what the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
