"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for each end of the links ``a, b``; comp is its least reachable node.

    Alternates two contractions until each component is a star around its least node: each node hands its larger neighbours
    to its least one, then its smaller ones. A chain of n links takes about log n rounds. A
    node with very many links is spread by the skew-join rules, since its least neighbour
    comes from a partial aggregate. No link gives no row; links to itself and repeated ones
    change nothing.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _flat(edges):
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.where("u = v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(
            small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        )
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops).distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether each node has one least node, which itself has none."""
    real = edges.where("u <> v")
    ends = real.select(F.col("u").alias("node"), "v").unionByName(
        real.select(F.col("v").alias("node"), F.lit(None).cast(edges.schema["v"].dataType).alias("v"))
    )
    by_node = ends.groupBy("node").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("tops")
    )
    return by_node.where("low <> high or (low is not null and tops > 0)").isEmpty()
