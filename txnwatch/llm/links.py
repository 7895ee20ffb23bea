"""Connected components of a link table, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014. Each step is two
minimum aggregates and two joins on a node, so a node with very many links is pre-aggregated
before its shuffle and its join can be split by adaptive execution. Every round is a table in
the shared folder, so a lost executor never loses lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.tables import kept


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: bigint, unordered).

    The component is its smallest node. Links with a null end and loops are ignored; repeated
    links count once. An empty table gives an empty result. The number of rounds grows with the
    logarithm of the longest chain; more than ``max_rounds`` raises instead of giving a result
    that is not whole.
    """
    edges = (
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges, seen = kept(edges, "links"), None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = mark
        edges = kept(_small_star(_large_star(edges)), "links")
    raise RuntimeError(f"links have not settled after {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), "least")
    return moved.union(least).distinct().toDF("a", "b")
