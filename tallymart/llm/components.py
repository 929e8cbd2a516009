"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymart.session import stash


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) with a > b."""
    return rows.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _pairs(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _pairs(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b) but the roots; root is the smallest node.

    Each round is a handful of joins and aggregates over the links, and a component's
    links shrink to a star; a long chain takes logarithmically many rounds.
    """
    current, before = stash(_pairs(links), "links"), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        current = stash(_small_star(stash(_large_star(current), "links")), "links")
