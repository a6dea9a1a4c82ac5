"""Connected components of a link table by alternating stars, each round written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import materialize


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the least of the node's neighbourhood."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung below the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    # a sum of 32-bit hashes, so that it cannot overflow
    return tuple(links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not a root; a root is its least node.

    Minima are combined before each shuffle; joins on a hub are split by skew-join planning.
    The number of rounds grows with the logarithm of the longest chain.
    """
    oriented = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = materialize(oriented, "links")
    state = _state(stars)
    while True:
        # the large star takes pairs (larger, smaller) and gives such pairs, as the small star does
        stars = materialize(_small(_large(stars)), "stars")
        before, state = state, _state(stars)
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
