"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epispark.llm.common import landed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("m").alias("a"), "b").where("a < b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b")
    return (moved.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(moved.select(F.col("m").alias("a"), "b"))
            .where("a < b").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                    F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """``(node, root)`` of every node that has an edge; the root is the least
    node of its component.

    ``edges`` has two columns ``a < b`` of one ordered type.  Each round is
    two joins on node keys, written to the shared folder; rounds grow with
    the logarithm of the component size.  Only a row count and two checksums
    reach the driver.  An empty table gives an empty table.
    """
    edges = landed(edges.select("a", "b").distinct(), name)
    state = _state(edges)
    while state[0]:
        edges = landed(_small_star(landed(_large_star(edges), name)), name)
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
