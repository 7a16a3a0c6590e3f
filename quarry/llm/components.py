"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.scratch import release, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node's smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of edges (a long, b long); the component is its least node.

    Rows that are loops or null are ignored. The number of rounds grows with the
    logarithm of the longest path; each round's table is written, so lineage stays short, and
    what a round leaves in the driver is given back before the next.
    """
    edges = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges).distinct()).where("a != b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        release(edges.sparkSession)
    else:
        raise RuntimeError("the components did not settle")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
