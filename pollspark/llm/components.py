"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node and a join, so a node with a third of all edges is combined before its
shuffle and its join partition can be split. Each round is written to the shared folder; rounds end when
the edges no longer change, without a limit on their number.

Results for unusual input: an edge with a null end, or from a node to itself, links nothing; repeated edges and edges
in either direction count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pollspark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of the edges (a, b) but the least of its component, with that least node."""
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == state or not seen["n"]:
            return current
        state = seen
        current = stored(_small_star(_large_star(current).distinct()).distinct(), "edges")
