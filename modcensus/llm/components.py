"""Connected components by alternating star contraction; every round is landed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modcensus.llm.common import land


def _arcs(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.where("a != b").select(F.inline(ends))


def _settled(edges: DataFrame) -> bool:
    """Whether each component is a star about its least node: no node hangs on two, or on one that hangs itself."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs")))))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.count(F.lit(1)).alias("n"))
    return nodes.where("hangs > 1 OR (hangs = 1 AND n > 1)").isEmpty()


def _to_minimum(arcs: DataFrame, larger_only: bool) -> DataFrame:
    """Tie the neighbours of each ``a`` to the least of itself and them."""
    least = arcs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    tied = arcs.join(least, "a")
    if larger_only:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    both = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return both.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); the root is the component's least node.

    A node with very many neighbours is never gathered: its least neighbour is an aggregate, and the
    joins are plain ones that adaptive execution may split. ``edges`` are read several times: hand over a landed table.
    """
    current = edges
    while True:
        current = land(_to_minimum(_to_minimum(_arcs(current), True), False), "edges")
        if _settled(current):
            break
    roots = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
