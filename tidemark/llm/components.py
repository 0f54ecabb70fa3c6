"""Connected components of a graph given by its edges, in rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's larger neighbours (large) or its smaller ones and itself (small) move to the least of them all."""
    both = edges.select("a", "b") if small else edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(least, "a")
    if small:
        moved = moved.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        moved = moved.filter("b > a").select(F.col("b").alias("x"), "m")
    return moved.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component), for every node of an edge between two different nodes.

    Rounds are written to the shared folder; they end when every node is joined to its root, after a number
    of rounds that grows with the logarithm of the longest chain.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    state, before = saved(ordered, "edges"), None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        state = saved(_star(_star(state, small=False), small=True), "edges")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
