"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Each round hangs all larger neighbours of a node on its least neighbour, then all smaller ones, so paths
    shrink to stars in a number of rounds that grows with the logarithm of their length. Rounds are written
    to the shared folder, which cuts the lineage; they end when the links stay as they are. A node with very many
    links is a key of a join and of an aggregation with partial sums, never of a window or a list.
    """
    state = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    state, before = written(state, "links"), None
    while (now := _mark(state)) != before:
        before = now
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m")
        )
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = large.join(low, large["a"] == low["n"]).where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
        small = moved.union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        state = written(small, "links")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _mark(links: DataFrame) -> tuple:
    """What tells two sets of links apart: their number, and sums over them."""
    row = links.agg(
        F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("a", "b")),
    ).first()
    return tuple(row)
