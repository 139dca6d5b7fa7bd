"""Connected components of a graph of 64-bit nodes by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge table: two numbers."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node of its component.

    Large stars link a node's greater neighbours, small stars its smaller ones,
    to the smallest node at hand, until nothing changes; edges never grow in
    number.  A node's smallest neighbour comes from a grouped minimum and a
    join, not from a gathered neighbourhood, so a hub with many neighbours is
    no larger task than others.  Each round is written to the checkpoint
    folder, so a lost executor costs one round at most.
    """
    here = cut_lineage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(here)) != before:
        before = now
        both = here.union(here.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that the join stands alone in its stage and a hub's partition can be split
        least = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .where(F.col("a") != F.col("b")).distinct()
        # every large-star edge leads from a node to a smaller one
        large = cut_lineage(large)
        lowest = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lowest.select("a", F.col("m").alias("b")))
        here = cut_lineage(small.where(F.col("a") != F.col("b")).distinct())
    return here.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        here.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
