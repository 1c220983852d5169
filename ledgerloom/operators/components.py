"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import Work


def connected(edges: DataFrame, work: Work) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that isn't itself its component's least node.

    Rounds of two kinds of stars: every node hands its larger neighbours to the least of its neighbourhood, then its
    smaller ones. Both are joins with an aggregate, so no node's neighbours are gathered. The number of rounds grows with
    the logarithm of the longest path; a round's edges are written, and it ends when they no longer change."""
    now = work.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        before, now = now, work.table(small.distinct())
        work.drop(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
