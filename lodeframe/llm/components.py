"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over rows (u, v) with u > v.

    Large star: each node hangs its larger neighbours under the least node of
    its neighbourhood.  Small star: it hangs its smaller neighbours and itself
    under the least one.  The minimum is combined before the shuffle, written and
    joined back: no neighbourhood is gathered in one place, and both sides of the
    join are plain shuffles, so Spark can split a node with many neighbours.
    """
    if larger:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs to (node, component): the least node reachable.

    Nodes without an edge do not appear.  Each round is written to the shared
    folder; rounds grow with the logarithm of the longest chain.  The steps end
    when every node hangs directly under its least node: no ``u`` has two
    parents and no parent hangs under another.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, "edges")
    while True:
        now = materialise(_star(materialise(_star(now, True), "edges"), False), "edges")
        parents = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        split = parents.where("n > 1").limit(1)
        chained = now.join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
        if not split.select(F.lit(1)).union(chained.select(F.lit(1))).take(1):
            break
    heads = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
