"""Connected components of a graph held in a table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("_m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node near it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "_m").alias("_m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    tied = down.join(least, "a").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return tied.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that is not the least of its component, and that least node. edges: pairs a, b of longs
    without nulls; loops are ignored. No step gathers a node's neighbours: they are only aggregated and joined."""
    now = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct()
    while True:
        now = cut(_small_star(_large_star(now)))
        # Done when every node hangs on one other, on which nothing else is hung but nodes.
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count_if(F.col("up") == 0).alias("downs")).filter("ups > 1 OR (ups = 1 AND downs > 0)").isEmpty():
            return now
