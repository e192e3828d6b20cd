"""Connected components of a graph by alternating stars, distributed and cut by tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) other than the least of each component; component is that least node.

    A round makes large stars (each node's greater neighbours go to its least neighbour) and small stars (its lesser ones do); it ends in a number of rounds about the logarithm of the longest path, when a round changes nothing. Neighbours are never gathered: a node's least one is an aggregate that is joined back.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = common.stored(edges.filter("a <> b").select(a.alias("u"), b.alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables, so that the shuffle of a hub's edges can be split
        least = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stored(large, "large-stars")
        least = common.stored(large.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
        ends = F.when(F.col("v") == F.col("m"), F.array("u")).otherwise(F.array("u", "v"))
        small = large.join(least, "u").select(F.explode(ends).alias("u"), F.col("m").alias("v")).distinct()
        now = common.stored(small, "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
