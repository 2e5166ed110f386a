"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from helixmill.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame | None:
    """node, component for each node of `edges` (a, b): component is the least node reachable; none without edges.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least
    node that it knows (Kiveris et al. 2014), until the edges are stars: about the logarithm
    of the longest path. A node with many edges is one row of the minimum that its edges are
    joined with, so hubs can be split. Edges from a node to itself and repeated edges are allowed.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    if now.isEmpty():
        discard(now)
        return None
    mark = None
    for _ in itertools.count():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        seen = Observation()
        small = small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        before, now = now, materialize(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
        discard(before)
        if seen.get == mark:
            break
        mark = seen.get
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
