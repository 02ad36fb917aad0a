"""Connected components of a table of links, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.llm.common import stored


def _low(edges: DataFrame) -> DataFrame:
    """(v, m): the smallest of each node and its neighbours."""
    return edges.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    ``links`` has columns a and b.  Large-star and small-star rounds: every node hands its
    neighbours above it, then those below it, the smallest node it knows.  Each round is one
    aggregate and one join, so a node with any number of links is never gathered.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stored(pairs, "links"), None
    while True:
        # large star: u's larger neighbours get u's minimum
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = _low(both)
        large = both.join(low, "v").filter(F.col("u") > F.col("v")).select("u", F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: u's smaller neighbours, and u itself, get the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small_low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
