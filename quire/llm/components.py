"""Connected components by large-star and small-star steps (Kiveris et al., 2014), on DataFrames.

Each step gives a node's neighbours to the least of them; a hub with very many
neighbours costs a row each, never a pair each, and its minimum is aggregated
before it is shuffled.  The number of steps is about the logarithm of the longest
chain.  Every step is cut off through the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null).  Returns node, component (the least node that can be reached) for every node of an edge between two nodes."""
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: every larger neighbour of a node goes to the least of the node and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e1 = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours, and itself, go to the least of them
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        e2 = e1.join(low, "u")
        e = checkpoint(e2.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        # both steps keep components; nothing moves any more when the edges are as they were
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
