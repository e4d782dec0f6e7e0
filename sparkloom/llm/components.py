"""Connected components by alternating large and small stars, for graphs that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import scratch, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours to the least node around it.  Means are joined, never gathered, so hubs may be of any size."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if not small:  # hubs have all their neighbours here; two plain shuffles can be split
        least = written(least, "least")
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), "m").union(least.select(F.col("u").alias("a"), "m"))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), "m")
    return out.where("a != m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node that has a link.

    Nulls and self-links are ignored, repeated links count once, and an empty graph has no rows.
    """
    with scratch(edges.sparkSession) as kept:
        edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
        while True:
            large = _star(edges, small=False)
            edges = written(_star(large, small=True), "edges")
            # Links lead to smaller nodes; once every node either leads to one other or is led to, that one is its least.
            leads, led = edges.groupBy("u").agg(F.count("*").alias("n")), edges.select(F.col("v").alias("u"), F.lit(1).cast("long").alias("n"))
            if not leads.unionByName(led.distinct()).groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").limit(1).count():
                break
        roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
        out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
        kept.append(out)
    return out
