"""How many nodes each node of a directed graph can reach, for all nodes at once.

Up to ``bound`` nodes the reach is kept, as one row a node, and counted exactly.  Rounds double the length of the ways looked at,
so that their number is that of the bits of ``bound``: a node whose farthest node is more than ``bound`` hops away reaches more
than ``bound`` on the way.  In a round a node takes over the sets of the farthest nodes it knows, not of all; one without any
farthest node is done.  A node with more is large, and so is every node that reaches a large one; of those only a sketch
(HyperLogLog) is kept, of constant size, and sketches are merged along the edges, and along shortcuts whose length doubles with
every round, until no estimate grows.  So the tables grow with the nodes, never with the pairs.

Defined results: a node reaches itself only over a cycle; repeated edges count once; edges with a null end are none; nodes
without edges out reach nothing (0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Rounds

#: Largest reach that is exact.
BOUND = 64
#: A sketch has 2 to this many cells; its standard error is about 1.04 by the root of that.
CELLS = 12
#: Shortcuts of a node.
JUMPS = 4
#: Rows that a task joins or groups at most, about.
TASK_ROWS = 500_000


def reach(edges: DataFrame, bound: int = BOUND, cells: int = CELLS, estimate: bool = True) -> DataFrame:
    """node, reach and exact (whether it is counted or estimated) for every node of ``edges`` (src, dst).  Without ``estimate`` the
    reach of large nodes is null."""
    with Rounds(edges.sparkSession, "reach") as rounds:
        links = rounds.table(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
        # within: what ways of so many hops at most lead to; ends: those of them that no shorter way leads to.  Large nodes hold neither.
        first = links.groupBy("src").agg(F.count("*").alias("n"), F.collect_list("dst").alias("within"))
        sets = rounds.table(first.select("src", F.when(F.col("n") <= bound, F.col("within")).alias("within")).withColumn("ends", F.col("within")))
        n = max(1, -(-links.count() // TASK_ROWS))
        while True:
            longer = rounds.table(_doubled(sets, bound, n))
            done = longer.where(F.size("ends") > 0).isEmpty()
            rounds.forget(sets)
            sets = longer
            if done:
                break
        large = rounds.table(sets.where("within is null").select("src"))
        known = sets.select("src", F.explode("within").alias("dst"))
        nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
        small = nodes.join(large.select(F.col("src").alias("node")), "node", "left_anti")
        counted = small.join(sets.select(F.col("src").alias("node"), F.size("within").alias("n")), "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("reach"), F.lit(True).alias("exact"))
        found = rounds.table(counted)
        if not estimate:
            found = rounds.table(found.unionByName(large.select(F.col("src").alias("node"), F.lit(None).cast("long").alias("reach"), F.lit(False).alias("exact"))))
        elif not large.isEmpty():
            found = rounds.table(found.unionByName(_estimated(rounds, links, small, known, large, cells)))
        rounds.keep(found)
    return found


def _doubled(sets: DataFrame, bound: int, n: int) -> DataFrame:
    """The sets (src, within, ends) for ways twice as long: a node takes over those of its ends alone, as every longer way of least
    length leads through one of them.  ``n``: parts that rows are dealt to."""
    ended = sets.where(F.size("ends") == 0)
    going = sets.where(F.size("ends") > 0)
    ways = going.select("src", F.explode("ends").alias("by")).repartition(n, "by")
    of = sets.select(F.col("src").alias("by"), "within", "ends").repartition(n, "by")
    # Ends without edges out bring nothing; those that are large make large.
    met = ways.join(of, "by").select("src", F.col("within").isNull().alias("large"), F.array_except("within", "ends").alias("inner"), F.col("ends").alias("outer"))
    own = going.select("src", F.lit(False).alias("large"), F.col("within").alias("inner"), F.lit(None).cast(going.schema["ends"].dataType).alias("outer"))
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    both = own.unionByName(met).repartition(n, "src").groupBy("src").agg(F.max("large").alias("large"), flat("inner").alias("inner"), flat("outer").alias("outer"))
    further = both.withColumn("ends", F.array_except("outer", "inner")).withColumn("within", F.concat("inner", "ends"))
    kept = ~F.col("large") & (F.size("within") <= bound)
    return ended.unionByName(further.select("src", F.when(kept, F.col("within")).alias("within"), F.when(kept, F.col("ends")).alias("ends"))).unionByName(sets.where("within is null"))


def _estimated(rounds: Rounds, links: DataFrame, small: DataFrame, known: DataFrame, large: DataFrame, cells: int) -> DataFrame:
    """node, reach and exact of the large nodes, by sketches of a node with all that it reaches."""
    spark_type = small.schema["node"].dataType.simpleString()
    as_item = lambda c: F.xxhash64(c) if spark_type not in ("bigint", "int", "string") else F.col(c)
    own = small.select("node", F.col("node").alias("item")).unionByName(known.select(F.col("src").alias("node"), F.col("dst").alias("item")))
    from_large = rounds.table(links.join(large, "src", "left_semi"))
    # Small nodes are done: what a large node reaches by them is one sketch from the start.
    near = from_large.join(own.select(F.col("node").alias("dst"), "item"), "dst").select("src", "item").unionByName(from_large.select("src", F.col("dst").alias("item"))).unionByName(large.select("src", F.col("src").alias("item")))
    closed = rounds.table(near.groupBy("src").agg(F.hll_sketch_agg(as_item("item"), F.lit(cells)).alias("sketch")))
    inner = rounds.table(from_large.join(large.select(F.col("src").alias("dst")), "dst", "left_semi"))
    order = Window.partitionBy("src").orderBy(F.xxhash64("dst", "src"), "dst")
    jumps = rounds.table(inner.withColumn("n", F.row_number().over(order)).where(F.col("n") <= JUMPS).drop("n"))
    total = -1
    while True:
        ways = inner.unionByName(jumps).distinct()
        grown = ways.join(closed.select(F.col("src").alias("dst"), "sketch"), "dst").select("src", "sketch").unionByName(closed.select("src", "sketch"))
        after = rounds.table(grown.groupBy("src").agg(F.hll_union_agg("sketch").alias("sketch")))
        rounds.forget(closed)
        closed = after
        now = closed.agg(F.sum(F.hll_sketch_estimate("sketch"))).first()[0]
        if now == total:
            break
        total = now
        # Where some ways of so many hops end; they are of twice as many in the next round.
        met = jumps.join(jumps.select(F.col("src").alias("dst"), F.col("dst").alias("on")), "dst").select("src", F.col("on").alias("dst")).where("src != dst").distinct()
        further = rounds.table(met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= JUMPS).drop("n"))
        rounds.forget(jumps)
        jumps = further
    # A node's sketch holds itself, which only counts on a cycle: where it does is not kept, one node is within the error.
    return closed.select(F.col("src").alias("node"), (F.hll_sketch_estimate("sketch") - 1).alias("reach"), F.lit(False).alias("exact"))


def decision_quality(decisions: DataFrame, edges: DataFrame, bound: int = BOUND, estimate: bool = True) -> DataFrame:
    """decision, revision_count, ripple (exact up to ``bound``, else estimated or null), durability, effectiveness and composite.

    ``edges``: src, dst and type; what 'revises' a decision costs it durability, what follows from it makes it effective, up to
    ten nodes: so the scores are exact though large reaches are estimates.
    """
    revised = edges.where("type = 'revises'").groupBy(F.col("dst").alias("decision")).agg(F.count("*").alias("revision_count"))
    found = reach(edges, max(10, bound), estimate=estimate).select(F.col("node").alias("decision"), F.col("reach").alias("ripple"), "exact")
    met = decisions.join(revised, "decision", "left").join(found, "decision", "left")
    met = met.withColumns({"revision_count": F.coalesce("revision_count", F.lit(0)).cast("long"), "ripple": F.when(F.col("exact").isNull(), 0).otherwise(F.col("ripple")).cast("long"), "exact": F.coalesce("exact", F.lit(True))})
    met = met.withColumns({"durability": F.greatest(F.lit(0.0), 1 - F.col("revision_count") * 0.25), "effectiveness": F.when(F.col("exact"), F.least(F.lit(1.0), F.col("ripple") * 0.1)).otherwise(1.0)})
    composite = F.col("durability") * 0.4 + F.col("effectiveness") * 0.3 + (1 - F.least(F.lit(1.0), F.col("revision_count") * 0.2)) * 0.3
    return met.withColumn("composite", F.floor(composite * 1000 + 0.5) / 1000)
