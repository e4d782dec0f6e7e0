"""Graph operators over edge tables (src, dst, weight): neighbourhoods, reachability, ranks, components and paths.

Iterations cut their lineage through ``checkpoint`` in the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.places import shared_folder
from ..sources.scratch import Rounds

#: Edges that a task sorts or groups at most, about.
TASK_ROWS = 500_000


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def neighbourhood(edges: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """The heaviest incoming edges of each given node."""
    w = Window.partitionBy("dst").orderBy(F.desc("weight"), "src")
    return edges.join(nodes, F.col("dst") == F.col("node"), "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("dst", "src", "weight", F.col("rank").cast("long").alias("rank"))


def hubs(edges: DataFrame, least: int) -> DataFrame:
    """Nodes with many edges, a row for either direction."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).withColumn("direction", F.lit("out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree")).withColumn("direction", F.lit("in"))
    return out.unionByName(into).where(F.col("degree") >= least)


def reachable(edges: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Everything that can be reached from each start (start, node, hops), by shortest number of hops; cycles end by themselves.
    Runs to the end unless ``max_hops`` says how far to go."""
    step = _cut(edges.select("src", "dst").distinct())
    seen = _cut(start.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("hops")).distinct())
    frontier, hop = seen, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        found = frontier.join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = _cut(found.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hop).cast("long")))
        if frontier.limit(1).count() == 0:
            break
        seen = _cut(seen.unionByName(frontier))
    return seen


def shortest_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Least total weight from each start by rounds of relaxation; weights are not negative."""
    step = _cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("w")))
    best = _cut(start.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("distance")))
    changed = best
    while True:
        moved = changed.join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"))
        after = best.unionByName(moved).groupBy("start", "node").agg(F.min("distance").alias("distance"))
        old = best.withColumnRenamed("distance", "old")
        after = _cut(after.join(old, ["start", "node"], "left"))
        changed = after.where("old is null or distance < old").drop("old")
        best = after.drop("old")
        if changed.limit(1).count() == 0:
            break
    return best


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """PageRank with uniform jumps; the rank of nodes without out-edges is spread over all."""
    with Rounds(edges.sparkSession, "ranks") as kept:
        links = kept.table(edges.select("src", "dst").distinct())
        out = links.groupBy("src").agg(F.count("*").alias("out"))
        # All that a round reads: every node with its edges out, and the links, written once in short rows.
        nodes = kept.table(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().join(out.withColumnRenamed("src", "node"), "node", "left"))
        n = nodes.count()
        ranks = kept.table(nodes.select("node", "out", F.lit(1.0 / max(1, n)).alias("rank")))
        for _ in range(rounds):
            sent = links.join(ranks.select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("part")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
            lost = ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            after = kept.table(nodes.join(sent, "node", "left").join(F.broadcast(lost)).select("node", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
            kept.forget(ranks)
            ranks = after
        kept.keep(ranks)
    return ranks.select("node", "rank")


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its least node), by least labels with pointer jumping."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a != b").distinct()
    both = _cut(both)
    labels = _cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").withColumn("low", F.least("component", "near"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("higher"))
        after = _cut(met.join(up, "low", "left").select("node", F.least("low", F.coalesce("higher", "low")).alias("next"), "component"))
        moved = after.where("next != component").limit(1).count()
        labels = after.select("node", F.col("next").alias("component"))
        if not moved:
            return labels


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation in step: every node takes the heaviest label around it, ties to the least label."""
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    with Rounds(edges.sparkSession, "labels") as kept:
        links = kept.table(edges.select("src", "dst", "weight"))
        # So many parts that a task's memory does not grow with the graph, whatever the session's number is.
        n = max(1, -(-2 * links.count() // TASK_ROWS))
        both = kept.table(links.select(F.explode(ways).alias("e"), "weight").select("e.*", "weight").where("a != b").repartition(n, "a", "b").groupBy("a", "b").agg(F.sum("weight").alias("weight")))
        kept.forget(links)
        labels = kept.table(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
        for _ in range(rounds):
            votes = both.repartition(n, "b").join(labels.select(F.col("node").alias("b"), "label").repartition(n, "b"), "b").repartition(n, "a").groupBy("a", "label").agg(F.sum("weight").alias("w"))
            after = kept.table(votes.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label")))
            kept.forget(labels)
            labels = after
        kept.keep(labels)
    return labels


def nearest(vectors: DataFrame, id_: str, vector: str, queries: DataFrame, k: int, least: float = -1.0, block: int = 4096) -> DataFrame:
    """The k most similar vectors of each query by cosine (to six places, ties by id), exactly.

    The stated query set goes over all vectors in blocks of bounded size; every task keeps the k best of a query, so that only
    those meet.  Vectors without length are similar to nothing (0).
    """
    spark = vectors.sparkSession
    numbered = queries.select(F.col(id_).alias("query"), F.col(vector).alias("q"))
    blocks = max(1, -(-numbered.count() // block))
    kind = vectors.schema[id_].dataType.simpleString()
    out = None
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        rows = part.toPandas()
        held = spark.sparkContext.broadcast((rows["query"].to_numpy(), _unit(rows["q"])))

        def best(frames, held=held):  # noqa: ANN001, ANN202
            names, unit = held.value
            top = None
            for frame in frames:
                for a in range(0, len(frame) if len(names) else 0, 1024):
                    part = frame.iloc[a : a + 1024]
                    sim = np.floor(_unit(part[vector]) @ unit.T * 1e6 + 0.5) / 1e6
                    bound = np.full(len(names), least)
                    if len(part) > k + 1:  # one more than k, as a query may meet itself; ties at the bound stay
                        bound = np.maximum(bound, np.partition(sim, -(k + 1), axis=0)[-(k + 1)])
                    of, at = np.nonzero(sim >= bound)
                    found = pd.DataFrame({"query": names[at], id_: part[id_].to_numpy()[of], "similarity": sim[of, at]})
                    found = found[found["query"] != found[id_]]
                    top = (found if top is None else pd.concat([top, found])).sort_values(["query", "similarity", id_], ascending=[True, False, True]).groupby("query").head(k)
            if top is not None:
                yield top

        met = vectors.select(id_, vector).mapInPandas(best, f"query {kind}, `{id_}` {kind}, similarity double")
        out = met if out is None else out.unionByName(met)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), id_)
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _unit(column) -> np.ndarray:  # noqa: ANN001
    if not len(column):
        return np.zeros((0, 1))
    m = np.array(column.tolist(), dtype=float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def subtree(pairs: DataFrame, parent: str, child: str) -> DataFrame:
    """Every (ancestor, descendant, depth) of a hierarchy."""
    roots = pairs.select(F.col(parent).alias("node")).distinct()
    found = reachable(pairs.select(F.col(parent).alias("src"), F.col(child).alias("dst")), roots)
    return found.where("hops > 0").select(F.col("start").alias("ancestor"), F.col("node").alias("descendant"), F.col("hops").alias("depth"))
