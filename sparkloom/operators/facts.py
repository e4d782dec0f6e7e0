"""Bi-temporal facts: validity intervals, supersession, corrections and what was true when.

Open intervals end with null.  Facts are rows of (id, subject, predicate, object, valid_at, created_at).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def supersede(facts: DataFrame) -> DataFrame:
    """Closes each fact where the next of the same subject and predicate begins: adds invalid_at and superseded_by."""
    w = Window.partitionBy("subject", "predicate").orderBy("valid_at", "id")
    nxt = F.lead(F.struct("valid_at", "id")).over(w)
    return facts.withColumn("__n", nxt).select(*facts.columns, F.col("__n.valid_at").alias("invalid_at"), F.col("__n.id").alias("superseded_by"))


def valid_at(facts: DataFrame, when: DataFrame) -> DataFrame:
    """Facts that hold at a time (a single row ``as_of``)."""
    return facts.join(F.broadcast(when.limit(1))).where("valid_at <= as_of and (invalid_at is null or invalid_at > as_of)").drop("as_of")


def contradictions(facts: DataFrame) -> DataFrame:
    """Facts that an other object of the same subject and predicate replaced, and how long they held in days."""
    other = facts.select(F.col("id").alias("superseded_by"), F.col("object").alias("new_object"))
    met = facts.join(other, "superseded_by").where("object != new_object")
    return met.select("id", "superseded_by", "subject", "predicate", "object", "new_object", F.date_diff("invalid_at", "valid_at").cast("long").alias("held_days"))


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: rows of both, the newest of each key."""
    from .rollups import latest

    return latest(old.unionByName(new, allowMissingColumns=True), keys, order)


def lifecycle(mentions: DataFrame, entity: str, source: str) -> DataFrame:
    """Confidence from the number of sources (0.3 and 0.15 each, at most 1) and the stage that it gives."""
    out = mentions.groupBy(entity).agg(F.count("*").alias("n_mentions"), F.countDistinct(source).alias("n_sources"))
    confidence = F.least(F.lit(1.0), 0.3 + 0.15 * F.col("n_sources"))
    stage = F.when(F.col("confidence") >= 0.7, "confirmed").when(F.col("confidence") >= 0.5, "established").otherwise("emerging")
    return out.withColumn("confidence", F.round(confidence, 4)).withColumn("stage", stage)


def resolve(names: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """Entity resolution in passes: equal normalised names, then aliases by shared words and edit distance.

    ``names``: (name); ``known``: (entity, alias).  A name resolved in one pass takes no part in the next.
    """
    from ..functions.strings import alias_of, normal_name, tokens

    n = names.select("name", normal_name(F.col("name")).alias("key")).distinct()
    k = known.select("entity", "alias", normal_name(F.col("alias")).alias("key"))
    exact = n.join(k, "key").groupBy("name").agg(F.min("entity").alias("entity")).withColumn("how", F.lit("exact"))
    rest = n.join(exact, "name", "left_anti").select("name", F.explode(F.array_distinct(tokens(F.col("name"), 3))).alias("word"))
    words = k.select("entity", "alias", F.explode(F.array_distinct(tokens(F.col("alias"), 3))).alias("word"))
    near = rest.join(words, "word").where(alias_of(F.col("name"), F.col("alias"))).groupBy("name").agg(F.min("entity").alias("entity")).withColumn("how", F.lit("alias"))
    none = n.join(exact, "name", "left_anti").join(near, "name", "left_anti").select("name", F.lit(None).cast(known.schema["entity"].dataType).alias("entity"), F.lit("new").alias("how"))
    return exact.unionByName(near).unionByName(none)


def propagate(edges: DataFrame, facts: DataFrame, rules: list, depth: int = 2) -> DataFrame:
    """Forward chaining: every rule (edges, facts) -> new facts of (node, fact, depth); at most ``depth`` rounds or to the fixpoint."""
    known = facts.select("node", "fact", F.lit(0).cast("long").alias("depth"))
    for i in range(1, depth + 1):
        fresh = None
        for rule in rules:
            out = rule(edges, known).select("node", "fact")
            fresh = out if fresh is None else fresh.unionByName(out)
        if fresh is None:
            break
        added = fresh.distinct().join(known, ["node", "fact"], "left_anti").withColumn("depth", F.lit(i).cast("long"))
        known = known.unionByName(added)
    return known
