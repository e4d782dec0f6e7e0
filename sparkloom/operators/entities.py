"""Entity resolution in passes: equal names, aliases (abbreviations, whole words, few edits), then neighbours by vectors.

No pass compares all names.  Names a few edits apart meet by deletion neighbourhoods: if two names are ``EDITS`` edits apart,
their first ``PREFIX`` characters have a string in common that each leaves when up to ``EDITS`` of its characters go.  So each
name has a bounded number of keys, whatever its length, names join by them, and the edit distance is only counted for those
that meet.  Vectors go through the stored index.  What is compared are distinct normalised names, so that a name with many
rows is one.

A name resolved in one pass takes no part in the next.  Ties: the least entity; in the last pass the most similar, then the least.

Defined results: null and empty names are new; names that are equal when normalised have one result; repeated aliases count
once; nothing known leaves every name new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import normal_name
from ..sources.scratch import Rounds
from . import vectorindex as V

EDITS = 2
PREFIX = 12
#: Names shorter than this have no typos, and at most this share of the longer name is edited.
LEAST_LENGTH = 4
EDITED = 0.3
#: Shortest name that counts as a whole word of another.
WORD = 3
NEIGHBOURS = 5
SIMILARITY = 0.85


def deletions(name: Column, edits: int = EDITS, prefix: int = PREFIX) -> Column:
    """All strings that the beginning of a name leaves when up to ``edits`` characters go."""
    found = F.array(F.substring(name, 1, prefix))
    for _ in range(edits):
        shorter = F.transform(found, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(prefix)))))
        found = F.array_distinct(F.concat(found, F.flatten(shorter)))
    return found


def few_edits(x: Column, y: Column) -> Column:
    longer = F.greatest(F.length(x), F.length(y))
    edits = F.levenshtein(x, y, EDITS)  # -1 beyond
    return (edits >= 0) & (longer >= LEAST_LENGTH) & (edits <= EDITED * longer)


def edit_pairs(names: DataFrame, known: DataFrame) -> DataFrame:
    """``key`` and ``alias`` of all pairs (names: key; known: alias; both distinct) that few edits separate."""
    a = names.where(F.length("key") > 0).select("key", F.explode(deletions(F.col("key"))).alias("left"))
    b = known.where(F.length("alias") > 0).select("alias", F.explode(deletions(F.col("alias"))).alias("left"))
    near = F.abs(F.length("key") - F.length("alias")) <= EDITS
    met = a.join(b, "left").where(near & (F.col("key") != F.col("alias"))).select("key", "alias").distinct()
    return met.where(few_edits(F.col("key"), F.col("alias")))


def word_pairs(names: DataFrame, known: DataFrame) -> DataFrame:
    """``key`` and ``alias`` of the pairs of which one is a whole word of the other."""
    whole = lambda c: (F.length(c) >= WORD) & ~F.col(c).contains(" ")
    words = lambda df, c: df.where(F.col(c).contains(" ")).select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("word"))
    inside = names.where(whole("key")).join(words(known, "alias"), F.col("key") == F.col("word"))
    around = words(names, "key").join(known.where(whole("alias")), F.col("alias") == F.col("word"))
    return inside.select("key", "alias").unionByName(around.select("key", "alias")).distinct()


def abbreviation_pairs(names: DataFrame, known: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """``key`` and ``alias`` of the pairs that stand for each other (abbreviations: short, long)."""
    both = abbreviations.select(normal_name(F.col("short")).alias("key"), normal_name(F.col("long")).alias("alias"))
    both = both.unionByName(both.select(F.col("alias").alias("key"), F.col("key").alias("alias"))).distinct()
    return both.join(names, "key", "left_semi").join(known.select("alias"), "alias", "left_semi")


def resolve(names: DataFrame, known: DataFrame, abbreviations: DataFrame | None = None) -> DataFrame:
    """name, entity (null if new) and how (exact, alias, embedding, new) of every distinct name.

    ``names``: name and, for the last pass, vector; ``known``: entity, alias and vector (of the entity); ``abbreviations``: short, long.
    """
    vectors = "vector" in names.columns and "vector" in known.columns
    kind = known.schema["entity"].dataType
    with Rounds(names.sparkSession, "entities") as rounds:
        keyed = rounds.table(names.select("name", F.coalesce(normal_name(F.col("name")), F.lit("")).alias("key"), *(["vector"] if vectors else [])).dropDuplicates(["name"]))
        aliases = rounds.table(known.select("entity", normal_name(F.col("alias")).alias("alias")).where("alias != ''").groupBy("alias").agg(F.min("entity").alias("entity")))
        keys = keyed.select("key").where("key != ''").distinct()
        exact = rounds.table(keys.join(aliases.withColumnRenamed("alias", "key"), "key").select("key", "entity", F.lit("exact").alias("how")))
        left = rounds.table(keys.join(exact, "key", "left_anti"))
        pairs = edit_pairs(left, aliases.select("alias")).unionByName(word_pairs(left, aliases.select("alias")))
        if abbreviations is not None:
            pairs = pairs.unionByName(abbreviation_pairs(left, aliases, abbreviations))
        by_alias = rounds.table(pairs.join(aliases, "alias").groupBy("key").agg(F.min("entity").alias("entity")).withColumn("how", F.lit("alias")))
        found = exact.unionByName(by_alias)
        if vectors:
            found = found.unionByName(_by_vector(rounds, keyed.join(left.join(by_alias, "key", "left_anti"), "key"), known))
        result = keyed.select("name", "key").join(found, "key", "left")
        out = rounds.keep(rounds.table(result.select("name", F.col("entity").cast(kind).alias("entity"), F.coalesce("how", F.lit("new")).alias("how"))))
    return out


def _by_vector(rounds: Rounds, asked: DataFrame, known: DataFrame) -> DataFrame:
    """key, entity and how of the names whose nearest entities are near enough; entities and keys have numbers in the index."""
    own = known.where("vector is not null").groupBy("entity").agg(F.any_value("vector").alias("vector"))
    entities = rounds.table(own.withColumn("number", F.monotonically_increasing_id()))
    keys = rounds.table(asked.where("vector is not null").groupBy("key").agg(F.min_by("vector", "name").alias("vector")).withColumn("number", -1 - F.monotonically_increasing_id()))
    model = V.fit(entities, "number", "vector")
    index = V.build(entities, "number", "vector", model, rounds.place("index"))
    near = V.exact_search(index, model, entities, keys, "number", "vector", NEIGHBOURS, rounds=rounds).where(F.col("similarity") > SIMILARITY)
    met = near.join(keys.select(F.col("number").alias("query"), "key"), "query").join(entities.select(F.col("number").alias("id"), "entity"), "id")
    return rounds.table(met.groupBy("key").agg(F.min_by("entity", F.struct(-F.col("similarity"), "entity")).alias("entity")).withColumn("how", F.lit("embedding")))
