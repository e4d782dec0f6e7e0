"""Which events an insight rests on: filters by term, ordered fetches, lineage, fuzzy joins in time and the richest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S


def mentions(rows: DataFrame, terms: list[str], *texts: str) -> DataFrame:
    """A row per row and term that one of its texts has, case-sensitively; adds ``term``.  Terms are literals, so keep them to hundreds."""
    def has(term: Column) -> Column:
        found = F.lit(False)
        for text in texts:
            found = found | F.coalesce(F.col(text).contains(term), F.lit(False))
        return found

    return rows.withColumn("term", F.explode(F.filter(F.array(*map(F.lit, terms)), has)))


def newest(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The newest ``most`` rows of each key with their place, found without sorting a key in one task.

    Every task keeps its own newest; what a key's tasks kept is merged, so that a hot key costs ``most`` rows a task.
    """
    kept = [c for c in rows.columns if c not in by]
    first = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*kept).alias("row"))
    salted = rows.select(*by, F.pmod(F.xxhash64(*order), F.lit(64)).alias("__salt"), first.alias("x"))
    top = lambda c: F.slice(F.sort_array(F.collect_list(c), asc=False), 1, most)
    part = salted.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(F.desc("x")))).where(F.col("__k") <= most)
    merged = part.groupBy(*by).agg(top("x").alias("xs"))
    return merged.select(*by, F.posexplode("xs").alias("place", "x")).select(*by, (F.col("place") + 1).cast("long").alias("place"), "x.row.*")


def fetched(rows: DataFrame, key: str, ids: list[int], metric: Column) -> DataFrame:
    """The rows of a list of ids in its order: place, contribution (falling to half of the metric) and role."""
    n = len(ids)
    wanted = rows.sparkSession.createDataFrame([(i, p) for p, i in enumerate(ids)], f"{key} bigint, place bigint")
    met = rows.join(F.broadcast(wanted), key)
    role = F.when(F.col("place") == 0, "primary").when(F.col("place") < 3, "corroborating").otherwise("supporting")
    return met.select(key, "place", ((1 - 0.5 * F.col("place") / n) * metric).alias("contribution"), role.alias("role"))


def duration_days(text: Column, default: int = 7) -> Column:
    """Days of literals such as 3d, 2w or 1m (of thirty days); the default for anything else."""
    n = F.regexp_extract(text, r"^([0-9]{1,6})([dwm])$", 1)
    unit = F.regexp_extract(text, r"^([0-9]{1,6})([dwm])$", 2)
    return F.when(unit == "", default).otherwise(F.nullif(n, F.lit("")).cast("int") * F.when(unit == "w", 7).when(unit == "m", 30).otherwise(1))


def without_echoes(passive: DataFrame, active: DataFrame, key: list[str], ts: str, terms: str, seconds: int = 60, similarity: float = 0.5) -> DataFrame:
    """``passive`` without rows that an active row of the key, at most ``seconds`` away, says as well (Jaccard of ``terms``).

    Time is binned by the horizon, so a row meets its own and the two neighbouring bins, never all rows of its key.
    """
    micros = F.unix_micros(ts)
    binned = lambda df: df.withColumn("__bin", F.floor(micros / (seconds * 1_000_000)))
    a = binned(active).select(*key, F.col(ts).alias("__ts"), F.col(terms).alias("__terms"), F.explode(F.array(F.col("__bin") - 1, F.col("__bin"), F.col("__bin") + 1)).alias("__bin"))
    near = (F.abs(F.unix_micros(ts) - F.unix_micros("__ts")) <= seconds * 1_000_000) & (S.jaccard(F.col(terms), F.col("__terms")) >= similarity)
    p = binned(passive)
    on = [p[k] == a[k] for k in [*key, "__bin"]]
    return p.join(a, [*on, near], "left_anti").drop("__bin")


def richest(rows: DataFrame, key: list[str], *by: Column) -> DataFrame:
    """Of each key's rows the one that is largest by the given columns in turn."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*by)).alias("x")).select(*key, "x.*")
