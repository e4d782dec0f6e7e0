"""Composite scores: weighted blends of metrics that other operators give, as column expressions and table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, half_up, ratio

#: Weights of the blends (fixed values).
EFFICIENCY = {"direction": 0.30, "directed": 0.20, "iteration": 0.20, "leverage": 0.15, "depth": 0.15}
AUTONOMY = {"direction": 0.30, "independence": 0.25, "breadth": 0.20, "consistency": 0.25}
SURVIVAL = {"efficiency": 0.40, "stability": 0.35, "durability": 0.25}
REASONING = {"alternatives": 0.30, "trade_offs": 0.25, "recovery": 0.25, "crossing": 0.20}


def blend(weights: dict[str, float]) -> Column:
    """The weighted sum of columns by name; missing values count by what the others give."""
    total = sum(F.when(F.col(k).isNotNull(), F.col(k) * w).otherwise(0.0) for k, w in weights.items())
    present = sum(F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items())
    return F.when(present > 0, total / present)


def efficiency(events: DataFrame, by: list[str], planning: Column, debugging: Column, failed: Column, span: float = 100.0) -> DataFrame:
    """Efficiency 0 to 100 per key: five metrics, raised by planning, lowered by debugging and by failures.

    ``span``: turns at which the iteration metric reaches 0.
    """
    n = F.count("*")
    metrics = events.groupBy(*by).agg(
        n.alias("n"),
        (100 * F.avg("score")).alias("direction"),
        (100 * ratio(F.count_if(F.col("score") >= 0.5), F.count("score"), 0.5)).alias("directed"),
        (100 * clamp(1 - F.avg("turns") / span)).alias("iteration"),
        (100 * clamp(F.avg("value") / 100)).alias("leverage"),
        (100 * clamp(F.stddev_pop("score") * 2)).alias("depth"),
        (1 + 0.5 * ratio(F.count_if(planning), n) - 0.3 * ratio(F.count_if(debugging), n)).alias("phase"),
        (1 - 0.2 * ratio(F.count_if(failed), n)).alias("outcome"),
    )
    score = clamp(blend(EFFICIENCY) * F.col("phase") * F.col("outcome"), 0.0, 100.0)
    keep = [half_up(F.col(k), 4).alias(k) for k in EFFICIENCY]
    return metrics.select(*by, "n", *keep, half_up(score).cast("long").alias("efficiency"))


def maturity(metrics: DataFrame, by: list[str], dimensions: dict[str, tuple[float, float, float]]) -> DataFrame:
    """A level from 1 to 4 of weighted dimensions; each is (weight, low, high) and is normalised between its bounds."""
    from ..functions.numeric import normalise

    weights = sum(w for w, _, _ in dimensions.values())
    total = sum(normalise(F.coalesce(F.col(k), F.lit(low)), F.lit(low), F.lit(high)) * w for k, (w, low, high) in dimensions.items()) / weights
    level = F.when(F.col("composite") >= 0.7, 4).when(F.col("composite") >= 0.45, 3).when(F.col("composite") >= 0.2, 2).otherwise(1)
    return metrics.select(*by, half_up(total, 4).alias("composite")).withColumn("level", level.cast("long"))


def quadrant(x: Column, y: Column, middle: float) -> Column:
    return F.when((x >= middle) & (y >= middle), "thriving").when(x >= middle, "fast but fragile").when(y >= middle, "slow but solid").otherwise("at risk")


def impact(severity: Column, reach: Column, frequency: Column, recency: Column, confidence: Column) -> Column:
    """30/25/20/15/10 of five factors between 0 and 1, in percent."""
    return half_up(100 * (0.30 * clamp(severity) + 0.25 * clamp(reach) + 0.20 * clamp(frequency) + 0.15 * clamp(recency) + 0.10 * clamp(confidence)), 1)


def risk_bucket(score: Column) -> Column:
    return F.when(score >= 60, "low").when(score >= 35, "medium").otherwise("high")


def confidence_band(n: Column, many: int = 10, some: int = 5) -> Column:
    return F.when(n >= many, "high").when(n >= some, "medium").otherwise("low")


def merge_states(old: DataFrame, new: DataFrame, keys: list[str], strategies: dict[str, str], alpha: float = 0.3) -> DataFrame:
    """State rows of both sides by column: ``ewma`` (old and new at 1 - alpha and alpha), ``latest``, ``max``, ``sum`` or ``union``."""
    both = old.select(*keys, F.struct(*strategies).alias("o")).join(new.select(*keys, F.struct(*strategies).alias("n")), keys, "full_outer")

    def merged(name: str, how: str) -> Column:
        o, n = F.col(f"o.{name}"), F.col(f"n.{name}")
        out = {"ewma": (1 - alpha) * o + alpha * n, "latest": n, "max": F.greatest(o, n), "sum": o + n}.get(how)
        if how == "union":
            out = F.array_sort(F.array_union(o, n))
        return F.when(o.isNull(), n).when(n.isNull(), o).otherwise(out).alias(name)

    return both.select(*keys, *[merged(k, v) for k, v in strategies.items()])
