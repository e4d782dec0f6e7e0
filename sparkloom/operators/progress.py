"""Efficiency of a day, histories of snapshots, and trends of daily series, each a DataFrame to a DataFrame.

Series are per key and day, so their windows hold a row a day; nothing here orders single events in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .scores import EFFICIENCY


def efficiency_day(events: DataFrame, as_of: DataFrame, assessed: DataFrame, by: list[str], hours: int = 24) -> DataFrame:
    """Whole percents of the five metrics over the last ``hours`` and their blend, raised by planning, lowered by debugging and
    by failures.  ``events`` has s4, tc, sec, phase and outcome; ``assessed`` the mean assessment of each key, 0 where missing."""
    n = F.count("*")
    whole = lambda x: N.half_up(x).cast("long")
    recent = events.join(F.broadcast(as_of)).where(F.col("ts") >= F.col("as_of") - F.expr(f"interval {hours} hours"))
    m = recent.groupBy(*by).agg(
        n.alias("n"), whole(100 * (F.sum("s4") / n / 1e4)).alias("direction"), whole(100 * (F.count_if(F.col("s4") >= 5000) / n)).alias("directed"),
        whole((1 - F.least(F.sum("tc") / F.count("tc"), F.lit(10)) / 10) * 100).alias("iteration"), whole(100 * (F.sum("sec") / F.count("sec") / 60.0)).alias("leverage"),
        (1 + F.count_if(F.col("phase") == "view") / n * 0.5 - F.count_if(F.col("phase") == "error") / n * 0.3).alias("phase"), (1 - F.count_if(F.col("outcome") == "failed") / n * 0.2).alias("adjusted"),
    )
    m = m.join(assessed, by, "left").withColumn("depth", whole(100 * F.coalesce("assessed", F.lit(0.0))))
    blended = sum(F.col(k) * w for k, w in EFFICIENCY.items())
    return m.select(*by, "n", *EFFICIENCY, whole(N.clamp(blended * F.col("phase") * F.col("adjusted"), 0.0, 100.0)).alias("efficiency"))


def latest_snapshots(snapshots: DataFrame, day: str, most: int) -> DataFrame:
    """The last ``most`` snapshots in ascending order, with their place i and their number n."""
    last = snapshots.orderBy(F.desc(day)).limit(most)
    every = Window.partitionBy(F.lit(0))  # at most ``most`` rows
    return last.select(F.row_number().over(every.orderBy(day)).cast("long").alias("i"), F.count("*").over(every).alias("n"), *snapshots.columns)


def week_over_week(history: DataFrame, value: str, band: float = 5.0) -> DataFrame:
    """n and trend: the mean of the last seven against that of up to seven before; null for fewer than seven and three."""
    recent, older = F.col("i") > F.col("n") - 7, (F.col("i") <= F.col("n") - 7) & (F.col("i") > F.col("n") - 14)
    x = history.agg(F.avg(F.when(recent, F.col(value))).alias("a"), F.avg(F.when(older, F.col(value))).alias("b"), F.count("*").alias("n"), F.count_if(older).alias("m"))
    change = F.col("a") - F.col("b")
    trend = F.when((F.col("n") < 7) | (F.col("m") < 3), None).when(change > band, "improving").when(change < -band, "declining").otherwise("stable")
    return x.select("n", trend.alias("trend"))


def _placed(series: DataFrame, by: list[str], day: str, last: int | None = None) -> DataFrame:
    """A series with x, the place of each day, of the last ``last`` days if given."""
    key = Window.partitionBy(*by)
    out = series.withColumn("x", F.row_number().over(key.orderBy(day)) - 1)
    return out if last is None else out.withColumn("__y", F.row_number().over(key.orderBy(F.desc(day)))).where(F.col("__y") <= last).drop("__y")


def reasoning_velocity(series: DataFrame, by: list[str], day: str, value: str, days: int = 30) -> DataFrame:
    z = _placed(series, by, day, days).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(value, "x").alias("m"), F.avg(value).alias("mean"))
    enough = F.col("n") >= 7
    percent = F.when(F.col("mean") == 0, 0).otherwise(N.half_up(F.col("m") * F.col("n") / F.col("mean") * 100).cast("long"))
    return z.select(*by, "n", F.when(enough, percent).alias("percent"), F.when(enough, N.half_up(F.col("m"), 3)).alias("slope"))


def slope_trend(series: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Direction of series of four days or more: the slope must exceed twice the deviation's standard error."""
    z = _placed(series, by, day).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(value, "x").alias("m"), F.stddev_pop(value).alias("s")).where("n >= 4")
    significant = (F.col("s") > 0) & (F.abs("m") / (F.col("s") / F.sqrt("n")) > 2)
    direction = F.when(significant, F.when(F.col("m") > 0, "accelerating").otherwise("decelerating")).otherwise("stable")
    return z.select(*by, "n", N.half_up(F.col("m"), 2).alias("magnitude"), direction.alias("direction"), F.when(F.col("n") >= 14, "high").when(F.col("n") >= 7, "medium").otherwise("low").alias("confidence"))


def mann_kendall(series: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """n, s, p and trend.  Pairs of days of one series are compared, so ``series`` must be daily."""
    a, b = (series.select(*by, F.col(day).alias(f"d{i}"), F.col(value).alias(f"v{i}")) for i in "ab")
    s = a.join(b, by).where("da < db").groupBy(*by).agg(F.sum(F.signum(F.col("vb") - F.col("va"))).alias("s"))
    z = series.groupBy(*by).agg(F.count("*").alias("n")).join(s, by, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    n = F.col("n")
    z = z.withColumn("z", (F.col("s") - F.signum("s")) / F.sqrt(F.nullif(n * (n - 1) * (2 * n + 5), F.lit(0)) / 18.0)).withColumn("p", 2 * (1 - N.normal_cdf_scaled(F.abs("z"))))
    tau = F.col("s") / F.nullif(n * (n - 1) / 2, F.lit(0.0))
    trend = F.when(n < 3, "stable").when((tau > 0.3) & (F.col("p") < 0.05), "improving").when((tau < -0.3) & (F.col("p") < 0.05), "declining").otherwise("stable")
    return z.select(*by, "n", F.col("s").cast("long").alias("s"), N.half_up(F.col("p"), 6).alias("p"), trend.alias("trend"))


def projected(series: DataFrame, by: list[str], x: str, y: str, target: float) -> DataFrame:
    """n and reached: where the least-squares line, shifted to the last point, reaches the target; null if it rises not or is past it."""
    z = series.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("m"), F.max(x).alias("last"), F.max_by(y, x).alias("now"))
    ahead = (F.col("n") >= 3) & (F.col("m") > 0) & (F.col("now") < target)
    return z.select(*by, "n", F.when(ahead, N.half_up(F.col("last") + (target - F.col("now")) / F.col("m"), 3)).alias("reached"))


def leaning_mean(rows: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """``mean`` per key after m := (m + 2 x) / 3 for each later row, in closed form: weights fall by a third a row."""
    key = Window.partitionBy(*by)
    placed = rows.select(*by, value.alias("__x"), F.row_number().over(key.orderBy(*order)).alias("i"), F.count("*").over(key).alias("n"))
    weight = F.when(F.col("i") == 1, F.pow(F.lit(1 / 3), F.col("n") - 1)).otherwise(2 / 3 * F.pow(F.lit(1 / 3), F.col("n") - F.col("i")))
    return placed.groupBy(*by).agg(F.sum(F.col("__x") * weight).alias("mean"))


def half_means(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Means of the earlier (a) and later (b) half of each key's rows."""
    key = Window.partitionBy(*by)
    placed = rows.select(*by, value, F.row_number().over(key.orderBy(*order)).alias("k"), F.floor(F.count("*").over(key) / 2).alias("m"))
    return placed.groupBy(*by).agg(F.avg(F.when(F.col("k") <= F.col("m"), F.col(value))).alias("a"), F.avg(F.when(F.col("k") > F.col("m"), F.col(value))).alias("b"))
