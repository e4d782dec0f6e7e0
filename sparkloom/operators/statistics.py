"""Statistics of tables and series, with defined results for short and constant input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, normal_cdf, pearson, shrink


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, median, sample deviation, quantiles, adjusted skewness and coefficient of variation, to four places."""
    n, mean, var = F.count(value), F.avg(value), F.var_samp(value)
    grouped = rows.groupBy(*(by or [])).agg(
        n.alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), mean.alias("mean"), F.when(n >= 2, var).otherwise(0.0).alias("v"),
        F.percentile(value, F.lit(0.25)).alias("p25"), F.median(value).alias("median"), F.percentile(value, F.lit(0.75)).alias("p75"), F.percentile(value, F.lit(0.95)).alias("p95"),
        F.when((n >= 3) & (F.stddev_pop(value) > 0), F.skewness(value)).alias("g"),
    )
    sd = F.sqrt("v")
    adjusted = F.coalesce(F.col("g") * F.sqrt(F.col("n") * (F.col("n") - 1.0)) / (F.col("n") - 2.0), F.lit(0.0))
    cv = F.when(F.col("mean") != 0, sd / F.abs("mean")).otherwise(0.0)
    four = lambda c, name: half_up(c, 4).alias(name)
    return grouped.select(*(by or []), "n", *[four(F.col(c), c) for c in ("least", "most", "mean", "p25", "median", "p75", "p95")], four(sd, "sd"), four(F.col("p75") - F.col("p25"), "iqr"), four(adjusted, "skewness"), four(cv, "cv"))


def regression(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least squares of y on x: slope, intercept and R squared; 0, the mean and 0 where x has no spread."""
    sx, sy = F.var_pop(x), F.var_pop(y)
    slope = F.when(sx > 0, F.covar_pop(y, x) / sx).otherwise(0.0)
    r2 = F.when((sx > 0) & (sy > 0), F.pow(F.covar_pop(y, x), 2) / (sx * sy)).otherwise(0.0)
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), half_up(slope, 6).alias("slope"), half_up(F.avg(y) - slope * F.avg(x), 4).alias("intercept"), half_up(r2, 4).alias("r2"))


def correlation_pairs(series: DataFrame, name: str, on: str, value: str, least: int = 7, strong: float = 0.0) -> DataFrame:
    """All pairs of series that share enough positions, with their correlation and a confidence of min(1, n / 20)."""
    a = series.select(F.col(name).alias("a"), on, F.col(value).alias("x"))
    b = series.select(F.col(name).alias("b"), on, F.col(value).alias("y"))
    out = a.join(b, on).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), pearson("x", "y", least).alias("r")).where(F.col("n") >= least)
    return out.where(F.abs("r") >= strong).select("a", "b", "n", half_up(F.col("r"), 4).alias("r"), half_up(F.least(F.lit(1.0), F.col("n") / 20), 4).alias("confidence"))


def spearman(rows: DataFrame, x: str, y: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of ordinal ranks; equal values take their ranks in the order of ``tie``."""
    keys = by or []
    ranked = rows
    for c, r in ((x, "__rx"), (y, "__ry")):
        ranked = ranked.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(c, tie)).cast("double"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), half_up(pearson("__rx", "__ry"), 4).alias("rho"))


def outliers(rows: DataFrame, value: str, by: list[str], z: float = 2.5, k: float = 1.5) -> DataFrame:
    """Rows beyond z sample deviations or k interquartile ranges, and by which measure."""
    stats = rows.groupBy(*by).agg(F.avg(value).alias("__m"), F.when(F.count(value) >= 2, F.stddev_samp(value)).otherwise(0.0).alias("__s"), F.percentile(value, F.lit(0.25)).alias("__q1"), F.percentile(value, F.lit(0.75)).alias("__q3"))
    far_z = (F.col("__s") > 0) & (F.abs(F.col(value) - F.col("__m")) > z * F.col("__s"))
    spread = k * (F.col("__q3") - F.col("__q1"))
    far_q = (F.col(value) < F.col("__q1") - spread) | (F.col(value) > F.col("__q3") + spread)
    return rows.join(stats, by).select(*rows.columns, far_z.alias("by_z"), far_q.alias("by_iqr")).where("by_z or by_iqr")


def mann_kendall(series: DataFrame, by: list[str], order: str, value: str, least: int = 4) -> DataFrame:
    """Trend test: S, tie-corrected variance, continuity-corrected z, two-sided p and tau = S / pairs."""
    a = series.select(*by, F.col(order).alias("__i"), F.col(value).alias("__x"))
    b = series.select(*by, F.col(order).alias("__j"), F.col(value).alias("__y"))
    pairs = a.join(b, by).where("__i < __j").groupBy(*by).agg(F.sum(F.signum(F.col("__y") - F.col("__x"))).alias("s"), F.count("*").alias("pairs"), F.median((F.col("__y") - F.col("__x")) / (F.col("__j") - F.col("__i"))).alias("sen"))
    ties = series.groupBy(*by, value).agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("tied"))
    both = pairs.join(ties, by).where(F.col("n") >= least)
    var = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("tied")) / 18.0
    z = F.when(var <= 0, 0.0).when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt(var)).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt(var)).otherwise(0.0)
    out = both.withColumn("__z", z).withColumn("__p", 2 * (1 - normal_cdf(F.abs("__z"))))
    trend = F.when((F.col("__p") < 0.05) & (F.col("s") > 0), "up").when((F.col("__p") < 0.05) & (F.col("s") < 0), "down").otherwise("none")
    return out.select(*by, "n", F.col("s").cast("long").alias("s"), half_up(F.col("s") / F.col("pairs"), 4).alias("tau"), half_up(F.col("__z"), 4).alias("z"), half_up(F.col("__p"), 4).alias("p"), half_up(F.col("sen"), 4).alias("sen_slope"), trend.alias("trend"))


def shrunk_means(rows: DataFrame, by: list[str], value: str, k: float = 10.0) -> DataFrame:
    """Group means drawn towards the weighted mean of all groups."""
    means = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    prior = means.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("prior"))
    return means.join(F.broadcast(prior)).select(*by, "n", half_up(F.col("mean"), 4).alias("mean"), half_up(shrink(F.col("mean"), F.col("n"), F.coalesce("prior", F.lit(0.5)), k), 4).alias("shrunk"))


def lag_correlation(series: DataFrame, on: str, x: str, y: str, gain: float = 0.1) -> DataFrame:
    """Correlation of two aligned daily series now and a day later, and whether y follows x."""
    later = series.select(F.date_sub(on, 1).alias(on), F.col(y).alias("__n"))
    out = series.select(on, F.col(x).alias("__x"), F.col(y).alias("__y")).join(later, on, "left").agg(F.count("*").alias("n"), pearson("__x", "__y", 7).alias("r0"), pearson("__x", "__n", 7).alias("r1"))
    return out.select("n", half_up(F.col("r0"), 4).alias("r0"), half_up(F.col("r1"), 4).alias("r1"), (F.abs("r1") > F.abs("r0") + gain).alias("follows"))


def contrast(rows: DataFrame, by: list[str], flag: str, value: str, least: int = 3) -> DataFrame:
    """Means with and without a trait, their ratio and effect size, for groups with enough of both."""
    from ..functions.numeric import cohens_d, effect_band

    on, off = F.col(flag), ~F.col(flag)
    sides = rows.groupBy(*by).agg(
        F.count_if(on).alias("n_with"), F.count_if(off).alias("n_without"), F.avg(F.when(on, F.col(value))).alias("mean_with"), F.avg(F.when(off, F.col(value))).alias("mean_without"),
        F.var_samp(F.when(on, F.col(value))).alias("v1"), F.var_samp(F.when(off, F.col(value))).alias("v0"),
    ).where((F.col("n_with") >= least) & (F.col("n_without") >= least))
    d = cohens_d(F.col("mean_with"), F.col("v1"), F.col("n_with"), F.col("mean_without"), F.col("v0"), F.col("n_without"))
    ratio = F.when(F.col("mean_without") > 0, F.col("mean_with") / F.col("mean_without"))
    return sides.select(*by, "n_with", "n_without", half_up(ratio, 4).alias("ratio"), half_up(d, 4).alias("effect"), effect_band(half_up(d, 4)).alias("band"))
