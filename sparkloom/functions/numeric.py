"""Column expressions for statistics, decay and scoring.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def half_up(x: Column, places: int = 0) -> Column:
    """Round half towards plus infinity, so that -2.5 becomes -2.

    Nine places are kept first: sums of doubles depend on their order in the last bits, and a tie must not.
    """
    factor = float(10**places)
    return F.floor(F.rint(x.cast("double") * 1e9) / 1e9 * factor + 0.5) / factor


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, or the default where b is 0 or null."""
    out = F.when(b != 0, a.cast("double") / b)
    return out if default is None else F.coalesce(out, F.lit(default))


def normalise(x: Column, low: Column, high: Column) -> Column:
    """Where x lies between two bounds, clamped; 0 where the bounds do not span anything."""
    return F.when(high > low, clamp((x - low) / (high - low))).otherwise(0.0)


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (x - mean) / sd).otherwise(0.0)


def normal_cdf(z: Column) -> Column:
    """The normal distribution by the five-term rational approximation of erf (Abramowitz and Stegun 7.1.26; fixed values)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z < 0, (1.0 - erf) / 2).otherwise((1.0 + erf) / 2)


def normal_cdf_scaled(z: Column) -> Column:
    """A second form with the same coefficients, applied to z itself with exp(-z ** 2 / 2); its values differ from ``normal_cdf``."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    y = 1.0 - poly * F.exp(-x * x / 2)
    return F.when(z < -8, 0.0).when(z > 8, 1.0).when(z < 0, 0.5 * (1.0 - y)).otherwise(0.5 * (1.0 + y))


def retrievability(days: Column, stability: Column, modifier: Num = 1.0) -> Column:
    """The power forgetting curve: (1 + d / (9 S m)) ** -1, and 1 where time or stability is not positive."""
    scale = 9.0 * stability * _c(modifier)
    return F.when((days > 0) & (scale > 0), 1.0 / (1.0 + days / scale)).otherwise(1.0)


def stability_growth(stability: Column, quality: Column) -> Column:
    """Stability after an interaction of quality 1 to 5, at most a year."""
    return F.least(F.lit(365.0), stability * (1.0 + 0.4 * F.log2(clamp(quality, 1.0, 5.0) + 1.0)))


def decayed(base: Column, days: Column, stability: Column, floor: Num = 0.0, modifier: Num = 1.0) -> Column:
    return F.greatest(base * retrievability(days, stability, modifier), _c(floor))


def recency_weight(days: Column) -> Column:
    return F.when(days <= 7, 1.0).when(days <= 30, 0.7).when(days <= 90, 0.3).otherwise(0.1)


def half_life(age_days: Column, days: float = 14.0) -> Column:
    """The share that exponential decay leaves."""
    return F.exp(-F.log(F.lit(2.0)) * age_days / days)


def weekly_confidence(confidence: Column, age_days: Column, grace: float = 14.0, keep: float = 0.7, least: float = 0.3) -> Column:
    """Confidence that keeps a share a week after a grace period; null when it falls below the least."""
    left = F.when(age_days <= grace, confidence).otherwise(confidence * F.pow(F.lit(keep), (age_days - grace) / 7.0))
    return F.when(left >= least, left)


def shrink(x: Column, n: Column, prior: Num, k: float = 10.0) -> Column:
    """Bayesian shrinkage of a mean of n values towards a prior worth k values."""
    return (n * x + k * _c(prior)) / (n + k)


def effect_band(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size >= 0.8, "large").when(size >= 0.5, "medium").when(size >= 0.2, "small").otherwise("negligible")


def cohens_d(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """Difference of two means by the pooled sample deviation; 0 for groups of fewer than two or without spread."""
    pooled = F.sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / F.nullif(n_a + n_b - 2, F.lit(0)))
    return F.when((n_a >= 2) & (n_b >= 2) & (pooled > 0), (mean_a - mean_b) / pooled).otherwise(0.0)


def pearson(x: str, y: str, least: int = 3) -> Column:
    """An aggregate: the correlation, or 0 for fewer rows than ``least`` and for series without spread."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sx, sy = F.stddev_pop(F.when(both, F.col(x))), F.stddev_pop(F.when(both, F.col(y)))
    return F.when((F.count_if(both) >= least) & (sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy)).otherwise(0.0)


def variance(x: str) -> Column:
    """An aggregate: the sample variance, 0 for fewer than two values."""
    return F.when(F.count(x) >= 2, F.var_samp(x)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of the same length; 0 where either has no length."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), zero, lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def chunk_means(v: Column, size: int) -> Column:
    """A shorter vector: the means of chunks of a longer one."""
    n = F.ceil(F.size(v) / size).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(v, i * size + 1, F.lit(size)), F.lit(0.0), lambda s, x: s + x) / F.size(F.slice(v, i * size + 1, F.lit(size)))
    )


def exponential_smoothing(values: Column, alpha: float = 0.3) -> Column:
    """Smoothed values of an ordered array, seeded with the first."""
    start = F.expr("cast(array() as array<double>)")
    step = lambda out, x: F.concat(out, F.array(F.when(F.size(out) == 0, x).otherwise(alpha * x + (1 - alpha) * F.element_at(out, -1))))
    return F.aggregate(values, start, step)


def odds_update(prior: Num, ratios: Column) -> Column:
    """Confidence after a sequence of likelihood ratios, kept between 0.05 and 0.99 at each step."""
    step = lambda p, r: clamp(p / (1 - p) * r / (1 + p / (1 - p) * r), 0.05, 0.99)
    return F.aggregate(ratios, clamp(_c(prior), 0.05, 0.99), step)
