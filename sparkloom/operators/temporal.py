"""Order and time: sessions, neighbours, as-of and interval joins, streaks and moving windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up


def sessionise(events: DataFrame, by: list[str], minutes: float, ts: str = "ts", tie: str = "id", out: str = "session_no") -> DataFrame:
    """Gap sessions per key: numbered from 1, a new one where more than ``minutes`` lie between neighbours."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    gap = F.unix_micros(ts) - F.lag(F.unix_micros(F.col(ts))).over(w)
    fresh = F.when(gap.isNull() | (gap > int(minutes * 60_000_000)), 1).otherwise(0)
    return events.withColumn("__new", fresh).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def successors(events: DataFrame, by: list[str], ts: str = "ts", tie: str = "id") -> DataFrame:
    """Consecutive pairs within a key, with the seconds between."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    nxt = F.lead(F.struct(F.col(tie).alias("id"), F.col(ts).alias("ts"))).over(w)
    pairs = events.select(*by, F.col(tie).alias("from_id"), F.col(ts).alias("__ts"), nxt.alias("__n")).where("__n is not null")
    return pairs.select(*by, "from_id", F.col("__n.id").alias("to_id"), ((F.unix_micros("__n.ts") - F.unix_micros("__ts")) / 1e6).alias("seconds"))


def next_within(left: DataFrame, right: DataFrame, by: list[str], seconds: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """As-of join forwards: for each left row the first right row of the same key strictly later, at most ``seconds`` on.

    Times are binned by the horizon, so that a left row meets its own bin and the next one only.
    """
    horizon = seconds * 1_000_000
    bin_of = lambda c: F.floor(F.unix_micros(c) / horizon)
    a = left.select(*by, F.col(tie).alias("from_id"), F.col(ts).alias("__a"), F.explode(F.array(bin_of(F.col(ts)), bin_of(F.col(ts)) + 1)).alias("__bin"))
    b = right.select(*by, F.col(tie).alias("__id"), F.col(ts).alias("__b"), bin_of(F.col(ts)).alias("__bin"))
    lag = F.unix_micros("__b") - F.unix_micros("__a")
    met = a.join(b, [*by, "__bin"]).where((lag > 0) & (lag <= horizon))
    return met.groupBy(*by, "from_id").agg(F.min_by(F.struct(F.col("__id").alias("to_id"), (lag / 1e6).alias("seconds")), F.struct("__b", "__id")).alias("x")).select(*by, "from_id", "x.*")


def interval_overlap_join(left: DataFrame, right: DataFrame, by: list[str], seconds: int, least: float = 0.1, ts: str = "ts", tie: str = "id", items: str = "files") -> DataFrame:
    """Pairs with 0 <= lag <= ``seconds`` that share items; strength = shared / smaller set * (1 - lag / horizon), to three places."""
    horizon = seconds * 1_000_000
    bin_of = lambda c: F.floor(F.unix_micros(c) / horizon)
    a = left.select(*by, F.col(tie).alias("from_id"), F.col(ts).alias("__a"), F.col(items).alias("__x"), F.explode(F.array(bin_of(F.col(ts)), bin_of(F.col(ts)) + 1)).alias("__bin"))
    b = right.select(*by, F.col(tie).alias("to_id"), F.col(ts).alias("__b"), F.col(items).alias("__y"), bin_of(F.col(ts)).alias("__bin"))
    lag = F.unix_micros("__b") - F.unix_micros("__a")
    met = a.join(b, [*by, "__bin"]).where((lag >= 0) & (lag <= horizon) & F.arrays_overlap("__x", "__y"))
    shared = F.size(F.array_intersect("__x", "__y"))
    strength = shared / F.least(F.size("__x"), F.size("__y")) * (1 - lag / horizon)
    return met.where(strength > least).select(*by, "from_id", "to_id", shared.cast("long").alias("n_shared"), half_up(strength, 3).alias("strength"))


def streaks(days: DataFrame, by: list[str], day: str, least: int = 1) -> DataFrame:
    """Runs of consecutive days per key: first, last and length."""
    w = Window.partitionBy(*by).orderBy(day)
    island = F.date_sub(F.col(day), F.row_number().over(w))
    runs = days.select(*by, day).distinct().withColumn("__island", island)
    return runs.groupBy(*by, "__island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_days")).where(F.col("n_days") >= least).drop("__island")


def moving_average(series: DataFrame, by: list[str], order: str, value: str, width: int) -> DataFrame:
    """Simple moving average over full windows only, to two places."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width - 1), 0)
    out = series.select(*by, order, F.avg(value).over(w).alias("__m"), F.count(value).over(w).alias("__n"))
    return out.where(F.col("__n") == width).select(*by, order, half_up(F.col("__m"), 2).alias("moving_average"))


def weighted_moving_average(series: DataFrame, by: list[str], order: str, value: str, weights: list[float]) -> DataFrame:
    """Weights go from the oldest to the newest value of each full window."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(len(weights) - 1), 0)
    out = series.select(*by, order, F.collect_list(value).over(w).alias("__v")).where(F.size("__v") == len(weights))
    total = F.aggregate(F.zip_with("__v", F.array(*[F.lit(float(x)) for x in weights]), lambda v, k: v * k), F.lit(0.0), lambda s, x: s + x)
    return out.select(*by, order, half_up(total / sum(weights), 2).alias("weighted_average"))


def against_days_back(series: DataFrame, by: list[str], day: str, value: str, back: int) -> DataFrame:
    """Each value with the one some days earlier, or the first of its series; the difference in percent."""
    w = Window.partitionBy(*by).orderBy(day)
    first = F.first(value).over(w)
    then = series.select(*by, F.date_add(day, back).alias(day), F.col(value).alias("__then"))
    out = series.withColumn("__first", first).join(then, [*by, day], "left").withColumn("earlier", F.coalesce("__then", "__first"))
    return out.select(*by, day, value, "earlier", F.when(F.col("earlier") != 0, half_up(100.0 * (F.col(value) - F.col("earlier")) / F.col("earlier"), 2)).alias("percent"))


def direction_of_last(events: DataFrame, by: list[str], value: str, last: int = 5, step: float = 0.05, share: float = 0.6, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Trend of the last values of a key: most steps up, most steps down, or neither."""
    back = Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(tie))
    recent = events.select(*by, ts, tie, value, F.row_number().over(back).alias("__r")).where(F.col("__r") <= last)
    delta = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(ts, tie))
    out = recent.withColumn("__d", delta).groupBy(*by).agg(F.count("__d").alias("n_steps"), F.count_if(F.col("__d") >= step).alias("ups"), F.count_if(F.col("__d") <= -step).alias("downs"))
    trend: Column = F.when((F.col("n_steps") > 0) & (F.col("ups") >= share * F.col("n_steps")), "rising").when((F.col("n_steps") > 0) & (F.col("downs") >= share * F.col("n_steps")), "falling").otherwise("steady")
    return out.withColumn("trend", trend)


def half_split(values: DataFrame, by: list[str], order: list[str], value: str, change: float = 0.3) -> DataFrame:
    """Means of both halves by position and sign changes of the steps: rising, falling, oscillating or flat."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by)
    placed = values.select(*by, *order, value, F.row_number().over(w).alias("__i"), F.count("*").over(whole).alias("__n"), F.signum(F.col(value) - F.lag(value).over(w)).alias("__s"))
    signed = placed.withColumn("__p", F.lag("__s").over(w))
    early = F.col("__i") <= F.floor(F.col("__n") / 2)
    out = signed.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.when(early, F.col(value))).alias("__a"), F.avg(F.when(~early, F.col(value))).alias("__b"), F.count_if(F.col("__s") * F.col("__p") < 0).alias("sign_changes")
    )
    rel = F.when(F.col("__a") != 0, (F.col("__b") - F.col("__a")) / F.abs("__a")).otherwise(0.0)
    shape = F.when(rel > change, "rising").when(rel < -change, "falling").when(F.col("sign_changes") >= 2, "oscillating").otherwise("flat")
    return out.where("n >= 2").select(*by, "n", "sign_changes", half_up(rel, 4).alias("change"), shape.alias("shape"))


def aligned(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Two daily series side by side on their shared days."""
    return a.join(b, on)


def greedy_clusters(events: DataFrame, by: list[str], minutes: float, least_overlap: float = 0.6, ts: str = "ts", tie: str = "id", items: str = "files", branch: str = "branch") -> DataFrame:
    """Order-dependent clusters per key: a row joins the open cluster if it follows its last member closely and shares its
    items or branch, else it opens a new one.  One key's rows are one group; split large keys by day first."""
    schema = events.select(*by, tie).schema.add("cluster", "long")
    key = list(by)

    def cluster(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values([ts, tie])
        number, last, seen, name, out = -1, None, set(), None, []
        for t, x, b in zip(pdf[ts], pdf[items], pdf[branch]):
            x = set(x) if x is not None else set()
            near = last is not None and (t - last).total_seconds() <= minutes * 60
            shared = len(x & seen) / min(len(x), len(seen)) if x and seen else 0.0
            if near and (shared >= least_overlap or (b is not None and b == name)):
                seen |= x
            else:
                number, seen, name = number + 1, x, b
            last = t
            out.append(number)
        return pdf[[*key, tie]].assign(cluster=out)

    return events.select(*by, tie, ts, items, branch).groupBy(*by).applyInPandas(cluster, schema)
