"""Aggregations over event tables.  Every operator is a function of DataFrames; times are relative to an explicit ``as_of``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, ratio


def as_of(events: DataFrame, ts: str = "ts") -> DataFrame:
    """One row with the newest time, to be joined where a query needs a "now"."""
    return events.agg(F.max(ts).alias("as_of"))


def at(events: DataFrame, when: DataFrame) -> DataFrame:
    """Events with the ``as_of`` of a single row."""
    return events.join(F.broadcast(when.limit(1)))


def rolling_windows(events: DataFrame, when: DataFrame, hours: tuple[int, ...] = (1, 8, 24, 168)) -> DataFrame:
    """Per horizon before ``as_of``: events, the mean direction of AI events in percent, and the tool histogram, in one scan."""
    near = at(events, when).where((F.col("ts") > F.col("as_of") - F.make_dt_interval(hours=F.lit(max(hours)))) & (F.col("ts") <= F.col("as_of")))
    sized = near.select("*", F.explode(F.array(*[F.lit(h) for h in hours])).alias("window_hours"))
    inside = sized.where(F.unix_micros("ts") > F.unix_micros("as_of") - F.col("window_hours") * F.lit(3_600_000_000))
    ai = F.col("source") == "ai"
    counts = inside.groupBy("window_hours", "tool").agg(F.count("*").alias("n"), F.count_if(ai).alias("n_ai"), F.sum(F.when(ai, F.col("score"))).alias("s_ai"))
    return counts.groupBy("window_hours").agg(
        F.sum("n").alias("n_events"),
        half_up(100 * F.sum("s_ai") / F.sum("n_ai")).cast("long").alias("direction"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "tool", F.col("n").cast("string")))), ",").alias("tool_mix"),
    )


def session_rollup(events: DataFrame, session: str = "session", cost: str = "cost", label: str = "outcome") -> DataFrame:
    """Per session: span, events, most turns, last outcome, cost (missing counts 0) and the distinct phases in order."""
    return events.groupBy(session).agg(
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.count("*").alias("n_events"),
        F.max("turns").alias("max_turns"),
        F.max_by(label, F.struct("ts", "id")).alias("last_outcome"),
        F.sum(F.coalesce(cost, F.lit(0.0))).alias("cost"),
        F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"),
    )


def share_by(events: DataFrame, key: str) -> DataFrame:
    """Counts of a dimension's non-null values, with their part of all in whole percent."""
    counts = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.join(F.broadcast(whole)).select(key, "n", half_up(100 * F.col("n") / F.col("whole")).cast("long").alias("percent"))


def priced(events: DataFrame, prices: Mapping[str, float], default: float, keys: list[str]) -> DataFrame:
    """Daily spend by the first of ``keys`` that is not null: count, and count times price to two places."""
    model = F.coalesce(*[F.col(k) for k in keys], F.lit("unknown")).alias("model")
    counts = events.groupBy(F.to_date("ts").alias("day"), model).agg(F.count("*").alias("n"))
    price = F.coalesce(*[F.when(F.lower("model").contains(k) | F.lit(k).contains(F.lower("model")), F.lit(float(v))) for k, v in prices.items()], F.lit(default))
    return counts.withColumn("cost", half_up(F.col("n") * price, 2))


def rates(events: DataFrame, least: int = 5, waste: float = 0.2, directed: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Waste and direction ratios of scored events; waste is null for fewer than ``least``."""
    n = F.count("score")
    return events.groupBy(*(by or [])).agg(
        n.alias("n"),
        F.when(n >= least, half_up(F.count_if(F.col("score") < waste) / n, 4)).alias("waste_ratio"),
        half_up(ratio(F.count_if(F.col("score") >= directed), n, 0.5), 4).alias("directed_ratio"),
        half_up(ratio(n, F.count_if(F.col("score") >= directed)), 4).alias("cost_per_directed"),
        half_up(F.avg("score"), 4).alias("mean_score"),
    )


def repeated(events: DataFrame, key: str, failed: Column, least: int = 3, many: int = 5) -> DataFrame:
    """Values that come back: count, failures, and whether they look stuck (mostly failing, or very often)."""
    out = events.groupBy(key).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed")).where(F.col("n") >= least)
    return out.withColumn("stuck", (F.col("n_failed") > 0.5 * F.col("n")) | (F.col("n") >= many))


def trend_of_halves(series: DataFrame, by: list[str], order: str, value: str, change: float = 0.1) -> DataFrame:
    """First against second half of each ordered series: means, relative change and its direction."""
    cols = ", ".join(f"`{c}`" for c in by)
    placed = series.withColumn("__i", F.expr(f"row_number() over (partition by {cols} order by `{order}`)")).withColumn("__n", F.expr(f"count(*) over (partition by {cols})"))
    first = F.col("__i") <= F.floor(F.col("__n") / 2)
    out = placed.where("__n >= 2").groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(first, F.col(value))).alias("early"), F.avg(F.when(~first, F.col(value))).alias("late"))
    delta = ratio(F.col("late") - F.col("early"), F.abs("early"), 0.0)
    direction = F.when(delta > change, "up").when(delta < -change, "down").otherwise("stable")
    return out.select(*by, "n", half_up(F.col("early"), 4).alias("early"), half_up(F.col("late"), 4).alias("late"), half_up(delta, 4).alias("change"), direction.alias("trend"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of every key; rows whose key is null stay.

    An aggregate, not a window, so that a key with very many rows is combined before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    newest = rows.where(known).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")
    return newest.select(*rows.columns).unionByName(rows.where(~known))


def indexed_quantile(rows: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """The element at floor(n q) of the sorted values (counted from 0), as hot-spot thresholds take it.

    Only distinct values with their counts are ordered, never the rows themselves.
    """
    keys = ", ".join(f"`{k}`" for k in by or []) or "1"
    counts = rows.where(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(F.count("*").alias("__c"))
    whole = F.expr(f"sum(__c) over (partition by {keys})")
    upto = F.expr(f"sum(__c) over (partition by {keys} order by `{value}` rows between unbounded preceding and current row)")
    placed = counts.select("*", upto.alias("__to"), F.least(F.floor(whole * q), whole - 1).alias("__at"))
    return placed.where("__to > __at").groupBy(*(by or [])).agg(F.min(value).alias("quantile"))


def churn(touches: DataFrame, days: float, least: int = 3, q: float = 0.9) -> DataFrame:
    """Per file: touches, newest, rate a day, and whether it is hot: at least ``least`` and the q-th element of all counts."""
    counts = touches.groupBy("file").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.countDistinct("branch").alias("n_branches"))
    hot = indexed_quantile(counts, "n", q)
    return counts.join(F.broadcast(hot)).select(
        "file", "n", "last", "n_branches", half_up(F.col("n") / days, 4).alias("rate"), (F.col("n") >= F.greatest(F.lit(least), F.col("quantile"))).alias("hot")
    )


def calendar(series: DataFrame, day: str, value: str, days: int) -> DataFrame:
    """A row for each of the last days up to the newest, with 0 where there is none."""
    last = series.agg(F.max(day).alias("to"))
    grid = last.select(F.explode(F.sequence(F.date_sub("to", days - 1), F.col("to"))).alias(day))
    return grid.join(series, day, "left").select(day, F.coalesce(value, F.lit(0)).alias(value))


def insert_ignored(there: DataFrame, fresh: DataFrame, keys: list[str], first: str) -> DataFrame:
    """Rows as a set: of rows with the same keys, those that are there stay, and of fresh ones the least by ``first`` comes in."""
    one = lambda df: df.groupBy(*keys).agg(F.min(first).alias(first))
    old = one(there)
    return old.unionByName(one(fresh).join(old.select(*keys), keys, "left_anti"))


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two schemas in one table: columns that a side lacks are null; a column of both keeps the newer type."""
    for field in new.schema.fields:
        if field.name in old.columns:
            old = old.withColumn(field.name, F.col(field.name).cast(field.dataType))
    return old.unionByName(new, allowMissingColumns=True)


def dated_ids(rows: DataFrame, day: str, order: list[str]) -> DataFrame:
    """``id``: the day and the row's number in it."""
    place = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    return rows.withColumn("id", F.concat(F.col(day), F.lit("-"), place.cast("string")))


def rapid_groups(rows: DataFrame, by: list[str], ts: str, id_: str, seconds: int, least: int) -> DataFrame:
    """Runs of rows of a key with at most ``seconds`` between neighbours: their number, size and first id."""
    key = Window.partitionBy(*by).orderBy(ts, id_)
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(key))
    fresh = rows.withColumn("__fresh", F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0)).withColumn("grp", F.sum("__fresh").over(key))
    return fresh.groupBy(*by, "grp").agg(F.count("*").alias("n_fixes"), F.min(id_).alias("first")).where(F.col("n_fixes") >= least)
