"""States and domains in time, and inference over them, each a DataFrame to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rules as RU
from .scores import confidence_band


def radar(events: DataFrame, domain: str) -> DataFrame:
    """score (0 to 100), n and confidence of each domain."""
    g = events.groupBy(domain).agg(N.half_up(N.clamp(10 * (F.sum("s4") / F.count("*") / 1000), 0.0, 100.0)).cast("long").alias("score"), F.count("*").alias("n"))
    return g.withColumn("confidence", confidence_band(F.col("n")))


def tracked_domains(decisions: DataFrame) -> DataFrame:
    """Domains that have new decisions, merged with what was known: frequency, share of the new ones, last_seen, depth and trend.

    ``decisions``: domain, day, alternatives and old (known before).
    """
    old = F.col("old")
    side = lambda c, x: (F.count_if(x).alias("f" + c), F.avg(F.when(x, F.col("alternatives"))).alias("a" + c), F.max(F.when(x, F.col("day"))).alias("d" + c))
    g = decisions.groupBy("domain").agg(*side("o", old), *side("n", ~old))
    g = g.join(F.broadcast(g.agg(F.sum("fn").alias("all")))).where("fn > 0").withColumn("frequency", F.col("fo") + F.col("fn"))
    level, before = RU.depth_level(F.col("frequency"), F.coalesce("an", F.lit(0.0))), RU.depth_level(F.col("fo"), F.col("ao"))
    trend = F.when(F.col("fo") == 0, "stable").when(level > before, "deepening").when((F.col("frequency") / F.nullif("fo", F.lit(0)) > 1.5) & (level >= before), "broadening").otherwise("stable")
    depth = F.when(level == 0, "shallow").when(level == 1, "moderate").otherwise("deep")
    return g.select("domain", "frequency", N.half_up(F.col("fn") / F.col("all"), 4).alias("share"), F.greatest("do", "dn").alias("last_seen"), depth.alias("depth"), trend.alias("trend"))


def session_risk(events: DataFrame, session: str, order: list[str], score: str, phase: str, window: int = 5) -> DataFrame:
    """n and risk of each session, from its length, how its direction moves over the last ``window`` events, and changes of phase."""
    key = Window.partitionBy(session)
    ahead, back = key.orderBy(*order), key.orderBy(*[F.desc(c) for c in order])
    o = events.select(session, score, phase, F.row_number().over(back).alias("k"), F.count("*").over(key).alias("n"), F.lag(score).over(ahead).alias("p"), F.lag(phase).over(ahead).alias("pp"))
    last = F.least(F.col("n"), F.lit(window))
    g = o.groupBy(session).agg(
        F.max("n").alias("n"), F.avg(F.when(F.col("k") <= window, F.col(score))).alias("recent"), F.count_if((F.col("k") <= last - 1) & (F.col(score) < F.col("p") - 0.05)).alias("falls"), F.count_if(F.col("pp").isNotNull() & (F.col("pp") != F.col(phase))).alias("changes")
    )
    falling = (F.col("n") >= 3) & (F.col("falls") >= F.least(F.col("n"), F.lit(window)) * 0.6)
    return g.select(session, "n", N.half_up(RU.loop_risk(F.col("n"), falling, F.col("recent"), F.col("changes")), 2).alias("risk"))


def trajectory(entities: DataFrame, key: str) -> DataFrame:
    """day and level: 0.1 when an entity was first seen (a), 0.6 of its level half way where that is a day of its own, and ``now`` at b."""
    first, last = F.to_date("a"), F.to_date("b")
    middle = F.to_date(F.timestamp_micros(F.floor((F.unix_micros("a") + F.unix_micros("b")) / F.lit(2)).cast("long")))
    point = lambda day, level, given: F.struct(day.alias("day"), level.alias("level"), given.alias("given"))
    points = F.array(point(first, F.lit(0.1), F.lit(True)), point(middle, N.half_up(F.col("now") * 0.6, 4), (first != last) & (middle != first) & (middle != last)), point(last, N.half_up(F.col("now"), 4), F.lit(True)))
    return entities.select(key, F.explode(points).alias("x")).where("x.given").select(key, "x.day", "x.level")


def day_shapes(events: DataFrame) -> DataFrame:
    """peak (the busiest hour, the first of equals) and arc of each day, from domains, branches, alternatives and their halves."""
    hours = events.groupBy("day", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    peak = hours.groupBy("day").agg(F.min_by("h", F.struct(-F.col("n"), F.col("h"))).alias("peak"))
    g = events.groupBy("day").agg(F.countDistinct("branch").alias("b"), F.countDistinct("tool").alias("dm"), F.count_if(F.col("s4") >= 9000).alias("alt"), F.count_if(F.col("source") == "git").alias("c"), F.count_if(F.col("source") == "ai").alias("ai"))
    key = Window.partitionBy("day")
    placed = events.select("day", "branch", F.row_number().over(key.orderBy("ts", "id")).alias("k"), F.floor(F.count("*").over(key) / 2).alias("m"))
    halves = placed.groupBy("day").agg(F.countDistinct(F.when(F.col("k") <= F.col("m"), F.col("branch"))).alias("e"), F.countDistinct(F.when(F.col("k") > F.col("m"), F.col("branch"))).alias("l"))
    quiet = (F.col("dm") <= 2) & (F.col("b") <= 2) & (F.col("alt") < 3)
    arc = (
        F.when(quiet, F.when((F.col("c") >= 5) | (F.col("ai") >= 3), "deep-dive").otherwise("routine")).when((F.col("alt") >= 5) & (F.col("b") >= 3), F.when(F.col("l") < F.col("e"), "convergence").otherwise("exploration"))
        .when((F.col("dm") >= 4) & (F.col("b") >= 3), "scattered").when(F.col("alt") >= 3, "exploration").otherwise("routine")
    )
    return g.join(peak, "day").join(halves, "day").select("day", "peak", arc.alias("arc"))


def state_changes(states: DataFrame, key: str, order: list[str], fields: list[str], most: int) -> DataFrame:
    """The last ``most`` states of each key that differ from the one before; ``change`` says how (field:from>to, comma-joined)."""
    ahead = Window.partitionBy(key).orderBy(*order)
    before = states.select("*", *[F.lag(f).over(ahead).alias("__" + f) for f in fields], F.row_number().over(ahead).alias("__i")).where("__i > 1")
    parts = [F.when(F.col(f) != F.col("__" + f), F.concat(F.lit(f + ":"), F.col("__" + f).cast("string"), F.lit(">"), F.col(f).cast("string"))) for f in fields]
    changed = before.withColumn("change", F.concat_ws(",", *parts)).where("change <> ''")
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return changed.withColumn("__k", last).where(F.col("__k") <= most).drop("__k", "__i", *["__" + f for f in fields])


def followed_by(events: DataFrame, id_: str, by: list[str], ts: str, cause: Column, effect: Column, within: int, least: int) -> DataFrame:
    """Causes with ``least`` or more effects of the same key after them, in fewer than ``within`` microseconds; no pairs are made."""
    marked = events.select(id_, *by, F.unix_micros(ts).alias("__t"), cause.alias("__cause"), effect.cast("int").alias("__effect"))
    after = Window.partitionBy(*by).orderBy("__t").rangeBetween(1, within - 1)
    counted = marked.withColumn("n", F.coalesce(F.sum("__effect").over(after), F.lit(0)))
    return counted.where(F.col("__cause") & (F.col("n") >= least)).select(id_, "n")


def decision_quality(revisions: Column, reach: Column) -> Column:
    """0 to 1: durable decisions are seldom revised, effective ones have much downstream."""
    durable = F.greatest(F.lit(0.0), 1 - revisions * 0.25)
    return durable * 0.4 + F.least(F.lit(1.0), reach * 0.1) * 0.3 + (1 - F.least(F.lit(1.0), revisions * 0.2)) * 0.3


def read_facts(facts: DataFrame, subjects: list | None = None, since: str | None = None, active_only: bool = False) -> DataFrame:
    """``facts`` (subject, valid_at, active) by whatever predicates are given."""
    if subjects is not None:
        facts = facts.where(F.col("subject").isin(*subjects))
    if since is not None:
        facts = facts.where(F.col("valid_at") >= F.lit(since).cast("timestamp"))
    return facts.where("active") if active_only else facts
