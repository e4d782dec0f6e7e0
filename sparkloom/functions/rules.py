"""Banded rules and composite indices, as column expressions; where several metrics meet, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import clamp, half_up, normalise

#: Weights of the reasoning depth and of a decision's gravity (fixed values).
REASONING = {"alternatives": 0.30, "trade_offs": 0.25, "recovery": 0.25, "crossing": 0.20}
GRAVITY = {"files": 0.3, "span": 0.3, "alternatives": 0.2, "trade_offs": 0.2}


def engagement_quality(steering: Column, understanding: Column, pushbacks: Column, stamps: Column) -> Column:
    """1 to 5: high where one steers, understands and pushes back, low where one stamps what comes."""
    both = steering + understanding
    return F.when((both >= 14) & (pushbacks > 0), 5).when(both >= 10, 4).when((steering <= 3) & (pushbacks == 0) & (stamps > 2), 1).when(both <= 6, 2).otherwise(3)


def feedback_threshold(unhelpful: Column, base: float = 0.3, limit: float = 0.3) -> Column:
    """The base, raised in proportion where more than ``limit`` of the feedback is unhelpful; null without feedback becomes the base."""
    return F.when(unhelpful > limit, base + (unhelpful - limit) * (0.3 / (1 - limit))).otherwise(base)


def complexity(interactions: Column, facts: Column, decisions: Column, quality: Column) -> Column:
    """The decay modifier of a domain: 1.5 for simple ones, 1.0, 0.7 and 0.5 as points for use, facts and decisions add up."""
    density = F.when(facts > 0, decisions / facts).otherwise(0.0)
    points = F.when(interactions >= 10, 3).when(interactions >= 5, 2).when(interactions >= 2, 1).otherwise(0)
    points = points + F.when(facts >= 20, 3).when(facts >= 10, 2).when(facts >= 5, 1).otherwise(0)
    points = points + F.when(density >= 0.3, 2).when(density >= 0.15, 1).otherwise(0) + F.when((quality <= 2) & (interactions >= 3), 1).otherwise(0)
    return F.when(points >= 7, 0.5).when(points >= 5, 0.7).when(points >= 2, 1.0).otherwise(1.5)


def depth_level(decisions: Column, alternatives: Column, shallow: int = 5, moderate: int = 15) -> Column:
    """0, 1 or 2 (shallow, moderate, deep): the higher of what the number of decisions and their mean alternatives say."""
    by_count = F.when(decisions <= shallow, 0).when(decisions <= moderate, 1).otherwise(2)
    by_alternatives = F.when(alternatives <= 1.5, 0).when(alternatives <= 3.0, 1).otherwise(2)
    return F.greatest(by_count, by_alternatives)


def loop_risk(turns: Column, falling: Column, recent: Column, phases: Column) -> Column:
    """0 to 1: long sessions, falling or low direction, and many changes of phase."""
    risk = F.when(turns > 10, 0.2).otherwise(0.0) + F.when(turns > 20, 0.2).otherwise(0.0) + F.when(falling, 0.3).otherwise(0.0)
    risk = risk + F.when(recent < 0.3, 0.2).otherwise(0.0) + F.when(recent < 0.15, 0.1).otherwise(0.0) + F.when(phases >= 4, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), risk)


def token_bag(tokens: Column, anchors: list[str], signals: list[str], text: Column | None = None) -> Column:
    """0.7 of the anchors hit and 0.3 of the signals hit; 0 without an anchor.  Of several words all must be there; "?" is looked
    for in the text itself."""

    def share(words: list[str]) -> Column:
        hit = lambda w: text.contains("?") if w == "?" and text is not None else F.array_size(F.array_except(F.array(*map(F.lit, w.split())), tokens)) == 0
        return sum(F.when(hit(w), 1).otherwise(0) for w in words) / F.lit(len(words)) if words else F.lit(0.0)

    anchor = share(anchors)
    return F.when(anchor > 0, 0.7 * anchor + 0.3 * share(signals)).otherwise(0.0)


def dual_velocity(sessions: Column, effectiveness: Column, commits: Column, rate: Column) -> list[Column]:
    """ratio, alignment and translation of normalised AI and commit activity."""
    lit = F.lit
    a = normalise(sessions, lit(0.0), lit(20.0)) * 0.5 + normalise(effectiveness, lit(0.0), lit(1.0)) * 0.5
    b = normalise(commits, lit(0.0), lit(10.0)) * 0.6 + normalise(rate, lit(0.0), lit(1.0)) * 0.4
    ratio = F.when(b > 0, half_up(a / b, 2)).when(a > 0, 10.0).otherwise(1.0)
    alignment = F.when((a < 0.2) & (b < 0.2), "both-low").when(ratio > 2, "ai-heavy").when(ratio < 0.5, "git-heavy").otherwise("balanced")
    return [ratio.alias("ratio"), alignment.alias("alignment"), F.when(a > 0, half_up(rate * b / a, 3)).otherwise(0.0).alias("translation")]


def ownership_adjusted(phase: Column, ownership: Column) -> list[Column]:
    genuine = F.when(ownership > 0.6, "genuine").when(ownership > 0.3, "mixed").otherwise("hollow")
    return [half_up(phase * (0.5 + ownership * 0.5), 2).alias("adjusted"), genuine.alias("genuineness")]


def relevance(edge_weight: Column, domain: Column, recent: Column, phase: Column, kind: Column, patterned: Column) -> Column:
    """What an entity means for a session: its direct edge (0.4), a recent domain (0.2), being recent itself (0.15), a kind that fits
    the phase (0.15, 0.1 while exploring) and an active pattern (0.1); at most 1."""
    yes = lambda x, w: F.when(x, w).otherwise(0.0)
    fits = yes((phase == "debugging") & (kind == "pattern"), 0.15) + yes((phase == "implementing") & (kind == "decision"), 0.15) + yes((phase == "exploring") & (kind == "capability"), 0.1)
    return F.least(F.lit(1.0), 0.4 * F.coalesce(edge_weight, F.lit(0.0)) + yes(domain, 0.2) + yes(recent, 0.15) + fits + yes(patterned, 0.1))


def reasoning_depth(decisions: DataFrame, by: list[str], files: int = 1) -> DataFrame:
    """n, rdi and gravity_rdi per key.  ``decisions``: domain, alternatives, traded (a trade-off was named), dead and recovered."""
    n = F.count("*")
    alternatives = F.least(F.lit(1.0), F.col("alternatives") / 5)
    gravity = GRAVITY["files"] * min(1.0, files / 20) + GRAVITY["alternatives"] * alternatives + F.when(F.col("traded"), GRAVITY["trade_offs"]).otherwise(0.0)
    x = decisions.groupBy(*by).agg(
        n.alias("n"), F.least(F.lit(1.0), F.avg("alternatives") / 5).alias("alternatives"), F.least(F.lit(1.0), F.count_if("traded") / n).alias("trade_offs"),
        F.when(F.count_if("dead") == 0, 0.5).otherwise(F.count_if(F.col("dead") & F.col("recovered")) / F.nullif(F.count_if("dead"), F.lit(0))).alias("recovery"),
        F.when(F.countDistinct("domain") >= 2, 1.0).otherwise(0.0).alias("crossing"), F.sum(gravity * alternatives).alias("wa"), F.sum(gravity).alias("w"),
    )
    index = lambda first: half_up(clamp(100 * (REASONING["alternatives"] * first + sum(F.col(k) * w for k, w in REASONING.items() if k != "alternatives")), 0.0, 100.0)).cast("long")
    weighted = F.when(F.col("w") > 0, F.col("wa") / F.col("w")).otherwise(F.col("alternatives"))
    return x.select(*by, "n", index(F.col("alternatives")).alias("rdi"), index(weighted).alias("gravity_rdi"))


def correlations(domains: DataFrame, overall: DataFrame, halves: DataFrame, expert: int = 70, share: float = 30.0) -> DataFrame:
    """rule, severity and domain of each rule that holds.

    ``domains``: domain, comprehension, n, low (weakly directed events) and cost; ``overall``: one row of trend and aes;
    ``halves``: domain and the mean turns of its earlier (a) and later (b) half.
    """
    blind = (F.col("comprehension") < 40) & (F.col("n") >= 3)
    total = domains.agg(F.sum("cost").alias("all_cost"), (F.sum("low") / F.sum("n")).alias("waste"))
    every = domains.join(F.broadcast(overall)).join(F.broadcast(total))  # one row each
    best = F.struct("comprehension", "domain")

    def rule(name: str, rows: DataFrame, severity: Column, domain: Column) -> DataFrame:
        return rows.agg(F.count("*").alias("__n"), severity.alias("severity"), domain.alias("domain")).where("__n > 0").select(F.lit(name).alias("rule"), "severity", "domain")

    looped = every.where((F.col("low") / F.col("n") > 0.2) & (F.col("waste") >= 0.2))
    slower = domains.join(halves, "domain").where((F.col("b") > F.col("a")) & (F.col("comprehension") < 50))
    costly = every.where((F.col("comprehension") >= expert) & (100.0 * F.col("cost") / F.col("all_cost") >= share))
    found = [
        rule("efficiency-blind-spot", every.where(blind & (F.col("trend") == "declining")), F.when((F.count("*") >= 2) | (F.max("aes") < 40), "critical").otherwise("warning"), F.min("domain")),
        rule("cost-loop", looped, F.when(F.max("waste") > 0.4, "critical").otherwise("warning"), F.min("domain")),
        rule("velocity-comprehension", slower, F.when(F.min("comprehension") < 30, "warning").otherwise("info"), F.min_by("domain", best)),
        rule("pattern-efficiency", every.where("aes >= 60"), F.lit("info"), F.max_by("domain", best)),
        rule("expertise-cost", costly, F.lit("warning"), F.max_by("domain", F.struct("cost", "domain"))),
        rule("blind-spot-acceptance", domains.where((F.col("comprehension") < 40) & (F.col("low") / F.col("n") > 0.25)), F.lit("critical"), F.min("domain")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
