"""Six rules over the outputs of several analyzers, for all projects at once.

Outputs are DataFrames by project, and a rule runs only if all that it needs are there; it gives a row for each project in
which it holds.  Where an output is a list, ``place`` is its order (1 for the first).  Ties in the worst score go to the least
domain.

Defined results: an analyzer without rows for a project says nothing about it; null values fulfil no condition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Outputs = dict[str, DataFrame]

#: Thresholds of the rules (fixed values).
WASTE, WASTE_CRITICAL = 0.2, 0.4
AES_CRITICAL, AES_GOOD = 40, 60
LOW, VERY_LOW, BLIND, EXPERT = 50, 30, 40, 70
SHARE = 30


def _listed(rows: DataFrame, order: F.Column) -> DataFrame:
    """project, domains (in order) and its first."""
    found = rows.groupBy("project").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "domain"))).alias("l"))
    return found.select("project", F.col("l.domain").alias("domains")).withColumn("domain", F.col("domains")[0])


def efficiency_blind_spot(o: Outputs) -> DataFrame:
    """Efficiency declines, and there are domains that nobody understands."""
    blind = _listed(o["comprehension"].where("blind"), F.col("domain"))
    met = o["efficiency"].where("trend = 'declining'").join(blind, "project")
    return met.withColumn("severity", F.when((F.size("domains") >= 2) | (F.col("aes") < AES_CRITICAL), "critical").otherwise("warning"))


def cost_loop(o: Outputs) -> DataFrame:
    """Much is wasted, and there are stuck loops."""
    met = o["cost"].where(F.col("waste_ratio") >= WASTE).join(_listed(o["loops"], F.col("place")), "project")
    return met.withColumn("severity", F.when(F.col("waste_ratio") > WASTE_CRITICAL, "critical").otherwise("warning"))


def velocity_comprehension(o: Outputs) -> DataFrame:
    """Work slows down in a domain that is hardly understood; the worst counts."""
    slow = o["velocity"].where("trend = 'decelerating'").select("project", "domain")
    met = slow.join(o["comprehension"].where(F.col("score") < LOW), ["project", "domain"])
    worst = met.groupBy("project").agg(F.min(F.struct("score", "domain")).alias("w"), F.array_sort(F.collect_set("domain")).alias("domains"))
    return worst.select("project", "domains", F.col("w.domain").alias("domain"), F.when(F.col("w.score") < VERY_LOW, "warning").otherwise("info").alias("severity"))


def pattern_efficiency(o: Outputs) -> DataFrame:
    """Prompts that work, and good efficiency."""
    return o["efficiency"].where(F.col("aes") >= AES_GOOD).join(_listed(o["patterns"], F.col("place")), "project").withColumn("severity", F.lit("info"))


def expertise_cost(o: Outputs) -> DataFrame:
    """Much is spent in a domain whose name contains, or lies in, that of one that is well known."""
    known = o["comprehension"].where(F.col("score") >= EXPERT).select("project", F.lower(F.col("domain")).alias("known"))
    spent = o["cost_domains"].where(F.col("percentage") >= SHARE).join(o["cost"].where("total != 0").select("project"), "project")
    name = F.lower("domain")
    met = spent.join(known, "project").where(name.contains(F.col("known")) | F.col("known").contains(name)).select("project", "domain", "place").distinct()
    return _listed(met, F.col("place")).withColumn("severity", F.lit("warning"))


def blind_spot_acceptance(o: Outputs) -> DataFrame:
    """Alerts for domains that are blind spots or hardly understood."""
    weak = o["comprehension"].where(F.col("blind") | (F.col("score") < BLIND)).select("project", "domain").distinct()
    return _listed(o["alerts"].where("severity != 'info'").select("project", "domain", "place").join(weak, ["project", "domain"], "left_semi"), F.col("place")).withColumn("severity", F.lit("critical"))


#: What each rule needs.
RULES: dict[str, tuple[tuple[str, ...], Callable[[Outputs], DataFrame]]] = {
    "efficiency-blind-spot": (("efficiency", "comprehension"), efficiency_blind_spot), "cost-loop": (("cost", "loops"), cost_loop),
    "velocity-comprehension": (("velocity", "comprehension"), velocity_comprehension), "pattern-efficiency": (("patterns", "efficiency"), pattern_efficiency),
    "expertise-cost": (("cost", "cost_domains", "comprehension"), expertise_cost), "blind-spot-acceptance": (("alerts", "comprehension"), blind_spot_acceptance),
}


def correlations(outputs: Outputs, rules: dict[str, tuple[tuple[str, ...], Callable[[Outputs], DataFrame]]] = RULES) -> DataFrame | None:
    """project, rule, severity, domain and domains of every rule that holds; None if no rule has what it needs.

    ``outputs``: efficiency (project, aes, trend), comprehension (project, domain, score, blind), cost (project, waste_ratio, total),
    cost_domains (project, domain, percentage, place), loops (project, domain, place), velocity (project, domain, trend),
    patterns (project, domain, place), alerts (project, domain, severity, place).
    """
    found = None
    for name, (needs, rule) in rules.items():
        if all(n in outputs for n in needs):
            rows = rule(outputs).select("project", F.lit(name).alias("rule"), "severity", "domain", "domains")
            found = rows if found is None else found.unionByName(rows)
    return found
