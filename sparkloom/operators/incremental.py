"""Incremental analyzers: a state that batches of events are merged into, and an answer derived from the state.

``initialise`` makes state rows of any events, ``combine`` one row a key of old and new ones, ``derive`` the answer.  After any
batches the state equals that of all their events at once.  As a safeguard against events that were changed behind it, the
state is rebuilt from all events whenever the number of events in it is a multiple of ``RECONCILE``.

The running profile is not a sum: its average divides by all events so far, also those without a value, and so depends on
their order (``avg + (value - avg) / n`` at values only).  Over a stretch of events that is an affine map of the average
before it, whose factors follow from the positions of its values; maps of stretches are composed.  Positions come from counts
of days, so that no project's events have to meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..sources.states import StateTable

RECONCILE = 150


@dataclass(frozen=True)
class Incremental:
    """``least``: events below which there is no answer.  ``ordered``: states of later events are made knowing the state before."""

    name: str
    keys: list[str]
    initialise: Callable[[DataFrame], DataFrame]
    combine: Callable[[DataFrame], DataFrame]
    derive: Callable[[DataFrame], DataFrame]
    sources: tuple[str, ...] = ()
    least: int = 5
    #: Adds to the events what their positions follow from; takes the state so far (None before the first).
    placed: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None

    def mine(self, events: DataFrame) -> DataFrame:
        return events.where(F.col("source").isin(*self.sources)) if self.sources else events

    def rebuild(self, table: StateTable, events: DataFrame, batch: int) -> None:
        """The state of all these events."""
        mine = self.mine(events)
        known = self.placed(mine, None) if self.placed else mine
        table.replace(self.combine(self.initialise(known)), batch, mine.count())

    def update(self, table: StateTable, events: DataFrame, batch: int, everything: Callable[[], DataFrame] | None = None) -> bool:
        """Brings a batch in; ``everything`` gives all events up to and with it, for the rebuild when that is due.  False if nothing changed."""
        before = table.events
        if everything is not None and before and before % RECONCILE == 0:
            if table.batch >= batch:
                return False
            self.rebuild(table, everything(), batch)
            return True
        mine = self.mine(events)
        n = mine.count()
        if not n:
            return False
        known = self.placed(mine, table.read()) if self.placed else mine
        return table.merge(self.initialise(known), self.combine, batch, n)

    def answer(self, table: StateTable) -> DataFrame | None:
        """Null below ``least`` events."""
        state = table.read()
        return self.derive(state) if state is not None and table.events >= self.least else None


def sink(analyzer: Incremental, table: StateTable) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; a batch that comes again changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        analyzer.update(table, batch.persist(), epoch)
        batch.unpersist()

    return merge


# --- direction by directory: sums and counts (events: dirs, score in ten-thousandths)


def _directions(events: DataFrame) -> DataFrame:
    score = F.coalesce("s4", F.lit(5000))  # a missing score counts as one half
    return events.select(F.explode(F.array_distinct("dirs")).alias("dir"), score.alias("s")).groupBy("dir").agg(F.sum("s").alias("total"), F.count("*").alias("n"))


direction_by_directory = Incremental(
    "direction_by_directory",
    ["dir"],
    _directions,
    lambda rows: rows.groupBy("dir").agg(F.sum("total").alias("total"), F.sum("n").alias("n")),
    lambda state: state.where("n >= 2").select("dir", half_up(F.col("total") / F.col("n") / 100.0).cast("long").alias("density"), "n"),
    ("ai", "git"),
)


# --- baselines of phases: moments


def _moments(events: DataFrame) -> DataFrame:
    return events.where("v2 is not null").groupBy("phase").agg(F.count("*").alias("n"), F.sum("v2").alias("s"), F.sum(F.col("v2") * F.col("v2")).alias("q"), F.min("v2").alias("low"), F.max("v2").alias("high"))


def _baseline(state: DataFrame) -> DataFrame:
    mean = F.col("s") / F.col("n")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * mean) / (F.col("n") - 1))))
    return state.select("phase", "n", half_up(mean / 100, 4).alias("mean"), half_up(spread / 100, 4).alias("deviation"), (F.col("low") / 100).alias("low"), (F.col("high") / 100).alias("high"))


phase_baseline = Incremental(
    "phase_baseline",
    ["phase"],
    _moments,
    lambda rows: rows.groupBy("phase").agg(*[f(c).alias(c) for c, f in (("n", F.sum), ("s", F.sum), ("q", F.sum), ("low", F.min), ("high", F.max))]),
    _baseline,
)


# --- the running profile: composed maps, and counts of domains

#: Events and their averages so far, a project; ``domain`` is null in these rows, in those of a domain the averages are.
_METRICS = ("hds", "specificity")


def _positions(events: DataFrame, state: DataFrame | None) -> DataFrame:
    """``events`` plus ``t``, their place among the project's events, by time and id."""
    days = events.groupBy("project", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    until = F.sum("n").over(Window.partitionBy("project").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    before = days.select(F.col("project").alias("p"), F.col("day").alias("d"), F.coalesce(until, F.lit(0)).alias("earlier"))
    placed = events.withColumn("day", F.to_date("ts")).join(before, F.col("project").eqNullSafe(F.col("p")) & F.col("day").eqNullSafe(F.col("d"))).drop("p", "d")
    if state is not None:
        held = state.where("domain is null").select(F.col("project").alias("p"), F.col("n").alias("held"))
        placed = placed.join(held, F.col("project").eqNullSafe(F.col("p")), "left").drop("p").withColumn("earlier", F.col("earlier") + F.coalesce("held", F.lit(0))).drop("held")
    own = Window.partitionBy("project", "day").orderBy("ts", "id")
    return placed.withColumn("t", F.col("earlier") + F.row_number().over(own)).drop("earlier")


def _maps(events: DataFrame) -> DataFrame:
    """One row a project and day with ``n``, ``last`` (its last place), and for each metric the factor ``a`` and the summand ``b`` of its map; one row a project and domain."""
    later = Window.partitionBy("project", "day").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    out = events
    for m in _METRICS:
        step = F.when(F.col(m).isNotNull() & (F.col("t") > 1), F.log((F.col("t") - 1) / F.col("t"))).otherwise(0.0)
        out = out.withColumn(f"log_{m}", step).withColumn(f"b_{m}", F.when(F.col(m).isNotNull(), F.col(m) / F.col("t") * F.exp(F.coalesce(F.sum(f"log_{m}").over(later), F.lit(0.0)))))
    sums = [x for m in _METRICS for x in (F.sum(f"log_{m}").alias(f"log_{m}"), F.coalesce(F.sum(f"b_{m}"), F.lit(0.0)).alias(f"b_{m}"))]
    maps = out.groupBy("project", "day").agg(F.count("*").alias("n"), F.max("t").alias("last"), *sums).drop("day").withColumn("domain", F.lit(None).cast("string"))
    domains = events.groupBy("project", F.coalesce(F.col("domain").cast("string"), F.lit("general")).alias("domain")).agg(F.count("*").alias("n"))
    return maps.unionByName(domains, allowMissingColumns=True)


def _composed(rows: DataFrame) -> DataFrame:
    """One map a project, those of earlier places first, and the counts of domains."""
    after = Window.partitionBy("project").orderBy(F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    maps = rows.where("domain is null")
    for m in _METRICS:
        maps = maps.withColumn(f"b_{m}", F.col(f"b_{m}") * F.exp(F.coalesce(F.sum(f"log_{m}").over(after), F.lit(0.0))))
    sums = [x for m in _METRICS for x in (F.sum(f"log_{m}").alias(f"log_{m}"), F.sum(f"b_{m}").alias(f"b_{m}"))]
    whole = maps.groupBy("project").agg(F.sum("n").alias("n"), F.max("last").alias("last"), *sums).withColumn("domain", F.lit(None).cast("string"))
    return whole.unionByName(rows.where("domain is not null").groupBy("project", "domain").agg(F.sum("n").alias("n")), allowMissingColumns=True)


def _profile(state: DataFrame) -> DataFrame:
    """project, n, the two averages, domains and top_domain (ties: the least), and what they say: steers, precise and specialist."""
    own = state.where("domain is null").select("project", "n", half_up(F.col("b_hds"), 4).alias("hds"), half_up(F.col("b_specificity"), 4).alias("specificity"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "domain")))
    domains = state.where("domain is not null").groupBy(F.col("project").alias("p")).agg(ordered.alias("o"))
    met = own.join(domains, F.col("project").eqNullSafe(F.col("p")))
    special = (F.size("o") >= 2) & (F.get("o", F.lit(0))["n"] < 2 * F.get("o", F.lit(1))["n"])
    return met.select("project", "n", "hds", "specificity", F.size("o").alias("domains"), F.col("o")[0]["domain"].alias("top_domain"), ((F.col("hds") > 0.6) & (F.col("n") >= 20)).alias("steers"), ((F.col("specificity") > 0.7) & (F.col("n") >= 10)).alias("precise"), F.coalesce(special, F.lit(False)).alias("specialist"))


running_profile = Incremental("running_profile", ["project"], _maps, _composed, _profile, ("ai",), placed=_positions)
