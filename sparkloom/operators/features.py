"""Feature sessions: each event of a project joins one of the features that are open at its time, or opens one.

In order of time, an event goes

1. by its branch, if that is not a trunk: to the open feature of the branch, or to a new one of it;
2. else to the oldest open feature seen less than ``OVERLAP_HOURS`` ago whose files overlap with the event's by a Jaccard
   index over ``OVERLAP``;
3. else to the feature seen last, if less than ``RECENT_HOURS`` ago (ties: the oldest);
4. else to a new one.

A feature has the branch and files of its first event and is open until ``STALE_DAYS`` have passed since it was last seen.

The assignment is a fold in order, but after a quiet gap of ``OVERLAP_HOURS`` only branches can go on.  So a project's events
are cut into pieces at such gaps, which are found from one row for each bin of that length; pieces are folded side by side, a
batch of rows at a time, with nothing but the open features in memory.  Whether a branch goes on across pieces depends on when
its feature was last seen before, which rules 2 and 3 can delay: pieces whose branches turn out to be carried on from another
feature than assumed are folded again.  After k rounds the first k pieces of every project are settled, so it ends; two
rounds are the rule.

Defined results: events without a time, and null or empty ids of projects, are projects and events like others, but an event
without a time belongs to no feature (null); null files are no files, a null branch is none; equal times go by id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Rounds

OVERLAP = 0.4
OVERLAP_HOURS = 4
RECENT_HOURS = 2
STALE_DAYS = 7
TRUNKS = ("main", "master", "develop")

_HOUR = 3_600_000_000


class OpenFeatures:
    """The open features of a project, oldest first; times are microseconds."""

    def __init__(self) -> None:
        #: first seen, id, branch, files, last seen
        self.rows: list[list] = []

    def assign(self, at: int, event: object, branch: str | None, files: Iterable[str] | None, carried: tuple | None = None) -> tuple[object, str]:
        """The feature's id (that of its first event) and the rule.  ``carried``: first seen, id and files of the branch's feature
        from before these events, if it is open."""
        own = set(files or ())
        self.rows = [x for x in self.rows if at - x[4] <= STALE_DAYS * 24 * _HOUR]
        named = bool(branch) and branch not in TRUNKS
        if named:
            found = next((x for x in self.rows if x[2] == branch), None)
            if found is None and carried is not None:
                found = [carried[0], carried[1], branch, set(carried[2] or ()), at]
                self.rows.append(found)
                self.rows.sort(key=lambda x: x[:2])
            rule = "branch"
        else:
            found, rule = None, "files"
            for x in self.rows if own else ():
                shared = len(own & x[3])
                if at - x[4] < OVERLAP_HOURS * _HOUR and shared > OVERLAP * (len(own) + len(x[3]) - shared):
                    found = x
                    break
            if found is None:
                rule = "recent"
                near = [x for x in self.rows if at - x[4] < RECENT_HOURS * _HOUR]
                found = max(near, key=lambda x: x[4], default=None)
        if found is None:
            self.rows.append([at, event, branch or None, own, at])
            return event, "new"
        found[4] = at
        return found[1], rule


def _pieces(events: DataFrame) -> DataFrame:
    """``events`` (project, at, ...) plus ``piece``; what a project has in a bin of the gap's length never has the gap inside."""
    gap = OVERLAP_HOURS * _HOUR
    binned = events.withColumn("bin", F.floor(F.col("at") / gap))
    bins = binned.groupBy("project", "bin").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("project").orderBy("bin")
    cut = F.coalesce(F.col("first") - F.lag("last").over(order) >= gap, F.lit(True))
    numbered = bins.withColumn("cut", cut.cast("int")).withColumn("piece", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.select(F.col("project").alias("p"), F.col("bin").alias("b"), "piece")
    return binned.join(numbered, F.col("project").eqNullSafe(F.col("p")) & (F.col("bin") == F.col("b"))).drop("p", "b", "bin")


def _same(*columns: str) -> F.Column:
    """Equal columns of rows named x and y; a null project is one."""
    met = F.col("x.project").eqNullSafe(F.col("y.project"))
    for c in columns:
        met &= F.col(f"x.{c}") == F.col(f"y.{c}")
    return met


def _folded(pieces: DataFrame, carried: DataFrame) -> DataFrame:
    """project, piece, id, at, branch, files, feature and rule of every event."""
    met = pieces.alias("x").join(carried.alias("y"), _same("piece", "id"), "left")
    rows = met.select("x.*", "y.carry").withColumn("key", F.to_json(F.struct("project", "piece"), {"ignoreNullFields": "false"}))
    dealt = rows.repartition("key").sortWithinPartitions("key", "at", "id")
    kept = ["project", "piece", "id", "at", "branch", "files"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, OpenFeatures()
        for batch in batches:
            rows = batch.to_pylist()
            features, rules = [], []
            for row in rows:
                if row["key"] != key:
                    key, open_ = row["key"], OpenFeatures()
                carry = row["carry"]
                feature, rule = open_.assign(row["at"], row["id"], row["branch"], row["files"], carry and (carry["first"], carry["feature"], carry["files"]))
                features.append(feature)
                rules.append(rule)
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            kind = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([*own, pa.array(features, kind), pa.array(rules, pa.string())], [*kept, "feature", "rule"])

    kind = pieces.schema["id"].dataType
    return dealt.mapInArrow(fold, dealt.select(*kept, F.lit(None).cast(kind).alias("feature"), F.lit("").alias("rule")).schema)


def _carried(rows: DataFrame) -> DataFrame:
    """Where a branch's feature goes on from an earlier piece: the id of the branch's first event there, and as ``carry`` when the
    feature was first seen, its id and its files.  ``rows``: events with their features."""
    named = ~F.coalesce(F.col("branch"), F.lit("")).isin("", *TRUNKS)
    opening = F.min_by(F.struct(F.col("at").alias("first"), F.col("id").alias("feature"), "files"), F.struct("at", "id"))
    direct = rows.where(named).groupBy("project", "branch", "piece", "feature").agg(opening.alias("own"))
    seen = rows.groupBy("project", "piece", "feature").agg(F.max("at").alias("last"))
    met = direct.alias("x").join(seen.alias("y"), _same("piece", "feature")).select("x.project", "x.branch", "x.piece", "x.own", "y.last")
    order = Window.partitionBy("project", "branch").orderBy("piece", "own.first")
    opens = F.coalesce(F.col("own.first") - F.lag("last").over(order) > STALE_DAYS * 24 * _HOUR, F.lit(True))
    opened = met.withColumn("opens", opens).withColumn("carry", F.last(F.when(F.col("opens"), F.col("own")), ignorenulls=True).over(order))
    return opened.where(~F.col("opens")).select("project", "piece", F.col("own.feature").alias("id"), "carry")


def feature_sessions(events: DataFrame, project: str, id_: str, ts: str, branch: str, files: str) -> DataFrame:
    """``project``, ``id``, ``branch``, ``files``, ``ts``, ``feature`` (id of its first event; null without a time) and ``rule``.  Ids are unique."""
    plain = events.select(F.col(project).alias("project"), F.col(id_).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(branch).cast("string").alias("branch"), F.col(files).cast("array<string>").alias("files"))
    with Rounds(events.sparkSession, "features") as rounds:
        pieces = rounds.table(_pieces(plain.where("at is not null")))
        # To begin with, a branch's feature is taken to be last seen with its own last event.
        carried = rounds.table(_carried(pieces.withColumn("feature", F.col("branch"))))
        folded = rounds.table(_folded(pieces, carried))
        while True:
            after = rounds.table(_carried(folded))
            both = carried.unionByName(after).groupBy("project", "piece", "id", "carry").agg(F.count("*").alias("n"))
            moved = rounds.table(both.where("n = 1").select("project", "piece").distinct())
            if moved.isEmpty():
                break
            again = _folded(pieces.alias("x").join(moved.alias("y"), _same("piece"), "left_semi"), after)
            settled = rounds.table(folded.alias("x").join(moved.alias("y"), _same("piece"), "left_anti").unionByName(again))
            rounds.forget(folded, carried, moved)
            folded, carried = settled, after
        rounds.keep(folded)
    none = plain.where("at is null").select("project", "id", "at", "branch", "files", F.lit(None).cast(plain.schema["id"].dataType).alias("feature"), F.lit(None).cast("string").alias("rule"))
    return folded.drop("piece").unionByName(none).withColumn("ts", F.timestamp_micros("at")).drop("at")


def feature_summaries(assigned: DataFrame, as_of: DataFrame) -> DataFrame:
    """One row a feature: project, feature, branch, first and last seen, its events, distinct files and whether it is stale at ``as_of`` (a single row)."""
    rows = assigned.where("feature is not null")
    files = rows.select("project", "feature", F.explode("files").alias("file")).groupBy("project", "feature").agg(F.countDistinct("file").alias("n_files"))
    out = rows.groupBy("project", "feature").agg(F.min_by("branch", F.struct("ts", "id")).alias("branch"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n_events"))
    same = F.col("o.project").eqNullSafe(F.col("f.project")) & (F.col("o.feature") == F.col("f.feature"))
    met = out.alias("o").join(files.alias("f"), same, "left").select("o.*", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))
    stale = F.col("last_seen") < F.col("as_of") - F.expr(f"interval {STALE_DAYS} days")
    return met.join(F.broadcast(as_of.limit(1))).withColumn("status", F.when(stale, "stale").otherwise("active")).drop("as_of")
