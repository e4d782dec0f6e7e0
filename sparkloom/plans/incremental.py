"""Incremental analyzers over the events: four batches in order of time, with the rebuild when it is due."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..sources import tailing
from ..sources.scratch import Rounds
from ..sources.states import StateTable
from .adapter import exact, r
from .adapter import with_exact as ex
from .catalog import register


def _events(spark, d):
    k = F.col("turns")
    dirs = F.array(F.concat(F.lit("src/"), "phase"), F.concat(F.lit("lib/"), (k % 7).cast("string")))
    return exact(spark, d).withColumns({"dirs": F.when(k % 5 > 0, dirs), "hds": F.when(k % 3 > 0, F.col("s4") / 1e4), "specificity": F.when(k % 4 > 0, F.col("sec") / 60), "domain": F.when(k % 6 > 0, (k % 6).cast("string"))})


#: The same events, as ``ex`` has them.
_SQL = """, w AS (SELECT *, CASE WHEN turns % 5 > 0 THEN ['src/' || phase, 'lib/' || (turns % 7)] ELSE [] END dirs, CASE WHEN turns % 3 > 0 THEN s4 / 1e4 END h, CASE WHEN turns % 4 > 0 THEN sec / 60 END p,
 CASE WHEN turns % 6 > 0 THEN CAST(turns % 6 AS VARCHAR) ELSE 'general' END dom FROM ex)"""


def _after_batches(spark, d, analyzer, parts: int = 4):
    """The answer after so many batches, each a stretch of time, and one that comes twice."""
    events = _events(spark, d)
    span = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    with Rounds(spark, analyzer.name) as rounds:
        part = F.least(F.lit(parts - 1), F.floor((F.unix_micros("ts") - span.a) * parts / F.lit(max(1, span.b - span.a)))).cast("int")
        held = rounds.table(events.withColumn("batch", part))
        table = StateTable(spark, rounds.place("state"), analyzer.keys, buckets=8)
        for batch in (*range(parts), parts - 1):
            analyzer.update(table, held.where(F.col("batch") == batch), batch, lambda: held.where(F.col("batch") <= batch))  # noqa: B023
        return rounds.keep(rounds.table(analyzer.answer(table)))


@register("incremental_directions", ex(f"{_SQL}, u AS (SELECT unnest(dirs) dir, s4 FROM w WHERE source IN ('ai', 'git')) SELECT dir, CAST({r('sum(s4) / count(*) / 100', 0)} AS BIGINT) density, count(*) n FROM u GROUP BY 1 HAVING count(*) >= 2"))
def incremental_directions(spark, d):
    """Direction by directory: running sums and counts."""
    return _after_batches(spark, d, I.direction_by_directory)


@register("incremental_baselines", ex(f"{_SQL} SELECT phase, count(*) n, {r('avg(v2) / 100')} mean, {r('stddev_samp(v2) / 100')} deviation, min(v2) / 100 low, max(v2) / 100 high FROM w GROUP BY 1"))
def incremental_baselines(spark, d):
    """Baselines of phases: running moments."""
    return _after_batches(spark, d, I.phase_baseline)


@register(
    "incremental_profiles",
    ex(
        f"""{_SQL}, f AS (SELECT project, list_reduce(list_prepend({{'n': 0, 'h': 0.0::DOUBLE, 'p': 0.0::DOUBLE}}, list({{'n': 0, 'h': h::DOUBLE, 'p': p::DOUBLE}} ORDER BY ts, id)),
  lambda a, x: {{'n': a.n + 1, 'h': CASE WHEN x.h IS NULL THEN a.h ELSE a.h + (x.h - a.h) / (a.n + 1) END, 'p': CASE WHEN x.p IS NULL THEN a.p ELSE a.p + (x.p - a.p) / (a.n + 1) END}}) s FROM w WHERE source = 'ai' GROUP BY 1),
 c AS (SELECT project, dom, count(*) k, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, dom) o FROM w WHERE source = 'ai' GROUP BY 1, 2),
 t AS (SELECT project, count(*) domains, max(dom) FILTER (o = 1) top_domain, max(k) FILTER (o = 1) k1, max(k) FILTER (o = 2) k2 FROM c GROUP BY 1)
 SELECT project, CAST(s.n AS BIGINT) n, {r('s.h')} hds, {r('s.p')} specificity, domains, top_domain, {r('s.h')} > 0.6 AND s.n >= 20 AS steers, {r('s.p')} > 0.7 AND s.n >= 10 AS precise, coalesce(k1 > 2 * k2, false) specialist FROM f JOIN t USING (project)"""
    ),
)
def incremental_profiles(spark, d):
    """The running profile: averages that divide by all events so far, in order."""
    return _after_batches(spark, d, I.running_profile)


@register("tailed_events", "SELECT CAST(ts AS DATE) AS event_date, event_type AS kind, count(*) n, CAST(sum(event_id) AS BIGINT) ids FROM events GROUP BY ALL")
def tailed_events(spark, d):
    """Event lines read by a stream that stops, resumes when there are more files, and runs once more for nothing."""
    from .adapter import table

    lines = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", F.to_date("ts").alias("event_date"))).alias("value"), (F.hour("ts") < 12).alias("early"))
    with Rounds(spark, "tail") as rounds:
        log, out, checkpoint = (rounds.place(x) for x in ("log", "out", "checkpoint"))
        stream = lambda: tailing.event_tail(spark, log, ".txt").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        for part in (F.col("early"), ~F.col("early"), F.lit(False)):
            lines.where(part).select("value").write.mode("append").text(log)
            stream().awaitTermination()
        rows = spark.read.schema("file string, value string").parquet(out).select(F.from_json("value", "event_id bigint, event_type string, event_date date").alias("e")).select("e.*")
        found = rounds.table(rows.groupBy("event_date", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")))
        return rounds.keep(found)
