"""Structured Streaming: incremental twins of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.events import parse_lines, promote
from ..sources.states import StateTable


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New event lines under a folder of days, flattened; bad lines are left out."""
    rows = spark.readStream.schema("value string, event_date date").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return promote(parse_lines(rows).where("ok"))


def merge_into(path: str, keys: list[str], order: list[str], buckets: int = 64):  # noqa: ANN201
    """A ``foreachBatch`` function: keeps the newest row of each key in the table at ``path``.

    Only the buckets that a batch touches are written; a lost batch changes nothing, one that comes again is left out, and the
    version before stays readable (``sources.states``).
    """
    from ..operators.rollups import latest

    def merge(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()  # it is read for its buckets and for its rows
        StateTable(batch.sparkSession, path, keys, buckets).merge(held, lambda rows: latest(rows, keys, order), epoch)
        held.unpersist()

    return merge


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``merge_into`` keeps."""
    rows = StateTable(spark, path, []).read()
    if rows is None:
        raise ValueError(f"nothing was merged into {path} yet")
    return rows


def windowed_counts(events: DataFrame, ts: str, by: list[str], length: str, late: str) -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def distinct_events(events: DataFrame, id_: str, ts: str, late: str) -> DataFrame:
    """Each id once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_])


SESSION_STATE = "n bigint, started timestamp, last timestamp, scores array<double>"
SESSION_OUTPUT = "session string, n bigint, started timestamp, last timestamp, mean_recent double"


def session_state(events: DataFrame, session: str, ts: str, score: str, keep: int = 20, idle_hours: int = 4) -> DataFrame:
    """Running state per session: events, span and the mean of its last scores; idle sessions expire."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, started, last, scores = state.get if state.exists else (0, None, None, [])
        scores = list(scores)
        rows = pd.concat(list(batches)).sort_values(ts)
        n += len(rows)
        started = rows[ts].min() if started is None else min(pd.Timestamp(started), rows[ts].min())
        last = rows[ts].max() if last is None else max(pd.Timestamp(last), rows[ts].max())
        scores = (scores + rows[score].dropna().tolist())[-keep:]
        state.update((n, started, last, scores))
        state.setTimeoutDuration(idle_hours * 3_600_000)
        yield pd.DataFrame({"session": [str(key[0])], "n": [n], "started": [started], "last": [last], "mean_recent": [sum(scores) / len(scores) if scores else None]})

    return events.groupBy(session).applyInPandasWithState(update, SESSION_OUTPUT, SESSION_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
