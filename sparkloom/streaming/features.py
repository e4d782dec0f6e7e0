"""The streaming twin of feature sessions: state of each project, events in order of their time whatever order they come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import STALE_DAYS, OpenFeatures

_DAY = 86_400_000
#: The state store that keeps maps and timers; set it as ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FeatureSessions(StatefulProcessor):
    """Events wait until the watermark has passed them, then join features in order.  State: the waiting events, and the features
    that are still open; both go once a project is silent for ``STALE_DAYS``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, id string", "branch string, files array<string>")
        self.open = handle.getMapState("open", "id string", "first bigint, branch string, files array<string>, last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        for frame in rows:
            for at, id_, branch, files in zip(frame["at"], frame["id"], frame["branch"], frame["files"]):
                self.waiting.updateValue((int(at), str(id_)), (branch, [] if files is None else list(files)))
        self._wake()
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = OpenFeatures()
        held.rows = sorted([first, id_, branch, set(files), last] for (id_,), (first, branch, files, last) in self.open.iterator())
        before = {x[1] for x in held.rows}
        out = []
        for at, id_ in sorted(k for k in self.waiting.keys() if k[0] < until):
            branch, files = self.waiting.getValue((at, id_))
            feature, rule = held.assign(at, id_, branch, files)
            out.append((key[0], id_, feature, rule))
            self.waiting.removeKey((at, id_))
        held.rows = [x for x in held.rows if until - x[4] <= STALE_DAYS * _DAY * 1000]
        for id_ in before - {x[1] for x in held.rows}:
            self.open.removeKey((id_,))
        for first, id_, branch, files, last in held.rows:
            self.open.updateValue((id_,), (first, branch, sorted(files), last))
        self._wake()
        if out:
            yield pd.DataFrame(out, columns=["project", "id", "feature", "rule"])

    def _wake(self) -> None:
        """One timer a project: when its next event is due, or else when its last feature is stale."""
        due = [at for at, _ in self.waiting.keys()] or [last + (STALE_DAYS * _DAY + 1) * 1000 for _, (_, _, _, last) in self.open.iterator()]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)

    def close(self) -> None:
        pass


def feature_stream(events: DataFrame, project: str, id_: str, ts: str, branch: str, files: str, late: str) -> DataFrame:
    """``project``, ``id``, ``feature`` and ``rule`` (ids as strings) of a stream of events, each once the watermark, ``late`` behind the
    latest time seen, has passed it; equal times go by the id as a string.  Events later than that are dropped, as ``late`` says; without a time, too."""
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    named = rows.select(F.col(project).cast("string").alias("project"), F.col(id_).cast("string").alias("id"), F.col(ts), F.unix_micros(ts).alias("at"), F.col(branch).cast("string").alias("branch"), F.col(files).cast("array<string>").alias("files"))
    return named.groupBy("project").transformWithStateInPandas(FeatureSessions(), "project string, id string, feature string, rule string", "append", "eventtime")
