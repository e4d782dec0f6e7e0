"""Keyed state tables that batches are merged into: buckets by key, versions that readers can hold on to.

Rows lie in a fixed number of buckets by a hash of their key.  A merge reads and writes only the buckets that the batch
touches, into the folder of a new version; then one line in the log names the version of every bucket.  A batch that is lost
before that line leaves what was there; one that comes again is left out.  The two last versions stay readable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import delete

_LOG = "version bigint, batch bigint, events bigint, buckets array<bigint>, fields string"


class StateTable:
    """A table at ``path``.  ``keys``: columns that identify a row; ``buckets`` holds for the table's life."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _log(self) -> list:
        try:
            return self.spark.read.schema(_LOG).json(f"{self.path}/log").orderBy(F.desc("version")).limit(3).collect()
        except Exception as error:  # nothing was merged yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, entry, which: list[int]) -> DataFrame | None:  # noqa: ANN001
        paths = [f"{self.path}/v={entry.buckets[b]}/bucket={b}" for b in which if entry.buckets[b] >= 0]
        return self.spark.read.schema(entry.fields).parquet(*paths) if paths else None

    @property
    def events(self) -> int:
        """Events that are in the table."""
        log = self._log()
        return log[0].events if log else 0

    @property
    def batch(self) -> int:
        """The last batch that is in the table; -1 before the first."""
        log = self._log()
        return log[0].batch if log else -1

    def read(self) -> DataFrame | None:
        """All rows; None before the first merge or if it left none."""
        log = self._log()
        return self._rows(log[0], list(range(len(log[0].buckets)))) if log else None

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame], DataFrame], batch: int, events: int = 0) -> bool:
        """Brings the rows of a batch in: ``combine`` makes one row a key from old and new rows.  False if the batch is there already."""
        log = self._log()
        if log and log[0].batch >= batch:
            return False
        touched = sorted(r.b for r in rows.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets`` numbers
        old = self._rows(log[0], touched) if log and touched else None
        both = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
        self._write(combine(both), touched, log, batch, (log[0].events if log else 0) + events)
        return True

    def replace(self, rows: DataFrame, batch: int, events: int) -> None:
        """All rows anew."""
        self._write(rows, list(range(self.buckets)), self._log(), batch, events)

    def _write(self, rows: DataFrame, touched: list[int], log: list, batch: int, events: int) -> None:
        version = log[0].version + 1 if log else 0
        target = f"{self.path}/v={version}"
        delete(self.spark, target)  # what a lost run may have left
        if touched:
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(target)
        there = self._filled(target)
        held = list(log[0].buckets) if log else [-1] * self.buckets
        for b in touched:
            held[b] = version if b in there else -1
        entry = [(version, batch, events, held, rows.schema.toDDL() if touched or not log else log[0].fields)]
        self.spark.createDataFrame(entry, _LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
        if len(log) > 1:  # of three versions before, the oldest is named by no one any more
            for v in set(log[1].buckets) - set(log[0].buckets) - set(held):
                if v >= 0:
                    delete(self.spark, f"{self.path}/v={v}")

    def _filled(self, target: str) -> set[int]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(target)
        fs = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(where):
            return set()
        return {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(where) if s.getPath().getName().startswith("bucket=")}
