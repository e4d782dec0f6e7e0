"""Tables that cut the lineage of iterations, deleted as soon as no later step reads them."""

from __future__ import annotations

import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

from .places import shared_folder


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Rounds:
    """A folder under the shared one that holds the tables of an iteration.

    ``table`` writes a DataFrame and reads it back, so that lost executors cost a read instead of all rounds before.
    ``forget`` deletes what later rounds don't read.  At the end all tables go but for those given to ``keep``, which the
    result still reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_folder(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.kept: set[str] = set()
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._sparkloom_rounds = self  # as long as the table is in use, its id stays its own
        return back

    def place(self, name: str) -> str:
        """A path in the folder for a table that is written otherwise; it goes at the end."""
        path = self.paths[-len(self.paths) - 1] = f"{self.base}/{name}"
        return path

    def forget(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path and path not in self.kept:
                delete(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(self.paths[id(df)])
        return df

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        for path in self.paths.values():
            if path not in self.kept:
                delete(self.spark, path)
        if not self.kept:
            delete(self.spark, self.base)
