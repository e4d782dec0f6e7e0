"""Tool logs, row-store files and exports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.dialogue import filled_context, flat_content, linked_turns

LINKED = "uuid string, parentUuid string, type string, message struct<role:string,content:string>, timestamp string, sessionId string, cwd string, gitBranch string, isSidechain boolean"
ITEMS = "timestamp string, type string, payload struct<id:string,cwd:string,role:string,content:string,git:struct<branch:string,commit_hash:string,repository_url:string>>"


def linked_log(lines: DataFrame) -> DataFrame:
    """Turns of a log whose entries point to their parents: in the order of the conversation tree.

    ``lines``: value.  Lines that do not parse, and entries without text, are left out.
    """
    e = lines.select(F.from_json("value", LINKED).alias("e")).where("e.uuid is not null").select(
        F.col("e.sessionId").alias("session"), F.col("e.uuid").alias("uuid"), F.col("e.parentUuid").alias("parent"), F.col("e.message.role").alias("role"), flat_content(F.col("e.message.content")).alias("content"),
        F.try_to_timestamp("e.timestamp").alias("ts"), F.col("e.gitBranch").alias("branch"), F.col("e.cwd").alias("project_path"),
    )
    placed = linked_turns(e.select("session", "uuid", "parent"))
    out = e.join(placed, ["session", "uuid"]).where("content != '' and role is not null")
    return out.withColumn("turn_index", F.expr("row_number() over (partition by session, root order by depth, ts, uuid) - 1"))


def item_log(lines: DataFrame) -> DataFrame:
    """Turns of a log whose meta lines hold for all that follow in the file.  ``lines``: file, line_no, value."""
    e = lines.select("file", "line_no", F.from_json("value", ITEMS).alias("e")).where("e.type is not null")
    meta = F.col("e.type") == "session_meta"
    rows = e.select(
        "file", "line_no", F.when(meta, F.col("e.payload.id")).alias("session"), F.when(meta, F.col("e.payload.cwd")).alias("project_path"), F.when(meta, F.col("e.payload.git.branch")).alias("branch"),
        F.col("e.type").alias("type"), F.col("e.payload.role").alias("role"), flat_content(F.col("e.payload.content")).alias("content"), F.try_to_timestamp("e.timestamp").alias("ts"),
    )
    filled = filled_context(rows, ["file"], "line_no", ["session", "project_path", "branch"])
    items = filled.where("type = 'response_item' and content != ''")
    return items.withColumn("turn_index", F.expr("row_number() over (partition by file order by line_no) - 1")).drop("type")


def history_document(files: DataFrame, heading: str = r"(?m)^####\s+") -> DataFrame:
    """Turns of Markdown histories (path, value: the whole file): each prompt heading opens a user turn, what follows answers it."""
    parts = F.slice(F.split("value", heading), 2, 1 << 30)
    turns = files.select("path", F.posexplode(parts).alias("i", "part"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    prompt = bare(F.substring_index("part", "\n", 1))
    answer = bare(F.substring(F.col("part"), F.length(F.substring_index("part", "\n", 1)) + 1, F.length("part")))
    both = F.array(F.struct((2 * F.col("i")).alias("turn_index"), F.lit("user").alias("role"), prompt.alias("content")), F.struct((2 * F.col("i") + 1).alias("turn_index"), F.lit("assistant").alias("role"), answer.alias("content")))
    return turns.select("path", F.explode(both).alias("t")).select("path", "t.*").where("content != ''")


class _Part(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    """Splits a table by rowid, so that every task reads one range."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.after, self.parts = int(options.get("after", -1)), int(options.get("parts", 4))

    def partitions(self) -> list[InputPartition]:
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}" where rowid > ?', (self.after,)).fetchone()
        if low is None:
            return [_Part(0, 0)]
        step = -(-(high + 1 - low) // self.parts)
        return [_Part(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import sqlite3

        names = ", ".join("rowid" if f.name == "rowid" else f'"{f.name}"' for f in self.schema)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").schema(...).option("path", ...).option("table", ...)``; ``after``: only larger rowids.

    The file must be readable by the executors, as editors' stores on a shared folder are.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("give the columns by schema(...)")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str, after: int = -1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", name).option("after", after).load()


def manifest(events: DataFrame, ts: str = "ts") -> DataFrame:
    """What an export holds: events, sources, first and last day."""
    return events.agg(F.count("*").alias("n_events"), F.countDistinct("source").alias("n_sources"), F.to_date(F.min(ts)).alias("first_day"), F.to_date(F.max(ts)).alias("last_day"))


def export_csv(rollup: DataFrame, path: str) -> None:
    """A rollup as CSV with a header; text columns of raw events do not belong in one."""
    rollup.write.mode("overwrite").option("header", True).csv(path)


def mark_stale(features: DataFrame, as_of: DataFrame, days: int, last: str = "last_seen") -> DataFrame:
    """Active features not seen for some days become stale."""
    aged = features.join(F.broadcast(as_of.limit(1)))
    old = (F.col("status") == "active") & (F.col(last) < F.col("as_of") - F.make_dt_interval(F.lit(days)))
    return aged.withColumn("status", F.when(old, "stale").otherwise(F.col("status"))).drop("as_of")
