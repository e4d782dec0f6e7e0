"""Event logs: JSON lines in one folder per day, read with a fixed schema, flattened into typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The event line.  ``metadata`` stays JSON text: its known keys are promoted, the rest is kept as overflow.
EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("projectId", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("content", T.StructType([
        T.StructField("summary", T.StringType()), T.StructField("detail", T.StringType()), T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("branch", T.StringType()), T.StructField("project", T.StringType()),
    ])),
    T.StructField("gitContext", T.StructType([T.StructField("repo", T.StringType()), T.StructField("branch", T.StringType()), T.StructField("commitHash", T.StringType())])),
    T.StructField("metadata", T.StringType()),
])

#: Promoted metadata keys and their types (fixed names of the event format).
PROMOTED = {
    "ai_tool": "string", "session_id": "string", "conversation_id": "string", "conversation_title": "string", "model_id": "string", "environment": "string",
    "repo_root": "string", "repo_name": "string", "prompt_full": "string", "turn_count": "int", "prompt_count": "int", "sequence_id": "int", "tokens_in": "int",
    "tokens_out": "int", "estimated_cost": "double", "execution_phase": "string", "outcome": "string", "intent_summary": "string",
}
LISTS = ("files_referenced", "files_modified", "prompts_all")


def parse_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """Text lines (``value``) to parsed events with ``ok``; blank lines are left out, bad ones keep their text in ``raw``."""
    line = F.trim("value")
    parsed = lines.where(line != "").select(*keep, line.alias("raw"), F.from_json(line, EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    ok = F.col("e.id").isNotNull() & F.col("e.timestamp").isNotNull() & F.col("e.source").isNotNull() & F.col("e.type").isNotNull()
    return parsed.select(*keep, "raw", F.coalesce(ok, F.lit(False)).alias("ok"), "e.*")


def read_days(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Events of the days between two dates (both included) in folders ``event_date=YYYY-MM-DD``; only those folders are read."""
    rows = spark.read.schema("value string, event_date date").text(folder)
    if first:
        rows = rows.where(F.col("event_date") >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col("event_date") <= F.lit(last).cast("date"))
    return parse_lines(rows)


def write_days(events: DataFrame, folder: str, ts: str = "timestamp") -> None:
    """Append events as JSON lines to the folder of their day."""
    events.withColumn("event_date", F.to_date(F.try_to_timestamp(ts))).write.mode("append").partitionBy("event_date").json(folder)


def promote(events: DataFrame, *keep: str) -> DataFrame:
    """Parsed events to one flat row each: promoted metadata columns, lists that are never null, and ``overflow`` for the rest."""
    meta = F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>")
    m = events.withColumn("__m", meta)
    get = lambda k: F.try_element_at("__m", F.lit(k))
    promoted = {k: (F.coalesce(get("model_id"), get("model")) if k == "model_id" else get(k)).try_cast(t) for k, t in PROMOTED.items()}
    lists = {k: F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>")) for k in LISTS}
    known = F.array(*[F.lit(k) for k in (*PROMOTED, *LISTS, "model")])
    rest = F.to_json(F.map_filter("__m", lambda k, v: ~F.array_contains(known, k)))
    flat = {
        "ts": F.try_to_timestamp("timestamp"), "project_id": F.coalesce(F.nullif("projectId", F.lit("")), "content.project", F.lit("")), "summary": F.col("content.summary"), "detail": F.col("content.detail"),
        "files": F.coalesce("content.files", F.array().cast("array<string>")), "branch": F.coalesce("content.branch", "gitContext.branch"), "repo": F.col("gitContext.repo"), "commit_hash": F.col("gitContext.commitHash"),
    }
    return m.select(*keep, "id", "source", "type", *[c.alias(n) for n, c in flat.items()], *[c.alias(n) for n, c in promoted.items()], *[c.alias(n) for n, c in lists.items()], rest.alias("overflow"))


def count_by_day(rows: DataFrame) -> DataFrame:
    """Non-blank and parseable lines per day, which may differ."""
    parsed = rows.select("event_date", F.trim("value").alias("value")).where("value != ''").select("event_date", F.from_json("value", EVENT).alias("e"))
    return parsed.groupBy("event_date").agg(F.count("*").alias("n_lines"), F.count_if(F.col("e.id").isNotNull()).alias("n_events"))


def upsert_latest(events: DataFrame, order: list[str]) -> DataFrame:
    """One row an id, the last written."""
    from ..operators.rollups import latest

    return latest(events, ["id"], order)


def conversations_to_events(turns: DataFrame, conv: str = "conversation_id", turn: str = "turn_index") -> DataFrame:
    """One event per conversation: first real user prompt, turns in order and their span; ``tool_files`` gives the files."""
    user = (F.col("role") == "user") & (F.length("content") > 5)
    return turns.groupBy(conv).agg(
        F.min_by("content", F.when(user, F.col(turn))).alias("summary"), F.count("*").alias("turn_count"),
        F.array_sort(F.collect_list(F.struct(turn, "role", "content"))).alias("turns"), F.min("ts").alias("started"), F.max("ts").alias("ended"),
    )


def tool_files(turns: DataFrame, conv: str = "conversation_id") -> DataFrame:
    """Files that tool calls (``tool_use``: array<struct<name,input>>) name, and whether an editing tool did."""
    calls = turns.select(conv, F.explode("tool_use").alias("t"))
    path = F.coalesce(F.get_json_object("t.input", "$.file_path"), F.get_json_object("t.input", "$.path"))
    edits = F.lower("t.name").rlike("edit|write|patch")
    return calls.select(conv, path.alias("file"), edits.alias("edit")).where("file is not null").groupBy(conv, "file").agg(F.bool_or("edit").alias("modified"))


def sequence_ids(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """A counter from 0 per session; events without one get 0."""
    number = F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1
    return events.withColumn("sequence_id", F.when(F.coalesce(session, F.lit("")) == "", 0).otherwise(number))


def match_projects(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """The project whose root is the longest prefix of a path; else ``unregistered:<path>``.

    Every prefix of a path is looked up, so that the join is on equality.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    known = projects.select(F.rtrim("root", F.lit("/")).alias("root"), "project_id")
    met = paths.select("path").distinct().select("path", F.explode(prefixes).alias("root")).join(known, "root")
    best = met.groupBy("path").agg(F.max_by("project_id", F.length("root")).alias("project_id"))
    return paths.join(best, "path", "left").withColumn("project_id", F.coalesce("project_id", F.concat(F.lit("unregistered:"), F.col("path"))))
