"""The driver's tables as developer-activity data, in Spark and, for the independent check, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks are AI events, purchases are commits; value is the direction score, props.k the turns."""
    turns = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("user_id") % 5).alias("project"), (F.col("user_id") % 7).alias("branch"), kind.alias("tool"),
        F.when(kind.isin("view", "click"), "ai").when(kind == "purchase", "git").otherwise("other").alias("source"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"), "value", turns.alias("turns"),
        F.col("user_id").alias("session"), (F.col("value") / 1000.0).alias("cost"), F.when(kind == "error", "failed").when(kind == "signup", "success").otherwise("partial").alias("outcome"), kind.alias("phase"),
    )


#: Rows that a task sorts or groups at most, about.
TASK_ROWS = 500_000


def parts(*tables: DataFrame) -> int:
    """Partitions by which a task has about ``TASK_ROWS`` rows of the largest table, whatever the session's number is: its memory
    does not grow with the input."""
    return max(1, max(-(-t.count() // TASK_ROWS) for t in tables))


EV = """ev AS (SELECT event_id AS id, ts, user_id, user_id % 5 AS project, user_id % 7 AS branch, event_type AS tool,
 CASE WHEN event_type IN ('view','click') THEN 'ai' WHEN event_type = 'purchase' THEN 'git' ELSE 'other' END AS source,
 least(value / 100.0, 1.0) AS score, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS turns, user_id AS session, value / 1000.0 AS cost,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'success' ELSE 'partial' END AS outcome, event_type AS phase FROM events),
 newest AS (SELECT max(ts) AS as_of FROM ev)"""


def r(x: str, places: int = 4) -> str:
    """SQL that rounds half towards plus infinity, after nine places (sums of doubles depend on their order beyond)."""
    return f"floor(round_even(CAST(({x}) AS DOUBLE) * 1e9, 0) / 1e9 * 1e{places} + 0.5) / 1e{places}"


def with_events(sql: str) -> str:
    return f"WITH {EV} {sql}"


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole numbers for what is averaged: s4 (score in ten-thousandths), v2 (value in cents), sec (specificity in
    sixtieths), tc (turns in tens) and cents (the price by tool), and the day."""
    tool = F.col("tool")
    return events(spark, sf_dir).withColumns({
        "s4": F.rint(F.least(F.col("value"), F.lit(100.0)) * 100).cast("long"), "v2": F.rint(F.col("value") * 100).cast("long"), "sec": F.second("ts").cast("long"),
        "tc": F.floor(F.col("turns") / 10).cast("long"), "cents": F.when(tool == "view", 1).when(tool == "click", 3).otherwise(2).cast("long"), "day": F.to_date("ts"),
    })


EX = """, ex AS (SELECT *, CAST(round_even(least(value, 100.0) * 100, 0) AS BIGINT) s4, CAST(round_even(value * 100, 0) AS BIGINT) v2, CAST(second(ts) AS BIGINT) sec, CAST(turns // 10 AS BIGINT) tc,
 CAST(CASE tool WHEN 'view' THEN 1 WHEN 'click' THEN 3 ELSE 2 END AS BIGINT) cents, CAST(ts AS DATE) AS day FROM ev)"""


def with_exact(sql: str) -> str:
    return f"WITH {EV} {EX} {sql}"
