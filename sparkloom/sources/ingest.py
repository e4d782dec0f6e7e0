"""Incremental ingest of event logs: only days whose files changed are read again, and the table equals a full rebuild.

Files lie in folders ``event_date=YYYY-MM-DD``.  A cursor keeps each file's size, time and a hash of its first bytes.  A file is
new, grown (its beginning is as it was), rewritten (it is not) or gone; in each case its day is read anew and replaces the day's
partition.  So running twice changes nothing, a lost run is done again, and what was rewritten or deleted does not stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import parse_lines, promote

_HEAD = 64
CURSOR = "file string, event_date date, size bigint, modified timestamp, head string"


def partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Days that have files, with their newest change."""
    return files(spark, folder).groupBy("event_date").agg(F.count("*").alias("n_files"), F.max("modified").alias("modified"))


def stale(spark: SparkSession, folder: str, since: DataFrame) -> DataFrame:
    """One row, ``stale``: whether a file is newer than ``since`` (one row, ``as_of``)."""
    return files(spark, folder).agg(F.max("modified").alias("newest")).join(F.broadcast(since)).select(F.coalesce(F.col("newest") > F.col("as_of"), F.lit(False)).alias("stale"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """file, event_date, size and modified; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(folder)
    day = F.to_date(F.regexp_extract("path", r"event_date=(\d{4}-\d{2}-\d{2})/", 1))
    return found.select(F.col("path").alias("file"), day.alias("event_date"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def cursor(spark: SparkSession, target: str) -> DataFrame:
    """The files as the last finished run saw them."""
    if not _exists(spark, f"{target}/cursor"):
        return spark.createDataFrame([], CURSOR + ", run bigint")
    every = spark.read.schema(CURSOR + ", run bigint").parquet(f"{target}/cursor")
    return every.join(F.broadcast(every.agg(F.max("run").alias("run"))), "run")


def changes(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """file, event_date, size, modified, head and status of every file there is or was."""
    old = cursor(spark, target).select("file", *[F.col(c).alias("old_" + c) for c in ("event_date", "size", "modified", "head")])
    met = files(spark, folder).join(old, "file", "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified"))
    touched = met.where(F.col("size").isNotNull() & ~F.coalesce(same, F.lit(False))).select("file")
    paths = [r.file for r in touched.collect()]  # names of changed files, not what is in them
    known = met.withColumn("new_head", F.when(F.coalesce(same, F.lit(False)), F.col("old_head")))
    if paths:
        heads = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.sha2(F.substring("content", 1, _HEAD), 256).alias("read_head"))
        known = known.join(heads, "file", "left").withColumn("new_head", F.coalesce("new_head", "read_head"))
    status = F.when(F.col("size").isNull(), "gone").when(F.col("old_size").isNull(), "new").when(same, "same").when((F.col("size") >= F.col("old_size")) & ((F.col("new_head") == F.col("old_head")) | (F.col("old_size") < _HEAD)), "grown").otherwise("rewritten")
    return known.select("file", F.coalesce("event_date", "old_event_date").alias("event_date"), "size", "modified", F.col("new_head").alias("head"), status.alias("status"))


def materialise(spark: SparkSession, folder: str, target: str, rebuild: bool = False) -> dict[str, int]:
    """Bring the table at ``target`` up to date; how many files there are by status.  ``rebuild`` reads every day again."""
    seen = changes(spark, folder, target)
    run = (cursor(spark, target).agg(F.max("run")).first()[0] or 0) + 1
    seen.withColumn("run", F.lit(run).cast("long")).write.mode("append").partitionBy("run").parquet(f"{target}/seen")
    seen = spark.read.schema(CURSOR + ", status string, run bigint").parquet(f"{target}/seen").where(F.col("run") == run)
    count = {r["status"]: r["n"] for r in seen.groupBy("status").agg(F.count("*").alias("n")).collect()}
    days = [r.event_date for r in seen.where(F.lit(rebuild) | (F.col("status") != "same")).select("event_date").distinct().collect()]
    if days:
        there = [r.event_date for r in seen.where("status != 'gone'").select("event_date").distinct().collect()]
        again = [d for d in days if d in set(there)]
        if again:
            lines = spark.read.schema("value string, event_date date").text(folder).where(F.col("event_date").isin(again))
            at = F.struct(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
            events = promote(parse_lines(lines.select("value", "event_date", at.alias("at")), "event_date", "at").where("ok"), "event_date", "at")
            last = events.groupBy("event_date", "id").agg(F.max_by(F.struct(*[c for c in events.columns if c not in ("event_date", "id", "at")]), "at").alias("e"))
            last.select("id", "e.*", "event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{target}/events")
    kept = seen.where("status != 'gone'").select(*[c.split()[0] for c in CURSOR.split(", ")], "run")
    kept.write.mode("append").partitionBy("run").parquet(f"{target}/cursor")
    return count


def materialised(spark: SparkSession, target: str) -> DataFrame:
    """The events of the days that still have files."""
    days = cursor(spark, target).select("event_date").distinct()
    return spark.read.parquet(f"{target}/events").join(F.broadcast(days), "event_date", "left_semi")
