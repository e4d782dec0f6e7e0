"""Segments of a conversation by its structure: four kinds of boundaries, and short segments joined to their neighbours.

A segment begins at a turn

1. whose files and those of the turn before have no leading directory in common (both have files);
2. of a user that says so by a phrase;
3. after a turn with tools, if more than ``GAP`` turns without tools follow and the next with tools is on other modules;
4. more than ``PAUSE`` seconds after the one before.

Segments of fewer than ``LEAST`` turns are joined to the one before, or at the beginning to what follows.  That needs no fold:
the first segment ends where the conversation has ``LEAST`` turns, and after it only segments that long begin one.

Defined results: conversations of fewer than ``LEAST`` turns are one segment; null files, tools, texts and times say nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 3
PAUSE = 300
GAP = 3
#: Phrases by which a user changes the topic (fixed values).
MARKERS = (r"\bdifferent\s+topic\b", r"\bmoving\s+on\s+to\b", r"\bswitching\s+to\b", r"\bnow\s+let['’]?s\b", r"\balso\s+need\s+to\b", r"\bback\s+to\s+the\b", r"\bseparately\b", r"\bnext[,:]?\s")


def _leading(files: Column, depth: int) -> Column:
    """The first directories of paths."""
    return F.array_distinct(F.transform(files, lambda f: F.array_join(F.slice(F.split(F.regexp_replace(f, "^/", ""), "/"), 1, depth), "/")))


def structural_segments(turns: DataFrame, conv: str) -> DataFrame:
    """conv, segment (from 1), first_turn, last_turn, n_turns, files and modules.

    ``turns``: the conversation, turn (its order), role, text, files (array), tools (how many calls) and ts.
    """
    order = Window.partitionBy(conv).orderBy("turn")
    until, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    own = turns.withColumns({"files": F.coalesce("files", F.array().cast("array<string>")), "place": F.row_number().over(order)})
    has = F.size("files") > 0
    own = own.withColumns({"before": F.lag("files").over(order), "pause": F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(order))})
    moved = has & (F.size("before") > 0) & ~F.arrays_overlap(_leading(F.col("files"), 1), _leading(F.col("before"), 1))
    says = (F.col("role") == "user") & F.coalesce("text", F.lit("")).rlike("(?i)" + "|".join(MARKERS))
    with_tools = F.coalesce("tools", F.lit(0)) > 0
    last = F.last(F.when(with_tools, F.struct("place", "files")), ignorenulls=True).over(earlier)
    shifted = with_tools & has & (F.size("last.files") > 0) & (F.col("place") - F.col("last.place") - 1 > GAP) & ~F.arrays_overlap(_leading(F.col("files"), 2), _leading(F.col("last.files"), 2))
    flagged = own.withColumn("last", last).withColumns({"cut": F.coalesce(moved, F.lit(False)) | F.coalesce(says, F.lit(False)) | F.coalesce(F.col("pause") > PAUSE, F.lit(False)), "back": F.when(F.coalesce(shifted, F.lit(False)), F.col("last.place") + 1)})
    # A boundary of the third kind lies before the turn that shows it.
    backs = F.collect_set("back").over(Window.partitionBy(conv))
    cut = (F.col("place") > 1) & (F.col("cut") | F.array_contains(backs, F.col("place")))
    raw = flagged.withColumn("cut", cut).withColumn("piece", F.sum(F.col("cut").cast("int")).over(until))
    size = F.count("*").over(Window.partitionBy(conv, "piece"))
    sized = raw.withColumns({"size": size, "begins": F.min("place").over(Window.partitionBy(conv, "piece"))}).withColumn("ends", F.col("begins") + F.col("size") - 1)
    first = F.min(F.when(F.col("ends") >= LEAST, F.col("piece"))).over(Window.partitionBy(conv))
    opens = F.coalesce((F.col("place") == F.col("begins")) & (F.col("piece") > first) & (F.col("size") >= LEAST), F.lit(False))
    placed = sized.withColumn("opens", opens.cast("int")).withColumn("segment", 1 + F.sum("opens").over(until))
    modules = lambda c: F.array_sort(_leading(c, 2))
    found = placed.groupBy(conv, "segment").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_turns"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))
    return found.withColumn("modules", modules(F.col("files")))
