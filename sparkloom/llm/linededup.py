"""Repeated line runs across a corpus, by a suffix array over line ids.

Every document is a sequence of its lines that hold a word; equal lines have equal ids.  The suffixes of all sequences are
ranked by distributed prefix doubling: ranks by the first 2k lines follow from sorting the pairs of ranks by the first k
lines at a suffix and k lines further on.  Suffixes whose rank is their own cannot repeat any further and leave, so that
after the first round only repeated lines take part.

A block of the suffix array whose suffixes share their first m lines (a longest-common-prefix interval of depth m) is named
by two overlapping ranks by the largest power of two up to m.  A run of at least ``min_words`` words that occurs again is
made up of the shortest such runs that begin at each of its lines or end at each of its lines, so the intervals at those
depths give the maximal repeated runs exactly.  The first occurrence by (doc_id, place) stays; all later ones are deleted.

Defined results: null texts stay null and empty ones empty; rows that repeat both doc_id and text count as one document and
get the same result; doc_ids may be numbers (compared as such) or of any other type (compared as strings), and null ones
come first; lines without words belong to no run and stay where they are; no rows give no rows; other columns pass through
unchanged, but for those named like the ones added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop, running_total, scratch, unused, written
from ._words import NOT_SPACE, hashes, slices, words

MIN_WORDS = 50

_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[0x0A] = False
_KEY = ["did", "th"]


def runs(n_words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the shortest runs of lines with ``least`` words that begin or end at each line of a document."""
    sums = np.concatenate(([0], np.cumsum(n_words)))
    n = len(n_words)
    end = np.searchsorted(sums, sums[:-1] + least)
    forward = np.flatnonzero(end <= n)
    start = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    backward = np.flatnonzero(start >= 0)
    pairs = np.unique(np.concatenate((forward * (n + 1) + end[forward] - forward, start[backward] * (n + 1) + backward + 1 - start[backward])))
    return pairs // (n + 1), pairs % (n + 1)


def _lines(documents: DataFrame, least: int) -> DataFrame:
    """did, th, pos, h1, h2 (the line's id), spans (depths of the runs from here) and deepest (of the document's)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                starts, ends, _ = words(data, at, _NOT_NEWLINE)
                word, _, _ = words(data, at, NOT_SPACE)
                counts = np.searchsorted(word, ends) - np.searchsorted(word, starts)
                full = counts > 0
                starts, ends, counts = starts[full], ends[full], counts[full]
                one, two = hashes(data, starts, ends), hashes(data, starts, ends, seed=1)
                first = np.searchsorted(starts, at)
                pos = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))
                spans: list = [None] * len(starts)
                deepest = np.zeros(len(starts), dtype=np.int32)
                for a, b in zip(first, first[1:]):
                    s, m = runs(counts[a:b], least)
                    if len(s):
                        deepest[a:b] = m.max()
                        cuts = np.flatnonzero(np.diff(s)) + 1
                        for where, group in zip(s[np.concatenate(([0], cuts))], np.split(m, cuts)):
                            spans[a + where] = group
                of = pa.array(np.repeat(np.arange(part.num_rows), np.diff(first)))
                keys = [part.column(part.schema.get_field_index(k)).take(of) for k in _KEY]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(pos.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(spans, pa.list_(pa.int32())), pa.array(deepest)],
                    [*_KEY, "pos", "h1", "h2", "spans", "deepest"],
                )

    did, th = _keys(documents)
    kind = "bigint" if _whole(documents) else "string"
    return documents.select(did.alias("did"), th.alias("th"), "text").mapInArrow(split, f"did {kind}, th bigint, pos int, h1 bigint, h2 bigint, spans array<int>, deepest int")


def _whole(documents: DataFrame) -> bool:
    return documents.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _keys(documents: DataFrame) -> tuple[Column, Column]:
    """A document's id, never null and in the order of doc_ids, and the hash of its text."""
    own = F.col("doc_id")
    did = F.coalesce(own.cast("long"), F.lit(-(1 << 63))) if _whole(documents) else F.coalesce(F.concat(F.lit("="), own.cast("string")), F.lit(""))
    return did, F.xxhash64("text")


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """did, th, pos and m: every shortest run of ``min_words`` words that an earlier place in the corpus has as well."""
    with scratch(documents.sparkSession) as kept:
        lines = written(_lines(documents, min_words), "lines").where("deepest > 0")
        ids = written(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "ids")
        order = running_total(ids, ["h1", "h2"], "n", "rank", "ranked")
        level = lines.join(order.select("h1", "h2", "rank"), ["h1", "h2"]).select(*_KEY, "pos", "spans", "deepest", "rank").dropDuplicates([*_KEY, "pos"])
        level = written(level, "level")
        k, found = 1, None
        while True:
            now = _at_depths(level, k)
            found = now if found is None else found.unionByName(now)
            following = level.where(F.col("deepest") >= 2 * k)
            pairs = written(_pairs(following, F.lit(k), [*_KEY, "pos", "spans", "deepest"]), "pairs")
            keys = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
            order = running_total(keys, ["a", "b"], "n", "rank", "ranked")
            level = written(pairs.join(order.select("a", "b", "rank"), ["a", "b"]).select(*_KEY, "pos", "spans", "deepest", "rank"), "level")
            drop(pairs, order)
            k *= 2
            if level.limit(1).count() == 0:
                break
        found = written(found, "runs")
        interval = ["m", "a", "b"]
        first = found.groupBy(*interval).agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "pos")).alias("first")).where("n > 1").drop("n")
        first = written(first, "first")  # both sides of the join are plain shuffles, so that an interval of very many places is split
        later = written(found.join(first, interval).where(F.struct(*_KEY, "pos") != F.col("first")).select(*_KEY, "pos", "m"), "later")
        kept.append(later)
    return later


def _pairs(level: DataFrame, distance: F.Column, columns: list[str]) -> DataFrame:
    """Each suffix's rank as a, and as b the rank of the suffix that many lines further on in the document."""
    other = level.select(*_KEY, F.col("pos").alias("to"), F.col("rank").alias("b"))
    return level.withColumn("to", F.col("pos") + distance).join(other, [*_KEY, "to"]).select(*columns, F.col("rank").alias("a"), "b")


def _at_depths(level: DataFrame, k: int) -> DataFrame:
    """The interval of each run whose depth m is k or more and below 2k."""
    wanted = level.select(*_KEY, "pos", "rank", F.explode("spans").alias("m")).where(F.col("m").between(k, 2 * k - 1))
    if k == 1:
        return wanted.select(*_KEY, "pos", "m", F.col("rank").alias("a"), F.col("rank").alias("b"))
    other = level.select(*_KEY, F.col("pos").alias("to"), F.col("rank").alias("b"))
    wanted = wanted.withColumn("to", F.col("pos") + F.col("m") - k)
    return wanted.join(other, [*_KEY, "to"]).select(*_KEY, "pos", "m", F.col("rank").alias("a"), "b")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with the repeated runs' later copies cut from ``text``; adds n_lines, n_removed and removed ("start:end"
    ranges over the lines that hold a word, comma-joined)."""
    did, th, cuts_ = unused(documents, "did", "th", "cuts")
    later = repeated_runs(documents, min_words).groupBy(*_KEY).agg(F.collect_list(F.struct("pos", "m")).alias(cuts_))
    later = later.withColumnsRenamed({"did": did, "th": th})
    added = ("n_lines", "n_removed", "removed")
    fields = [c for c in documents.columns if c not in added]
    own = _keys(documents)
    joined = documents.withColumns({did: own[0], th: own[1]}).join(later, [did, th], "left").select(*fields, cuts_)
    schema = documents.select(*fields, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("removed")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "text", 1 << 20):
                column = part.schema.get_field_index("text")
                texts, n_lines, n_removed, removed = [], [], [], []
                for text, cuts in zip(part.column(column).to_pylist(), part.column(part.schema.get_field_index(cuts_)).to_pylist()):
                    lines = (text or "").split("\n")
                    full = [i for i, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
                    gone = np.zeros(len(full) + 1, dtype=np.int8)
                    for x in cuts or ():
                        gone[x["pos"] : x["pos"] + x["m"]] = 1
                    if cuts:
                        out = {full[i] for i in np.flatnonzero(gone[:-1])}
                        text = "\n".join(line for i, line in enumerate(lines) if i not in out)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone))))
                    texts.append(text)
                    n_lines.append(len(full))
                    n_removed.append(int(gone.sum()))
                    removed.append(",".join(f"{a}:{b}" for a, b in zip(edges[::2], edges[1::2])))
                arrays = [pa.array(texts, part.schema.field(i).type) if i == column else part.column(i) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.string())], schema.names)

    return joined.mapInArrow(cut, schema)


def op2(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed, the text that stays and its digest, a row per document."""
    out = dedup_lines(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("text_sha256"), "text")
