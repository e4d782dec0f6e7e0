"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every word sequence of the items.  Document words stream through it; after each word its state tells
the longest sequence of item words that ends there.  Where that is at least a window long, the window's words are hit.

Items are cut into overlapping chunks and dealt to shards of bounded size, whose automata are built on the executors.  The
documents are scanned once for each shard, with one automaton in memory at a time; ranges and items are then brought together.

Words: texts lower-cased in A-Z only, runs of digits, letters a-z and characters beyond ASCII.

Defined results: null or empty text has no words and no hits; null or wordless item texts match nothing; items without an id count for hits and are not named; repeated items and
repeated documents each keep their own row; no items or no documents give no hits or no rows; other columns pass through
``contamination`` and ``verdicts``, but for those named like the ones added, which are replaced.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import running_total, scratch, unused, written
from ._words import ALNUM, LOWER, columns, hashes, slices, words

WINDOW = 13
#: An automaton takes about 300 bytes a word; benchmarks of more words are dealt over several, each scanned in turn.
SHARD_WORDS = 200_000
#: Words of an item that lie in one chunk, besides the window's overlap.
CHUNK_WORDS = 20_000


class Automaton:
    """A generalised suffix automaton over word hashes, with the items that each window or short item belongs to."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int) -> None:
        self.window = window
        self.names = [name for name, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.vocabulary = vocabulary
        ids = [np.searchsorted(vocabulary, w).tolist() for _, w in items]
        for sequence in ids:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.min_window = min((min(window, len(x)) for x in ids if x), default=window)
        pairs = [a * len(vocabulary) + b for x in ids for a, b in zip(x, x[1:])]
        self.pairs = np.unique(np.array(pairs, dtype=np.int64))
        #: For states at which a whole window has matched, its items; for short items, by state, their lengths.
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for i, sequence in enumerate(ids):
            need, state, length = min(window, len(sequence)), 0, 0
            for word in sequence:
                state, length = self.step(state, length, word)
                if length >= need:
                    at = self._at(state, need)
                    if need == window:
                        self.items.setdefault(at, set()).add(i)
                    elif length == need:
                        self.short.setdefault(at, {}).setdefault(need, set()).add(i)

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, word, q)
        new, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state and length of the longest match that ends with this word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def _at(self, state: int, length: int) -> int:
        """The state of the suffix of this length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, word: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of words, merged and in order, and the items whose windows occur."""
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        if not len(self.vocabulary) or len(word) < self.min_window:
            return found, items
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == word
        joined = known[1:] & known[:-1]  # only pairs of neighbours that an item has can lie in one match
        where = np.flatnonzero(joined)
        pair = at[where] * len(self.vocabulary) + at[where + 1]
        if len(self.pairs):
            slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[where] = self.pairs[slot] == pair
        else:
            joined[where] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        runs = [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2])]
        if self.min_window == 1:  # single known words are runs as well
            inside = np.zeros(len(word) + 1, dtype=bool)
            for a, b in runs:
                inside[a:b] = True
            runs = sorted(runs + [(int(i), int(i) + 1) for i in np.flatnonzero(known & ~inside[:-1])])
        for a, b in runs:
            if b - a < self.min_window:
                continue
            state = length = 0
            for i in range(a, b):
                state, length = self.step(state, length, int(at[i]))
                reach = 0
                if length >= self.window:
                    reach = self.window
                    items |= self.items.get(self._at(state, self.window), set())
                if self.short:
                    up = state
                    while up > 0:
                        for need, which in self.short.get(up, {}).items():
                            if length >= need:
                                reach = max(reach, need)
                                items |= which
                        up = self.link[up]
                if reach:
                    start = i + 1 - reach
                    while found and found[-1][1] >= start:
                        start = min(start, found.pop()[0])
                    found.append((start, i + 1))
        return found, items


def _chunks(benchmark: DataFrame, window: int) -> DataFrame:
    """item (null where the id is), number (of the row and chunk), n and words (hashes as bytes): every window lies in one chunk."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                data = LOWER[data]
                starts, ends, first = words(data, at, ALNUM)
                word = hashes(data, starts, ends)
                of, found = [], []
                for i, (a, b) in enumerate(zip(first, first[1:])):
                    for c in range(a, max(a + 1, b - window + 1), CHUNK_WORDS) if b > a else ():
                        of.append(i)
                        found.append(word[c : min(b, c + CHUNK_WORDS + window - 1)].tobytes())
                yield pa.RecordBatch.from_arrays([columns(part, "item")[0].take(pa.array(of, pa.int64())), pa.array([len(x) // 8 for x in found], pa.int64()), pa.array(found, pa.binary())], ["item", "n", "words"])

    return items.mapInArrow(cut, "item string, n bigint, words binary").withColumn("number", F.monotonically_increasing_id())


def _shards(benchmark: DataFrame, window: int, shard_words: int) -> tuple[DataFrame, list[int]]:
    """shard and automaton (pickled), each of about ``shard_words`` words, and the numbers of the shards."""
    chunks = written(_chunks(benchmark, window), "chunks")
    placed = running_total(chunks.select("number", "n"), ["number"], "n", "before", "chunks").select("number", F.floor(F.col("before") / shard_words).cast("int").alias("shard"))
    dealt = chunks.join(placed, "number").repartition("shard").sortWithinPartitions("shard", "item", "words")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str | None, np.ndarray]] = []
        at = None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pickle.dumps(Automaton(rows, window))], pa.binary())], ["shard", "automaton"])
        for batch in batches:
            for shard, item, raw in zip(*(x.to_pylist() for x in columns(batch, "shard", "item", "words"))):
                if shard != at and rows:
                    yield done()
                    rows = []
                at = shard
                rows.append((item, np.frombuffer(raw, np.uint64)))
        if rows:
            yield done()

    built = written(dealt.mapInArrow(build, "shard int, automaton binary"), "automata")
    return built, sorted(r.shard for r in built.select("shard").collect())


def _scanned(documents: DataFrame, automaton: Automaton, only_hits: bool) -> DataFrame:
    """Columns of ``documents`` plus n_words, hits and items by one automaton; all rows, or those with hits."""
    shared = documents.sparkSession.sparkContext.broadcast(automaton)
    fields = documents.columns
    schema = documents.select(*fields, F.lit(0).cast("long").alias("n_words"), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).alias("hits"), F.array(F.lit("")).alias("items")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        automaton = shared.value
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                data = LOWER[data]
                starts, ends, first = words(data, at, ALNUM)
                word = hashes(data, starts, ends)
                hits, items = [], []
                for row in range(part.num_rows):
                    found, which = automaton.scan(word[first[row] : first[row + 1]])
                    hits.append([{"start": s, "end": e} for s, e in found])
                    items.append(sorted({automaton.names[i] for i in which} - {None}))
                arrays = [*part.columns, pa.array(np.diff(first), pa.int64()), pa.array(hits, hit_type), pa.array(items, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(arrays, [*fields, "n_words", "hits", "items"])
                yield out.filter(pa.array([bool(x) for x in hits], pa.bool_())) if only_hits else out

    return documents.mapInArrow(scan, schema)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Columns of ``documents`` plus ``n_words``, ``hits`` (merged ranges of hit words) and ``items`` (sorted item ids).

    With one shard that is one scan without a shuffle.  With more, each shard's scan keeps only rows with hits; these are
    merged by row and joined back.
    """
    documents = documents.drop("n_words", "hits", "items")
    with scratch(documents.sparkSession) as kept:
        built, shards = _shards(benchmark, window, shard_words)
        one = lambda i: pickle.loads(built.where(F.col("shard") == i).first().automaton)
        if len(shards) < 2:
            return _scanned(documents, one(shards[0]) if shards else Automaton([], window), False)
        (row,) = unused(documents, "row")
        numbered = written(documents.withColumn(row, F.monotonically_increasing_id()), "documents")
        parts = None
        for i in shards:
            part = written(_scanned(numbered.select(row, "text"), one(i), True).select(row, "hits", "items"), "hits")
            parts = part if parts is None else parts.unionByName(part)
        met = parts.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        met = written(met.withColumn("hits", F.aggregate("hits", F.expr(_NO_HITS), _merge)), "hits")
        kept += [numbered, met]
    plain = _scanned(numbered, Automaton([], window), False).drop("hits", "items")
    out = plain.join(met, row, "left").withColumns({"hits": F.coalesce("hits", F.expr(_NO_HITS)), "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))})
    return out.drop(row)


_NO_HITS = "cast(array() as array<struct<start:int,end:int>>)"


def _merge(held: F.Column, x: F.Column) -> F.Column:
    """Sorted ranges plus the next one."""
    last = F.try_element_at(held, F.lit(-1))
    joined = F.concat(F.slice(held, F.lit(1), F.greatest(F.lit(0), F.size(held) - 1)), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
    return F.when((F.size(held) > 0) & (x["start"] <= last["end"]), joined).otherwise(F.concat(held, F.array(x)))


def n_hit() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def verdicts(scanned: DataFrame, coverage: float = 0.05) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: any hit, and at least the given share of the words."""
    return scanned.withColumn("n_hit", n_hit()).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= coverage * F.col("n_words")))


def remove_spans(scanned: DataFrame) -> DataFrame:
    """``text`` without its hit words (with what stands between the words of one range)."""
    fields = [f.name for f in scanned.schema.fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            out = []
            for text, ranges in zip(batch.column(column).to_pylist(), batch.column(batch.schema.get_field_index("hits")).to_pylist()):
                if text and ranges:
                    raw = text.encode()
                    data = LOWER[np.frombuffer(raw, dtype=np.uint8)]
                    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
                    kept, last = [], 0
                    for x in ranges:
                        kept.append(raw[last : starts[x["start"]]])
                        last = ends[x["end"] - 1]
                    text = b"".join([*kept, raw[last:]]).decode()
                out.append(text)
            arrays = [pa.array(out, batch.schema.field(i).type) if i == column else x for i, x in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, fields)

    return scanned.mapInArrow(cut, scanned.schema)


def op9(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: one row per document."""
    found = contamination(documents.select("doc_id", "text"), benchmark).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
