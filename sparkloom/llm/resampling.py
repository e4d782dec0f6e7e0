"""Importance resampling towards a target distribution, over hashed n-grams.

Each document is a sparse row of counts over buckets of hashed word n-grams.  Rows are persisted in blocks of compressed
sparse rows (CSR): where each row begins, its buckets, their counts.  Column sums of the source's and of the target's blocks
are their distributions; the logarithm of their quotient is a bucket's gain, and the product of the stored matrix with the
vector of gains is every document's weight.  Texts are read and hashed once; both passes work on the stored blocks.

Adding Gumbel noise, a function of seed and id alone, to the weights and taking the greatest sums draws without replacement
in proportion to the weights' exponentials.  The draw ranks all documents by one range partitioning of ids and scores.

Words: lower-cased in A-Z only, runs of digits, letters a-z and characters beyond ASCII.  Features: the runs of 1 to
``GRAMS`` words joined by one space, repeats counted; a feature's bucket is its CRC-32 modulo ``BUCKETS``.

Defined results: null and empty texts have no features and weight 0, and are not drawn (they have too few words); very long
texts are hashed in parts, their row is as wide as the buckets at most; repeated rows are counted and ranked each; ties go to
the smaller id, then the smaller weight; a null id draws like an empty one and comes first among ties; no documents give no
rows; no target gives every bucket the smoothed share of none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import running_total, scratch, written
from ._words import ALNUM, LOWER, columns, slices, words

BUCKETS = 10_000
GRAMS = 3
#: Bytes of text whose rows share a block; its cells take about one and a half times as much.
BLOCK_BYTES = 1 << 18
#: Words that are hashed at once.
STEP_WORDS = 1 << 18
SEED = 42
MIN_WORDS = 20
PERCENT = 5


def _crc_table() -> np.ndarray:
    """What CRC-32 (reflected, polynomial EDB88320) does to each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0))
    return out


_TABLE = _crc_table()
#: Words of more bytes are hashed by the library.
_LONG = 64


def _fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of each range."""
    state, size = state.copy(), ends - starts
    which, done = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(which):
        now = state[which]
        state[which] = _TABLE[(now ^ data[starts[which] + done]) & 0xFF] ^ (now >> np.uint32(8))
        done += 1
        which = which[size[which] > done]
    for i in np.flatnonzero(size > _LONG):
        state[i] = zlib.crc32(data[starts[i] : ends[i]], int(~state[i])) ^ 0xFFFFFFFF
    return state


def gram_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: np.ndarray, grams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of 1, 2, ... words: which words they begin with, and their buckets.  ``after``: words of the text that follow each."""
    at = np.arange(len(starts))
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for n in range(grams):
        if n:
            going = after[at] >= n
            at, state = at[going], state[going]
            state = _TABLE[(state ^ 0x20) & 0xFF] ^ (state >> np.uint32(8))
        state = _fed(state, data, starts[at + n], ends[at + n])
        yield at, (~state % np.uint32(buckets)).astype(np.int64)


def _row_counts(data: np.ndarray, at: np.ndarray, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; sorted cells (text * buckets + bucket) and their counts."""
    data = LOWER[data]
    starts, ends, first = words(data, at, ALNUM)
    per = np.diff(first)
    text = np.repeat(np.arange(len(per)), per)
    after = np.repeat(first[1:], per) - 1 - np.arange(len(starts))
    cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(starts), STEP_WORDS):
        b = min(len(starts), a + STEP_WORDS)
        c = min(len(starts), b + grams - 1)  # words that only end n-grams
        inside = np.minimum(after[a:c], c - 1 - np.arange(a, c))
        hashed = [(i[i < b - a], x[i < b - a]) for i, x in gram_buckets(data, starts[a:c], ends[a:c], inside, grams, buckets)]
        new = [text[a + i] * buckets + x for i, x in hashed]
        found, n = np.unique(np.concatenate(new), return_counts=True)
        if not len(cells):
            cells, counts = found, n
        else:
            cells, where = np.unique(np.concatenate((cells, found)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, n)), len(cells)).astype(np.int64)
    return per, cells, counts


def count_matrix(documents: DataFrame, key: str = "doc_id", grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """CSR blocks: ``keys`` and ``n_words`` of the rows, ``indptr`` (where each row begins in the cells, and their end),
    ``indices`` (buckets, ascending in a row) and ``data`` (counts), both as little-endian whole numbers of as few bytes as do.
    """
    kind = documents.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text", BLOCK_BYTES):
                per, cells, counts = _row_counts(data, at, grams, buckets)
                indptr = np.searchsorted(cells, np.arange(len(per) + 1) * buckets)
                (keys,) = columns(part, "key")
                one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
                yield pa.RecordBatch.from_arrays([one(keys, None), one(per, pa.int64()), one(indptr, pa.int64()), _packed(cells % buckets), _packed(counts)], ["keys", "n_words", "indptr", "indices", "data"])

    return documents.select(F.col(key).alias("key"), "text").mapInArrow(count, f"keys array<{kind}>, n_words array<bigint>, indptr array<bigint>, indices binary, data binary")


def _packed(x: np.ndarray) -> pa.Array:
    """Whole numbers as one binary value, in the smallest type that holds them."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return pa.array([x.astype(kind).tobytes()], pa.binary())


def _unpacked(raw: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), f"<u{len(raw.as_buffer()) // n}") if n else np.zeros(0, np.uint8)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.ListScalar, pa.ListScalar, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, words, where rows begin, buckets and counts of each block."""
    keys, per, indptr, indices, data = columns(batch, "keys", "n_words", "indptr", "indices", "data")
    for i in range(batch.num_rows):
        begin = np.array(indptr[i].values)
        yield keys[i], per[i], begin, _unpacked(indices[i], int(begin[-1])), _unpacked(data[i], int(begin[-1]))


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: the distribution of all features over the buckets; each task sends a row a bucket at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket, n in _blocks(batch):
                total += np.bincount(bucket, n, buckets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], ["bucket", "n"])

    return matrix.mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed target's over the smoothed source's share, rounded down; one whole number a
    bucket.  Takes column sums: at most ``buckets`` rows of each come to the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for sums, out in ((source, s), (target, t)):
        for row in sums.collect():
            out[row.bucket] = row.n
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``key``, ``n_words``, ``n_features``, ``weight`` (the matrix times the gains) and ``score`` (with the noise of seed and key)."""
    kind = matrix.schema["keys"].dataType.elementType.simpleString()

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, per, indptr, bucket, n in _blocks(batch):
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[indptr])  # noqa: B023, E731
                weight = sums(gain[bucket] * n)
                noise = [_noise(seed, k) for k in keys.values.to_pylist()]
                yield pa.RecordBatch.from_arrays([keys.values, per.values, pa.array(sums(n)), pa.array(weight), pa.array(weight + np.array(noise, np.int64))], ["key", "n_words", "n_features", "weight", "score"])

    return matrix.mapInArrow(times, f"key {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def _noise(seed: int, key: object) -> int:
    """Thousandths of a Gumbel value, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def drawn(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (a written table) plus ``rank``: 1, 2, 3 ... for the greatest scores among ``percent`` of the documents of
    ``min_words`` or more; else null."""
    able = scored.where(F.col("n_words") >= min_words)
    order = ["falling", "key", "weight", "n_features", "n_words"]
    ranked = running_total(able.withColumns({"one": F.lit(1), "falling": -F.col("score")}), order, "one", "before", "ranks")
    most = percent * able.count() // 100
    ranked = ranked.withColumn("rank", F.when(F.col("before") < most, F.col("before") + 1).cast("long"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).unionByName(rest)


def resampled(documents: DataFrame, target: DataFrame, key: str = "doc_id", target_key: str = "item_id", seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``key``, n_words, n_features, weight, score and rank of every document, drawn to look like ``target``."""
    with scratch(documents.sparkSession) as kept:
        matrix = written(count_matrix(documents, key), "counts")
        gain = gains(column_sums(matrix), column_sums(count_matrix(target, target_key)))
        scored = written(weights(matrix, gain, seed), "scored")
        kept.append(scored)
    return drawn(scored, min_words, percent).withColumnRenamed("key", key)


def op13(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: one row per document."""
    return resampled(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
