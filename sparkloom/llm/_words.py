"""Vectorised words over the UTF-8 buffers of Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; longer texts come alone.
SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Ranges of more bytes are hashed one by one by the library.
_LONG = 512

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that are split by white space (space, tab to carriage return).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of lower-cased letters, digits and anything that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``limit`` bytes of text, with the text's bytes and offsets.  Each row comes once, whole."""
    if not batch.num_rows:
        return
    data, at = texts(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield batch.slice(row, to - row), data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def words(data: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of kept bytes, which never cross texts, and the index of each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kept = keep[data]
    start = kept.copy()
    start[1:] &= ~kept[:-1]
    edges = at[1:-1]
    edges = edges[edges < len(data)]
    start[edges] = kept[edges]
    end = np.zeros(len(data) + 1, dtype=bool)
    end[1:] = kept
    end[1:-1] &= ~kept[1:]
    inner = edges[edges > 0]
    end[inner] = kept[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, mixed in eight bytes at a time; other seeds give independent hashes."""
    size = ends - starts
    out = np.full(len(starts), mix(np.array([seed], np.uint64))[0], dtype=np.uint64) + size.astype(np.uint64) * _BASE
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    long = size > _LONG
    which, done = np.flatnonzero(~long & (size > 0)), 0
    while len(which):
        left = np.minimum(size[which] - done, 8).astype(np.uint64)
        block = eight[starts[which] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (left << np.uint64(3))))
        out[which] = mix((out[which] ^ block) + _BASE)
        done += 8
        which = which[size[which] > done]
    for i in np.flatnonzero(long):
        out[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), np.uint64)[0]
    return out


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text, in order; with fewer words than k, one of the whole sequence."""
    if not len(word):
        return word
    with np.errstate(over="ignore"):
        n = min(k, len(word))
        total = np.full(len(word) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            total = mix(total * _BASE + word[i : len(word) - n + 1 + i])
        return total


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
