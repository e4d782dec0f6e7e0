"""Periodic runs of words, by the divide and conquer of Main and Lorentz.

Words are interned to ids.  A text is halved again and again at positions that are multiples of powers of two.  A run that
crosses the middle of a segment continues one of two comparisons there: from the middle on with itself ``q`` words later, or
backwards from the middle with itself ``q`` words earlier.  How far such comparisons hold for every ``q`` at once is told by
four Z-functions (of the right half, of the left half reversed, and of each half behind the other).  What reaches over the
border of its segment was found whole by an enclosing one, and intervals with several periods keep the smallest.

A run with exponent 4 has two whole periods on one side of the middle.  That gives equalities of single words which any run
needs; they are tested for all segments of a batch at once, and only segments that pass get Z-functions.

A run: consecutive words with smallest period ``q`` and length of at least ``max(LEAST, EXPONENT * q)`` that no neighbouring
word extends.  Words: split at blanks and the control characters 9 to 13.

Defined results: null and empty texts have no words and no runs; very long texts take memory in proportion to their words
and time in proportion to n log n; repeated rows are each answered; no rows give no rows; other columns pass through, but
for those named like the ones added, which are replaced.  Ties for the greatest run: smallest start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import columns, slices

#: Fewest words of a run, and fewest periods that it has (at least 4: the tests before the Z-functions need them).
LEAST = 6
EXPONENT = 4

Run = tuple[int, int, int]


def z_function(s: Sequence[int]) -> list[int]:
    """For each position, how many values agree with those at the beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(ids: Sequence[int], lo: int, mid: int, hi: int, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """Start, length and period of the repetitions of ``ids[lo:hi]`` with words before and after ``mid``, which nothing in it extends."""
    left, right = ids[lo:mid], ids[mid:hi]
    back = left[::-1]
    a, b, found = len(left), len(right), []
    right_left, back_right = z_function([*right, -1, *left]), z_function([*back, -1, *right[::-1]])
    for q in range(1, (a + b) // exponent + 1):
        if q < b:  # pairs (i, i + q) around i = mid
            on = right_left[q] if right_left[q] < b - q else b - q
            before = back_right[a + 1 + b - q]
            if before == q and q < a:
                before += back_right[q]
            if before and on + before + q >= max(least, exponent * q):
                found.append((mid - before, on + before + q, q))
        if q < a:  # pairs (i - q, i) around i = mid
            before = back_right[q] if back_right[q] < a - q else a - q
            on = right_left[b + 1 + a - q]
            if on == q and q < b:
                on += right_left[q]
            if on and on + before + q >= max(least, exponent * q):
                found.append((mid - q - before, on + before + q, q))
    return found


def _segments(ids: np.ndarray, at: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows of (text, mid) of the segments in which the words let a crossing run be; positions are those of all texts in a row."""
    n = len(ids)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.arange(n) - at[text]
    half = inside & -inside
    met = []
    size = 1
    while size <= (int(inside.max()) if n else 0):
        mid = np.flatnonzero(half == size)
        end = np.minimum(mid + size, at[text[mid] + 1])
        most = (size + end - mid) // exponent
        many = (size + end - mid >= least) & (most > 0)
        mid, end, most = mid[many], end[many], most[many]
        for a in range(0, len(mid), max(1, (1 << 20) // size)):  # so many pairs at once
            m, stop, each = (x[a : a + max(1, (1 << 20) // size)] for x in (mid, end, most))
            of = np.repeat(np.arange(len(m)), each)
            q = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + 1
            middle, lo, hi = m[of], m[of] - size, stop[of]
            # Two periods from the middle on, and a word before it ...
            ok = np.flatnonzero(middle + 2 * q <= hi)
            ok = ok[ids[middle[ok]] == ids[middle[ok] + q[ok]]]
            ok = ok[ids[middle[ok] - 1] == ids[middle[ok] + q[ok] - 1]]
            ok = ok[ids[middle[ok] + q[ok] - 1] == ids[middle[ok] + 2 * q[ok] - 1]]
            # ... or two periods before the middle, and a word from it on.
            or_ = np.flatnonzero(middle - 2 * q >= lo)
            or_ = or_[ids[middle[or_]] == ids[middle[or_] - q[or_]]]
            or_ = or_[ids[middle[or_] - 1] == ids[middle[or_] - 1 - q[or_]]]
            or_ = or_[ids[middle[or_] - q[or_]] == ids[middle[or_] - 2 * q[or_]]]
            which = np.unique(of[np.concatenate((ok, or_))])
            met.append(np.stack((text[m[which]], m[which], m[which] - size, stop[which]), axis=1))
        size *= 2
    return np.concatenate(met) if met else np.zeros((0, 4), np.int64)


def runs(ids: np.ndarray, at: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[list[Run]]:
    """For each text (``ids[at[i]:at[i + 1]]``, none negative), its runs: start, length and period, by start and period."""
    if exponent < 4:
        raise ValueError("exponents below 4 are not found")
    smallest: list[dict[tuple[int, int], int]] = [{} for _ in at[1:]]
    for text, mid, lo, hi in _segments(ids, at, least, exponent).tolist():
        first, end = int(at[text]), int(at[text + 1])
        own = ids[lo:hi].tolist()
        for start, length, q in crossing(own, 0, mid - lo, hi - lo, least, exponent):
            start += lo
            stop = start + length
            if start == lo > first and ids[start - 1] == ids[start - 1 + q] or stop == hi < end and ids[stop] == ids[stop - q]:
                continue  # goes on beyond the segment
            held = smallest[text]
            key = (start - first, length)
            held[key] = min(q, held.get(key, q))
    return [sorted((s, n, q) for (s, n), q in held.items()) for held in smallest]


def repeated(found: list[Run], n: int) -> np.ndarray:
    """Of ``n`` words, those that a run repeats: all of it after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


Order = Callable[[object, int], "np.ndarray | None"]


def periodic(documents: DataFrame, order: Order | None = None, least: int = LEAST, exponent: int = EXPONENT, collapse: bool = True) -> DataFrame:
    """Columns of ``documents`` plus ``n_words``, ``runs`` (start, length and period of each, by start and period), ``longest`` (the
    greatest of them) and ``collapsed`` (the kept words joined by one space; null unless asked for).

    ``order``: given a document's ``doc_id`` and number of words, the positions to read them at (null: as they are), to plant
    runs for measurements.
    """
    fields = [c for c in documents.columns if c.lower() not in ("n_words", "runs", "longest", "collapsed")]
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    none = f"cast(null as array<{kind}>) as runs", f"cast(null as {kind}) as longest", "cast(null as string) as collapsed"
    plain = documents.select(*fields)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                raw, each, numbers = data.tobytes(), [], []
                intern: dict[bytes, int] = defaultdict(count().__next__)
                ids_of = columns(part, "doc_id")[0].to_pylist() if order else [None] * part.num_rows
                for i in range(part.num_rows):
                    words = raw[at[i] : at[i + 1]].split()
                    place = order(ids_of[i], len(words)) if order else None
                    if place is not None:
                        words = [words[j] for j in place.tolist()]
                    each.append(words)
                    numbers += [intern[w] for w in words]
                sizes = np.array([len(w) for w in each], np.int64)
                found = runs(np.array(numbers, np.int64), np.concatenate(([0], np.cumsum(sizes))), least, exponent)
                longest, kept = [], []
                for words, own in zip(each, found):
                    longest.append(min(own, key=lambda r: (-r[1], r[0], r[2]), default=None))
                    if collapse and own:
                        words = [words[j] for j in np.flatnonzero(~repeated(own, len(words))).tolist()]
                    kept.append(b" ".join(words).decode() if collapse else None)
                named = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
                arrays = [pa.array(sizes), pa.array([[named(r) for r in own] for own in found], pa.list_(run_type)), pa.array([named(r) for r in longest], run_type), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns(part, *fields), *arrays], [*fields, "n_words", "runs", "longest", "collapsed"])

    return plain.mapInArrow(find, plain.selectExpr(*(f"`{c}`" for c in fields), "cast(null as bigint) as n_words", *none).schema)


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """Where the contract reads the words of a document: a tenth of the documents get a periodic end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def op12(documents: DataFrame) -> DataFrame:
    """The contract's columns: one row per document."""
    found = periodic(documents.select("doc_id", "text"), planted)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.*",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def runs_sha256(found: list[Run]) -> str:
    return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
