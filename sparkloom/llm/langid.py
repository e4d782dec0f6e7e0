"""Language identification with a bit-sliced Bloom filter over character n-grams.

Every language has a Bloom filter of the n-grams that are typical of it.  All filters share their size and hash functions
and are stored bit-sliced: position i holds one bit per language, so that the AND of an n-gram's few positions is the mask
of all languages that contain it.  A text's n-grams give a count of set bits per language; taking off the share that the
filter's own false positives explain, the language with the most decides.

Learning counts the n-grams of every labelled training document, language by language, as a distributed aggregation.  An
n-gram is typical of a language if its rate there is at least ``MIN_RATE`` and no less than a ``RATIO``-th of its highest
rate in any language.  Rates of a language sum to one, so at most 1 / ``MIN_RATE`` n-grams are; the filter is sized by how
many there are and built on the executors as partial ORs.

Defined results: null texts and texts without a letter are "und" with score 0; a text whose letters make no n-gram that is
known gets the most frequent language with score 0, and one too short for any n-gram gets it with its share of the training
rows; ties go to the first language by name; with no training rows all texts
are "und"; null languages teach nothing; repeated rows count each; other columns pass through unchanged, but for those named
like the ones added, which are replaced.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import scratch, written
from ._words import columns, mix, slices

#: Characters in an n-gram: lower-cased letters and their marks, and one space for all that stands between words.
N = 4
#: Least positions of the filter, positions for each n-gram of the language with most, and hash functions.
POSITIONS = 1 << 16
ROOM = 12
HASHES = 3
MIN_RATE = 1e-6
RATIO = 4.0
#: Bytes of text that are worked on at once; longer texts come alone.
SLICE_BYTES = 1 << 18
#: N-grams that a task holds while it counts, and then sends.
HELD_GRAMS = 1_000_000

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """2 for letters, 1 for the marks that stand with them."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LM":
            out[i] = 2 if kind == "L" else 1
    return out


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the index of the text of each, and whether each text has a letter."""
    joined = "\n\n".join((t or "").lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len((t or "").lower()) + 2 for t in texts])
    begin = np.cumsum(sizes) - sizes
    kind = _letters()[codes] if len(codes) else np.zeros(0, np.uint8)
    letter = kind > 0
    has = np.maximum.reduceat(np.concatenate((kind, [0])), np.minimum(begin, len(kind))) == 2 if len(texts) else np.zeros(0, bool)
    # One space between words; every text begins and ends with one.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(codes)]
    value = np.where(letter, codes, 0x20)[keep].astype(np.uint64)
    owner = owner[keep]
    if not len(value):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    fresh = np.concatenate(([True], owner[1:] != owner[:-1]))
    at = np.flatnonzero(fresh)
    value, owner = np.insert(value, at, 0x20), np.insert(owner, at, owner[at])
    value, owner = np.append(value, np.uint64(0x20)), np.append(owner, owner[-1])
    n = len(value) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for i in range(N):
            total = total * np.uint64(0x200000003) + value[i : i + n]
        whole = owner[:n] == owner[N - 1 :]
        for i in range(1, N - 1):  # words may end at an n-gram's edges, not inside
            whole &= value[i : i + n] != 0x20
        return mix(total[whole]), owner[:n][whole], has


def gram_counts(training: DataFrame) -> DataFrame:
    """lang, gram and n over all training rows; every task sends each n-gram of a language once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def sums(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams, n = (np.concatenate(x) for x in zip(*held[lang]))
            u, which = np.unique(grams, return_inverse=True)
            return u, np.bincount(which, weights=n, minlength=len(u)).astype(np.int64)

        def send() -> Iterator[pa.RecordBatch]:
            for lang in held:
                grams, n = sums(lang)
                for a in range(0, len(grams), 10_000):
                    g = grams[a : a + 10_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(n[a : a + 10_000])], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part, _, _ in slices(batch, "text", SLICE_BYTES):
                langs, texts = (x.to_pylist() for x in columns(part, "lang", "text"))
                grams, owner, _ = _grams(texts)
                names, code = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
                for i, lang in enumerate(names):
                    own = grams[code[owner] == i]
                    if len(own):
                        held.setdefault(str(lang), []).append(np.unique(own, return_counts=True))
                        size += len(held[lang][-1][0])
                if size > HELD_GRAMS:
                    for lang in held:
                        held[lang] = [sums(lang)]
                    size = sum(len(x[0][0]) for x in held.values())
                    if size > HELD_GRAMS // 2:
                        yield from send()
                        size = 0
        yield from send()

    return training.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def positions_of(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of n-grams in a filter of 2 ** ``bits`` positions, by each hash function."""
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            yield (mix(grams + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)) >> np.uint64(64 - bits)).astype(np.int64)


class Model:
    """The bit-sliced filter: ``tables[w][p]`` holds, of the w-th group of languages, a bit each at position p."""

    def __init__(self, languages: list[str], prior: int, prior_share: float, tables: list[np.ndarray], width: int) -> None:
        self.languages, self.prior, self.prior_share = languages, prior, prior_share
        self.tables, self.width = tables, width
        self.bits = len(tables[0]).bit_length() - 1 if tables else 0
        self.false_rate = np.array([self._bit(tables[i // width], i).mean() for i in range(len(languages))]) ** HASHES

    def _bit(self, words: np.ndarray, language: int) -> np.ndarray:
        return (words >> words.dtype.type(language % self.width)) & words.dtype.type(1)

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each n-gram, the bits of all languages whose filters contain it."""
        out = None
        for p in positions_of(grams, self.bits):
            here = [t[p] for t in self.tables]
            out = here if out is None else [a & b for a, b in zip(out, here)]
        return out

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text, whether it has letters, its n-grams, and each language's share of them without the false positives'."""
        grams, owner, has = _grams(texts)
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.bincount(owner, minlength=len(texts))
        if len(grams) and self.languages:
            masks = self.masks(grams)
            for i in range(len(self.languages)):
                hits[:, i] = np.bincount(owner, weights=self._bit(masks[i // self.width], i), minlength=len(texts))
        rate = hits / np.maximum(total, 1)[:, None]
        return has, total, np.clip((rate - self.false_rate) / (1 - self.false_rate), 0.0, 1.0)


def _filter(typical: DataFrame, languages: list[str], most: int) -> tuple[list[np.ndarray], int]:
    """The bit-sliced tables of ``typical`` (language, gram), and how many languages share one.  Positions are OR-ed on the
    executors; what comes to the driver is the filter itself."""
    bits = max(POSITIONS, ROOM * most - 1).bit_length()
    width = next((w for w in (8, 16, 32) if len(languages) <= w), 32)
    tables = [np.zeros(1 << bits, dtype=f"uint{width}") for _ in range(-(-len(languages) // width))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, grams = (x.to_numpy() for x in columns(batch, "language", "gram"))
            for p in positions_of(grams.view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array((language // width).astype(np.int32)), pa.array(p), pa.array(np.int64(1) << (language % width).astype(np.int64))], ["word", "p", "mask"])

    found = typical.mapInArrow(place, "word int, p bigint, mask bigint").groupBy("word", "p").agg(F.bit_or("mask").alias("mask"))
    for batch in found.toArrow().to_batches():
        word, p, mask = (x.to_numpy() for x in batch.columns)
        for w, table in enumerate(tables):
            table[p[word == w]] = mask[word == w].astype(table.dtype)
    return tables, width


def learn(training: DataFrame) -> Model:
    """A model of every language that ``training`` (lang, text) names.  Only its filter comes to the driver."""
    with scratch(training.sparkSession):
        training = training.where("lang is not null").withColumn("lang", F.col("lang").cast("string"))
        counts = written(gram_counts(training), "grams")
        sizes = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        languages = sorted(sizes)
        if not languages:
            return Model([], 0, 0.0, [], 8)
        totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
        rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all"))
        highest = rated.groupBy("gram").agg(F.max("rate").alias("highest"))
        number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
        typical = rated.where(F.col("rate") >= MIN_RATE).join(highest, "gram").where(F.col("rate") * RATIO >= F.col("highest"))
        typical = written(typical.select(number[F.col("lang")].alias("language"), "gram"), "typical")
        most = typical.groupBy("language").count().agg(F.max("count")).first()[0] or 1
        prior = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i))
        return Model(languages, prior, sizes[languages[prior]] / sum(sizes.values()), *_filter(typical, languages, most))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (the share of n-grams that the language explains) and n_grams in one scan."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "score", "n_grams")
    fields = [c for c in documents.columns if c not in added]
    schema = documents.select(*fields, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_grams")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, _, _ in slices(batch, "text", SLICE_BYTES):
                has, total, share = model.shares(columns(part, "text")[0].to_pylist())
                names, scores = [], []
                for i in range(part.num_rows):
                    if not has[i] or not model.languages:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(share[i].argmax()) if share[i].max() > 0 else model.prior
                        names.append(model.languages[best])
                        scores.append(float(share[i][best]) if total[i] else model.prior_share)
                yield pa.RecordBatch.from_arrays([*columns(part, *fields), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(total, pa.int64())], [*fields, *added])

    return documents.mapInArrow(predict, schema)


def held_out() -> F.Column:
    """Rows that teach nothing: crc32 of the doc_id as text has remainder 2 by 4.  A null doc_id is an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def op1(documents: DataFrame) -> DataFrame:
    """The contract's columns, a row per document."""
    model = learn(documents.where(~held_out()).select("lang", "text"))
    return identify(documents.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
