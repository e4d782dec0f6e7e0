"""Cosine clusters of texts within groups: a weighted all-pairs search, then greedy clusters in order.

Texts are bags of words.  Texts of one group with the same bag are one class, which only ever moves together; pairs are
sought between classes.  Classes stand in blocks, which are read in pairs without a shuffle.  Words are dealt to ``PARTS`` parts;
the dot product of two bags is at most that of their lengths part by part (Cauchy and Schwarz), which one product of matrices gives
for all pairs of two blocks, and only pairs that this bound lets through are compared by all their words.  So comparisons by the
bound grow with the square of a group, but what the search shuffles and holds in memory does not; it writes the pairs that it finds.

Clusters need no pairs of those that join the same one: the first ``FRONT`` classes of each group are decided alone, and what comes behind
them meets their heads only, and joins the first that is alike.  The great clusters begin early as a rule, and then are gone; of
what is left, all pairs are sought.

``prefixes`` and ``candidates`` bound the pairs by an index, which pays where texts mostly have rare words.  Words are ordered by their number of classes, rare ones first.  If the first word that two bags share
stands at i in one and at j in the other, their cosine is at most the product of the lengths of what stands from i and from j
on, in parts of the whole.  So only words from which on at least ``least`` of a bag's length remains can be the first shared
word of a pair, and only pairs whose product of remainders reaches ``least`` are looked at in full: no frequent word brings
texts together unless it makes out much of both.

Defined results: a text without words is similar to nothing, not even to its like; null texts are empty; repeated texts are
members each; groups with null keys are groups; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Rounds
from .texts import canonical

#: Slack for bounds in doubles; pairs are decided by their full cosine.
_SLACK = 1e-9
_SLACK_SINGLE = 1e-4
#: Classes of a block, and parts that words are dealt to by their hashes.
BLOCK = 512
PARTS = 2048
#: First classes of a group that are decided alone, and how often at most.
FRONT = 512
FRONTS = 4
#: Pairs of two blocks that are compared one by one, and ids that are broadcast, at most.
FEW = 1000
BROADCAST_IDS = 500_000
#: Words of a matrix.
WORDS = 16384


def words(text: F.Column) -> F.Column:
    """Lower-cased runs of a-z and 0-9 of two characters or more."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) > 1)


def classes(entries: DataFrame, group: list[str], id_: str, text: str, when: str) -> DataFrame:
    """``group`` (a struct), ``id`` (the least of the class), ``n``, ``first`` and ``last`` (of ``when``) and ``words``.  Texts without words are classes each."""
    bag = F.sort_array(words(F.col(text)))
    rows = entries.select(F.struct(*group).alias("group"), F.col(id_).alias("id"), F.col(when).alias("when"), bag.alias("words"))
    like = F.when(F.size("words") > 0, F.sha2(F.array_join("words", " "), 256)).otherwise(F.col("id").cast("string"))
    return rows.groupBy("group", like.alias("like")).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("when").alias("first"), F.max("when").alias("last"), F.any_value("words").alias("words")).drop("like")


def prefixes(held: DataFrame, least: float) -> DataFrame:
    """The words by which a class (``group``, ``id``, ``words``) can meet others: group, word, id and ``rest``, the part of the bag's length from there on."""
    tf = held.select("group", "id", F.explode("words").alias("word")).groupBy("group", "id", "word").agg(F.count("*").alias("tf"))
    rarity = tf.groupBy("group", "word").agg(F.count("*").alias("df"))
    ordered = tf.join(rarity, ["group", "word"])
    own = Window.partitionBy("group", "id")
    square = F.col("tf") * F.col("tf")
    rest = F.sum(square).over(own.orderBy(F.desc("df"), F.desc("word"))) / F.sum(square).over(own)
    return ordered.select("group", "word", "id", F.sqrt(rest).alias("rest")).where(F.col("rest") >= least - _SLACK)


def candidates(prefix: DataFrame, least: float) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of a group that the bounds allow."""
    a, b = (prefix.select("group", "word", F.col("id").alias(x), F.col("rest").alias(f"rest_{x}")) for x in "ab")
    return a.join(b, ["group", "word"]).where((F.col("a") < F.col("b")) & (F.col("rest_a") * F.col("rest_b") >= least - _SLACK)).select("a", "b").distinct()


def _bags(held: DataFrame) -> DataFrame:
    """key (a hash of the group), id, words (hashes, ascending, as bytes) and tfs of the classes with words."""
    kind = held.schema["id"].dataType.simpleString()
    hashed = held.where(F.size("words") > 0).select(F.xxhash64("group").alias("key"), "id", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(2)
            flat, at = words.flatten().to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
            bags = [np.unique(flat[a:b], return_counts=True) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w.tobytes() for w, _ in bags], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in bags], pa.binary())], ["key", "id", "words", "tfs"])

    return hashed.mapInArrow(count, f"key bigint, id {kind}, words binary, tfs binary")


def _blocks(bags: DataFrame, rounds: Rounds) -> DataFrame:
    """Blocks of up to ``BLOCK`` bags, in the order of groups: ``low`` and ``high`` (keys of the first and last group), ``first`` (id),
    keys, ids, sizes (distinct words of each), words (hashes, ascending in each class) and tfs."""
    kind = bags.schema["id"].dataType.simpleString()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            while sum(map(len, rest)) >= BLOCK:
                rows = pa.Table.from_batches(rest).combine_chunks()
                yield joined(rows.slice(0, BLOCK))
                rest = rows.slice(BLOCK).to_batches()
        if sum(map(len, rest)):
            yield joined(pa.Table.from_batches(rest))

    def joined(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        key, id_, words, tfs = rows.columns
        sizes = np.array([len(t) // 4 for t in tfs.to_pylist()], "<i4")
        one = pa.array([0, len(rows)], pa.int32())
        columns = [key[:1], key[-1:], id_[:1], pa.ListArray.from_arrays(one, key), pa.ListArray.from_arrays(one, id_), pa.array([sizes.tobytes()], pa.binary()), pa.array([b"".join(words.to_pylist())], pa.binary()), pa.array([b"".join(tfs.to_pylist())], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["low", "high", "first", "keys", "ids", "sizes", "words", "tfs"])

    ranged = bags.repartitionByRange(max(1, -(-bags.count() // BLOCK)), "key", "id").sortWithinPartitions("key", "id")
    return rounds.table(ranged.mapInArrow(block, f"low bigint, high bigint, first {kind}, keys array<bigint>, ids array<{kind}>, sizes binary, words binary, tfs binary"))


class _Bags:
    """A block's classes: where each one's words begin, its length, and the lengths of its parts as shares of that."""

    def __init__(self, row: dict[str, pa.Scalar], side: str) -> None:
        self.keys, self.ids = row[f"keys_{side}"].values.to_numpy(), row[f"ids_{side}"].values
        sizes, self.words, tfs = (np.frombuffer(row[f"{c}_{side}"].as_buffer(), kind) for c, kind in (("sizes", "<i4"), ("words", "<i8"), ("tfs", "<i4")))
        self.tfs, self.at = tfs.astype(float), np.concatenate([[0], np.cumsum(sizes)])
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        squares = self.tfs * self.tfs
        self.length = np.sqrt(np.bincount(self.owner, squares, len(sizes)))
        parts = np.bincount(self.owner * PARTS + (self.words % PARTS), squares, len(sizes) * PARTS).reshape(-1, PARTS)
        self.shares = (np.sqrt(parts) / self.length[:, None]).astype(np.float32)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and tfs of a class."""
        return self.words[self.at[i] : self.at[i + 1]], self.tfs[self.at[i] : self.at[i + 1]]

    def matrix(self, rows: np.ndarray, words: np.ndarray, kind: type) -> np.ndarray:
        """How often each of these classes has each of these words (both ascending)."""
        at = np.minimum(np.searchsorted(words, self.words), len(words) - 1)
        place = np.full(len(self.length), -1)
        place[rows] = np.arange(len(rows))
        has = (words[at] == self.words) & (place[self.owner] >= 0)
        out = np.zeros((len(rows), len(words)), kind)
        out[place[self.owner[has]], at[has]] = self.tfs[has]
        return out


def _dots(x: _Bags, y: _Bags, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of such pairs: whole numbers, exact in single precision up to 2 to the 24th, which no partial sum passes."""
    if len(i) <= FEW:
        out = np.zeros(len(i))
        for n, (a, b) in enumerate(zip(i, j)):
            (left, tf), (right, other) = x.of(a), y.of(b)
            at = np.minimum(np.searchsorted(right, left), len(right) - 1)
            out[n] = (tf * other[at])[right[at] == left].sum()
        return out
    rows, columns = np.unique(i), np.unique(j)
    common = np.intersect1d(x.words[np.isin(x.owner, rows)], y.words[np.isin(y.owner, columns)])
    kind = np.float32 if x.length.max() * y.length.max() < 1 << 24 else np.float64
    out = np.zeros((len(rows), len(columns)))
    for c in range(0, len(common), WORDS):
        out += x.matrix(rows, common[c : c + WORDS], kind) @ y.matrix(columns, common[c : c + WORDS], kind).T
    return out[np.searchsorted(rows, i), np.searchsorted(columns, j)]


def _met(x: DataFrame, y: DataFrame, least: float, heads: bool = False) -> DataFrame:
    """``a``, ``b`` and ``cosine`` of pairs of bags of these blocks within a group that reach ``least``; of the same blocks each pair once, or if ``x``
    has ``heads``, for each ``b`` of two blocks the least ``a`` alone."""
    kind = x.schema["first"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                x, y = _Bags(row, "a"), _Bags(row, "b")
                met = (x.shares @ y.shares.T >= least - _SLACK_SINGLE) & (x.keys[:, None] == y.keys)
                if row["same"].as_py():
                    met = np.triu(met, 1)
                i, j = np.nonzero(met)
                if not len(i):
                    continue
                cosine = _dots(x, y, i, j) / (x.length[i] * y.length[j])
                alike = cosine >= least
                i, j, cosine = i[alike], j[alike], cosine[alike]
                if heads:  # they stand in order
                    j, first = np.unique(j, return_index=True)
                    i, cosine = i[first], cosine[first]
                yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(i)), y.ids.take(pa.array(j)), pa.array(cosine)], ["a", "b", "cosine"])

    x, y = (df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns]) for df, side in ((x, "a"), (y, "b")))
    place = lambda side: F.struct(F.col(f"low_{side}").alias("low"), F.col(f"first_{side}").alias("first"))
    # Blocks of one table follow each other by group and id, so that a's ids are the smaller ones.
    pairs = x.join(y, (F.col("low_b") <= F.col("high_a")) & ((F.col("low_a") <= F.col("high_b")) if heads else place("a") <= place("b")))
    needed = [f"{c}_{side}" for side in "ab" for c in ("keys", "ids", "sizes", "words", "tfs")]
    same = F.lit(False) if heads else place("a") == place("b")
    return pairs.select(same.alias("same"), *needed).mapInArrow(compare, f"a {kind}, b {kind}, cosine double")


def cosine_pairs(held: DataFrame, least: float, rounds: Rounds | None = None) -> DataFrame:
    """``a``, ``b`` and ``cosine`` of the pairs of classes within a group that reach ``least`` (over 0); ids are unique.  The blocks are
    written to ``rounds``, or stay in the shared folder."""
    rounds = rounds or Rounds(held.sparkSession, "bags")
    blocks = _blocks(rounds.table(_bags(held)), rounds)
    return _met(blocks, blocks, least)


def led(bags: DataFrame, least: float, rounds: Rounds) -> DataFrame:
    """id and head of the ``bags`` (a table of ``rounds``) that join one before them."""
    found, left = [], bags

    def within(of: DataFrame) -> DataFrame:
        blocks = _blocks(of, rounds)
        pairs = rounds.table(_met(blocks, blocks, least).select("a", "b"))
        out = rounds.table(canonical(pairs).select(F.col("dropped").alias("id"), F.col("kept").alias("head")))
        rounds.forget(blocks, pairs)
        found.append(out)
        return out

    def without(of: DataFrame, gone: DataFrame) -> DataFrame:
        ids = gone.select("id")
        return of.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_anti").select("key", "id", "words", "tfs")

    for _ in range(FRONTS):
        first = left.select("key", "id").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= FRONT)
        last = rounds.table(first.groupBy("key").agg(F.max("id").alias("last")))
        told = left.join(F.broadcast(last) if last.count() <= BROADCAST_IDS else last, "key")
        front, behind = (rounds.table(told.where(c).drop("last")) for c in ("id <= last", "id > last"))
        heads = _blocks(without(front, within(front)), rounds)
        rest = _blocks(behind, rounds)
        joined = rounds.table(_met(heads, rest, least, heads=True).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("head")))
        found.append(joined)
        n, of = joined.count(), behind.count()
        after = rounds.table(without(behind, joined))
        rounds.forget(left if left is not bags else None, last, front, behind, heads, rest)
        left = after
        if n < of / 10:
            break
    if not left.isEmpty():
        within(left)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def cosine_clusters(entries: DataFrame, group: list[str], id_: str, text: str, when: str, least: float, min_size: int) -> DataFrame:
    """Of each group the greatest cluster of ``min_size`` entries or more (ties: the one that begins first): the group's columns,
    ``head`` (its first entry), ``occurrences``, ``first_seen`` and ``last_seen``.

    Entries are taken in the order of their ids, which are unique: one that no cluster has heads a new one, and later ones whose
    cosine with it reaches ``least`` join it.
    """
    with Rounds(entries.sparkSession, "clusters") as rounds:
        held = rounds.table(classes(entries, group, id_, text, when))
        joined = led(rounds.table(_bags(held)), least, rounds)
        members = held.join(joined, "id", "left").withColumn("head", F.coalesce("head", "id"))
        sizes = members.groupBy("group", "head").agg(F.sum("n").alias("occurrences"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))
        most = F.min_by(F.struct("head", "occurrences", "first_seen", "last_seen"), F.struct(-F.col("occurrences"), "head"))
        found = rounds.keep(rounds.table(sizes.where(F.col("occurrences") >= min_size).groupBy("group").agg(most.alias("most"))))
    return found.select("group.*", "most.*")
