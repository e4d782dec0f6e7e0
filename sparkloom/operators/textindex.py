"""A stored text index that is refreshed: postings in blocks, segments merged by size, ranked reads of the terms asked for.

A segment is a table of blocks: a term, documents and how often they have it, up to about ``BLOCK`` of them, so that a frequent
term is many rows.  Blocks are sorted by term, and a search reads those of its terms only, by the statistics of the files.  A
refresh writes what is new, changed or gone as one segment; the log of documents says which segment holds each, so that
older postings of a document no longer count.  ``FANOUT`` segments of like size become one.

The score is BM25 over the documents that are there now: refreshed in any steps, the index answers as one built at once.

Defined results: documents without words are there, with length 0; null texts are empty; of a document that comes twice in a
refresh one version is taken, the greatest text; terms that no document has score nothing; documents without a term asked for are no results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..sources.scratch import Rounds
from ..sources.states import StateTable

BLOCK = 1024
FANOUT = 4
#: Words that a task groups at once, about, and tasks whose pieces of blocks meet.
PIECE_ROWS = 2_000_000
GATHER = 16
#: Queries whose weights and scores a task holds at once, and documents of a product.
QUERIES, DOCS = 256, 512
K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _pieces(rows: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
    """The postings (doc, term, tf) of whole documents as pieces of blocks: term, docs and tfs."""
    docs, terms = (rows[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("doc", "term"))
    code = terms.indices.to_numpy().astype(np.int64) * len(docs.dictionary) + docs.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    tf = np.add.reduceat(rows["tf"].to_numpy()[order], first)
    term, doc = np.divmod(code[order][first], len(docs.dictionary))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff([*starts, len(term)])
    # A piece begins with a term and after each ``block`` of its postings.
    begins = np.flatnonzero((np.arange(len(term)) - np.repeat(starts, sizes)) % block == 0)
    cuts = pa.array([*begins, len(term)], pa.int32())
    made = [terms.dictionary.take(pa.array(term[begins])), pa.ListArray.from_arrays(cuts, docs.dictionary.take(pa.array(doc))), pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int64()))]
    yield from pa.Table.from_arrays(made, ["term", "docs", "tfs"]).to_batches(max_chunksize=10_000)


def _rounded(x: np.ndarray) -> np.ndarray:
    """As ``half_up`` to six places."""
    return np.floor(np.rint(x * 1e9) / 1e9 * 1e6 + 0.5) / 1e6


def _scored(batch: pa.RecordBatch, weights: np.ndarray, mean: float) -> np.ndarray:
    """Scores of the documents (length, codes and tfs of terms) by queries; ``weights``: of each term in each query, 0 or over."""
    length, codes, tfs = batch["length"].to_numpy(), batch["codes"], batch["tfs"]
    row = np.repeat(np.arange(len(batch)), np.diff(codes.offsets.to_numpy()))
    tf, norm = tfs.flatten().to_numpy().astype(float), K1 * (1 - B + B * length / mean)
    terms, at = np.unique(codes.flatten().to_numpy(), return_inverse=True)
    gains = np.zeros((len(batch), len(terms)))
    gains[row, at] = tf * (K1 + 1) / (tf + norm[row])
    return gains @ weights[terms]


class TextIndex:
    """An index at ``path``.  ``stem``: what makes terms of words (a column expression), the same for every refresh and search."""

    def __init__(self, spark: SparkSession, path: str, stem: Callable[[Column], Column] | None = None, buckets: int = 16) -> None:
        self.spark, self.path, self.stem = spark, path.rstrip("/"), stem or (lambda word: word)
        #: doc, segment (-1: gone) and length of every document
        self.documents = StateTable(spark, f"{self.path}/documents", ["doc"], buckets)
        #: segment and postings of every segment
        self.segments = StateTable(spark, f"{self.path}/segments", ["segment"], 1)

    def refresh(self, changed: DataFrame, id_: str, text: str, gone: DataFrame | None = None) -> None:
        """Brings in new and changed documents, and takes out those of ``gone`` (``id_``)."""
        number = self.segments.batch + 1
        docs = changed.groupBy(F.col(id_).alias("doc")).agg(F.max(text).alias("text"))
        terms = docs.select("doc", F.explode(words(F.col("text"))).alias("word"))
        self._write(terms.select("doc", self.stem(F.col("word")).alias("term"), F.lit(1).cast("long").alias("tf")), number)
        held = self._blocks(number)
        lengths = held.select(F.explode(F.arrays_zip("docs", "tfs")).alias("p")).groupBy(F.col("p.docs").alias("doc")).agg(F.sum("p.tfs").alias("length"))
        rows = docs.select("doc").join(lengths, "doc", "left").select("doc", F.lit(number).cast("long").alias("segment"), F.coalesce("length", F.lit(0)).cast("long").alias("length"))
        if gone is not None:
            out = gone.select(F.col(id_).alias("doc")).distinct().join(docs.select("doc"), "doc", "left_anti")
            rows = rows.unionByName(out.select("doc", F.lit(-1).cast("long").alias("segment"), F.lit(0).cast("long").alias("length")))
        # A document's entry is that of its last refresh; those that are gone come with the new number only to be left out.
        stamped = rows.withColumn("at", F.lit(number).cast("long"))
        self.documents.merge(stamped, lambda r: r.groupBy("doc").agg(F.max_by(F.struct("segment", "length", "at"), "at").alias("e")).select("doc", "e.*"), number)
        size = held.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).cast("long").alias("postings")).withColumn("segment", F.lit(number).cast("long"))
        self.segments.merge(size.select("segment", "postings"), lambda r: r.groupBy("segment").agg(F.max("postings").alias("postings")), number)
        self._merge_segments()

    def _write(self, postings: DataFrame, number: int) -> None:
        """Blocks of (doc, term, tf) as the segment ``number``; what a document has of a term is summed, its rows stand together.

        A task makes pieces of blocks where the postings are; pieces that aren't full meet by term, those of ``GATHER`` tasks in
        one group, so that neither rows nor groups grow with the documents.
        """
        kind, block, most = postings.schema["doc"].dataType.simpleString(), BLOCK, PIECE_ROWS
        lists = f"docs array<{kind}>, tfs array<bigint>"

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= most:
                    # Up to where the last document begins, which may go on.
                    rows = pa.Table.from_batches(held).combine_chunks()
                    codes = rows["doc"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                    end = int((np.flatnonzero(codes != codes[-1])[-1:] + 1).sum())
                    if end:
                        yield from _pieces(rows.slice(0, end), block)
                    held = rows.slice(end).to_batches()
                    n = len(rows) - end
            if n:
                yield from _pieces(pa.Table.from_batches(held), block)

        made = postings.select("doc", "term", "tf").mapInArrow(pieces, f"term string, {lists}")
        full = F.size("docs") >= BLOCK
        group = F.when(full, F.monotonically_increasing_id()).otherwise(-1 - F.floor(F.spark_partition_id() / GATHER))
        met = made.withColumn("block", group).groupBy("term", "block").agg(*(F.flatten(F.collect_list(F.struct("docs", "tfs"))[c]).alias(c) for c in ("docs", "tfs")))
        parts = F.explode(F.sequence(F.lit(1), F.size("docs"), F.lit(BLOCK)))
        cut = met.select("term", "docs", "tfs", parts.alias("at")).select("term", *(F.slice(c, F.col("at"), F.lit(BLOCK)).alias(c) for c in ("docs", "tfs")))
        cut.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/s={number}")

    def _blocks(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/s={number}")

    def _numbers(self) -> dict[int, int]:
        """Postings of each segment; there are few segments, as they are merged."""
        held = self.segments.read()
        return {r.segment: r.postings for r in held.collect()} if held is not None else {}

    def _live(self, segments: list[int], of: Callable[[DataFrame], DataFrame] = lambda b: b) -> DataFrame:
        """term, doc, tf, segment and length of the postings that count."""
        out = None
        for s in segments:
            rows = of(self._blocks(s)).select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("p")).select("term", F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.lit(s).cast("long").alias("segment"))
            out = rows if out is None else out.unionByName(rows)
        # By document alone, which has one entry: scores of a document are then summed where its postings are.
        held = self.documents.read().select("doc", F.col("segment").alias("now"), "length")
        return out.join(held, "doc").where("segment = now").drop("now")

    def _merge_segments(self) -> None:
        """Where ``FANOUT`` segments are of one size class, they become one; their documents are said to be in it."""
        sizes = self._numbers()
        tiers: dict[int, list[int]] = {}
        for s, n in sizes.items():
            tiers.setdefault(0 if n < BLOCK else (n // BLOCK).bit_length() // 2 + 1, []).append(s)
        for tier in sorted(tiers):
            if len(tiers[tier]) >= FANOUT:
                old, number = sorted(tiers[tier]), self.segments.batch + 1
                self._write(self._live(old).select("doc", "term", "tf").repartition("doc").sortWithinPartitions("doc"), number)
                moved = self.documents.read().withColumn("segment", F.when(F.col("segment").isin(old), number).otherwise(F.col("segment")))
                self.documents.replace(moved.where("segment >= 0"), number, 0)
                postings = self._blocks(number).agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).cast("long").alias("postings")).withColumn("segment", F.lit(number).cast("long"))
                self.segments.replace(self.segments.read().where(~F.col("segment").isin(old)).unionByName(postings.select("segment", "postings")), number, 0)
                return self._merge_segments()
        return None

    def best(self, asked: DataFrame, k: int, rounds: Rounds) -> DataFrame:
        """``query``, ``doc``, ``score`` and ``rank`` of the ``k`` best documents of each query (ties: the lesser doc), for queries of any
        number of words.  ``asked`` as in ``search``; what documents have of its terms is written to ``rounds``.

        A document's terms come together once; a task makes its scores by products of matrices and gives ``k`` rows a query, so that
        pairs of a query and a document are neither shuffled nor written.
        """
        terms = asked.select("query", self.stem(F.lower("word")).alias("term")).where("term is not null").distinct()
        pairs = terms.collect()  # what was typed
        names, kind = sorted({r.term for r in pairs}), asked.schema["query"].dataType.simpleString()
        segments, docs = sorted(self._numbers()), self.documents.read()
        if docs is None or not segments or not names:
            return self.spark.createDataFrame([], f"query {kind}, doc bigint, score double, rank bigint")
        codes = F.broadcast(self.spark.createDataFrame(list(enumerate(names)), "code int, term string"))
        found = self._live(segments, lambda b: b.join(codes, "term").select(F.col("code").alias("term"), "docs", "tfs"))
        lists = F.collect_list(F.struct("term", "tf"))
        held = rounds.table(found.groupBy("doc", "length").agg(lists.alias("l")).select("doc", "length", F.col("l.term").alias("codes"), F.col("l.tf").alias("tfs")))
        whole = docs.where("segment >= 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).first()
        df = np.zeros(len(names))
        for r in held.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # one a term asked for
            df[r.code] = r["count"]
        idf = np.maximum(1e-6, np.log((whole.docs - df + 0.5) / (df + 0.5)))
        queries, place = sorted({r["query"] for r in pairs if r["query"] is not None}), {t: i for i, t in enumerate(names)}
        if any(r["query"] is None for r in pairs):
            queries.append(None)
        number = {q: i for i, q in enumerate(queries)}
        sets: list[list[tuple[int, int]]] = [[] for _ in range(0, len(queries), QUERIES)]
        for r in pairs:
            sets[number[r["query"]] // QUERIES].append((place[r.term], number[r["query"]] % QUERIES))
        sent, n, most, mean = self.spark.sparkContext.broadcast([np.array(x, dtype=np.int64) for x in sets]), len(queries), DOCS, whole.mean
        doc_kind = held.schema["doc"].dataType.simpleString()

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops: list[tuple[np.ndarray, list]] = [(np.zeros(0), []) for _ in range(n)]
            for batch in batches:
                for part in (batch.slice(i, most) for i in range(0, len(batch), most)):
                    ids = part["doc"].to_pylist()
                    for begin, pairs_ in zip(range(0, n, QUERIES), sent.value):
                        weights = np.zeros((len(idf), min(QUERIES, n - begin)))
                        weights[pairs_[:, 0], pairs_[:, 1]] = idf[pairs_[:, 0]]
                        exact = _scored(part, weights, mean).T
                        for j, (raw, got) in enumerate(zip(exact, _rounded(exact))):
                            held_scores, held_ids = tops[begin + j]
                            hit = np.flatnonzero(raw > 0)
                            if len(held_ids) == k:
                                hit = hit[got[hit] >= held_scores[-1]]
                            elif len(hit) > k:
                                hit = hit[got[hit] >= np.partition(got[hit], -k)[-k]]
                            if len(hit):
                                best = sorted([*zip(-held_scores, held_ids), *((-got[i], ids[i]) for i in hit)])[:k]
                                tops[begin + j] = (np.array([-s for s, _ in best]), [d for _, d in best])
            rows = [(q, d, s) for q, (of, ids) in enumerate(tops) for s, d in zip(of.tolist(), ids)]
            if rows:
                q, d, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, batch.schema.field("doc").type), pa.array(s, pa.float64())], ["number", "doc", "score"])

        made = held.mapInArrow(scores, f"number bigint, doc {doc_kind}, score double")
        order = Window.partitionBy("number").orderBy(F.desc("score"), "doc")
        ranked = made.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
        named = F.broadcast(self.spark.createDataFrame([(i, q) for i, q in enumerate(queries)], f"number bigint, query {kind}"))
        return ranked.join(named, "number").select("query", "doc", "score", "rank")

    def search(self, asked: DataFrame) -> DataFrame:
        """``query``, ``doc`` and ``score`` (six places) of every document that has a term asked for.  ``asked``: query and word, few rows."""
        terms = asked.select("query", self.stem(F.lower("word")).alias("term")).distinct()
        names = [r.term for r in terms.select("term").distinct().collect()]  # what was typed
        segments = sorted(self._numbers())
        docs = self.documents.read()
        if docs is None or not segments or not names:
            return self.spark.createDataFrame([], f"query {asked.schema['query'].dataType.simpleString()}, doc bigint, score double")
        found = self._live(segments, lambda b: b.where(F.col("term").isin(names)))
        whole = docs.where("segment >= 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
        df = found.groupBy("term").agg(F.count("*").alias("df"))
        met = found.join(F.broadcast(df), "term").join(F.broadcast(whole)).join(F.broadcast(terms), "term")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return met.groupBy("query", "doc").agg(half_up(F.sum(score), 6).alias("score"))
