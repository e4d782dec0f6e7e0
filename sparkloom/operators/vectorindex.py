"""A stored index of vectors for nearest neighbours by cosine: inverted lists of k-means with product codes.

Every vector stands in the list of its nearest centre, and what it differs from the centre by is stored as one byte a
subspace.  The index is a Parquet table sorted by list; its rows are
blocks of up to ``BLOCK`` vectors, so that a list which holds a third of all vectors is many rows, not one group.

A block also holds its vectors.  A search deals the lists to few parts of bounded size, lists that are near one another to the same
one, and sends a query once to each part that holds a list it probes, not once to each list.  A part with many queries is sliced:
each slice, one task, gets the part's blocks and a share of its queries.  It picks candidates of each large block by tables of
partial distances and compares them by all their values, as it does all of a small block; only the best few of a query leave it.  So what is shuffled are the
queries times the parts and the blocks times the slices, both about constant.  Queries are rows, too: nothing but the centres and
the codebooks, whose size is a parameter, and one row a part is sent around.

``search`` is approximate.  ``exact_search`` takes its answer as a bound.  Blocks of queries, in the order of lists, and blocks of
vectors are read in pairs from their tables, without a shuffle; pairs are left out whose list no query of the block can reach by
the triangle inequality, and of the others only what reaches the bound leaves the task, ``k`` of a query and block at most.  So the
comparisons may grow with the square of the rows, but neither disk nor memory does.

Centres and codebooks are fitted on ``SAMPLE`` vectors at most, those with the least hashes of their ids.  How many lists a search
probes is learned from them, too: so many that they hold ``HELD_NEAR`` of the neighbours within the sample.

Defined results: similarities are rounded to six places, ties go to the smaller id; a vector is no neighbour of itself (of
rows with its id); vectors that are null, of another size than the first ones, or without length are similar to nothing and
are neither indexed nor asked; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import Rounds

SAMPLE = 20_000
#: Most lists, and bytes of a code (also the number of subspaces).
LISTS = 4096
CODE_BYTES = 16
BLOCK = 4096
QUERY_BLOCK = 256
#: Parts of a search at least, and bytes of a part's vectors as doubles, about.
PARTS = 5
PART_BYTES = 64 << 20
#: Tasks of a search, about, as long as none gets more than ``SLICE`` queries, and queries that are answered at once.
TASKS = 24
SLICE = 1 << 18
HELD = 4096
#: Queries that an exact search compares with a block at once.
EXACT_BLOCK = 1024
#: Of a pair of blocks, the part of all pairs from which on they are compared whole.
MANY = 32
ROUNDS = 15
#: Share of a sample's neighbours that the probed lists hold, the number of neighbours, and of vectors that they are sought for.
HELD_NEAR = 0.95
NEAR = 5
ASKED = 256
#: Blocks of up to so many times the candidates are compared whole, as one product of matrices costs less than the tables.
WHOLE = 16
_SLACK = 2e-6


@dataclass
class Model:
    """Centres of the lists, and for each subspace its codewords."""

    centres: np.ndarray
    codebooks: np.ndarray
    size: int
    #: Lists that a search looks at.
    probes: int = 16

    def lists(self, unit: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` lists whose centres are nearest, nearest first."""
        far = _squared(unit, self.centres)
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def encode(self, rest: np.ndarray) -> np.ndarray:
        """Codes of differences from centres."""
        parts = _split(rest, len(self.codebooks))
        return np.stack([_squared(parts[:, s], book).argmin(axis=1) for s, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def distances(self, unit: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """From each query to each coded vector of a list, by sums over tables of partial distances."""
        parts = _split(unit - self.centres[list_], len(self.codebooks))
        out = np.zeros((len(unit), len(codes)))
        for s, book in enumerate(self.codebooks):
            out += _squared(parts[:, s], book)[:, codes[:, s]]
        return np.sqrt(np.maximum(out, 0.0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :], 0.0)


def _split(x: np.ndarray, n: int) -> np.ndarray:
    """Rows as ``n`` subspaces each; zeros fill them up."""
    width = -(-x.shape[1] // n)
    return np.pad(x, ((0, 0), (0, n * width - x.shape[1]))).reshape(len(x), n, width)


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spread first rows; an empty one is put where a row is farthest off."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        far = _squared(rows, centres)
        near = far.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=k)
        after = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for empty, worst in zip(np.flatnonzero(n == 0), np.argsort(-far.min(axis=1), kind="stable")):
            after[empty] = rows[worst]
        if np.allclose(after, centres):
            break
        centres = after
    return centres


def _usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """``id`` and ``v``: vectors without nulls, infinities and zero length; floats stay floats."""
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where(length.isNotNull() & ~F.isnan(length) & (length > 0) & (length < float("inf")))


def _unit(column: pd.Series, size: int) -> np.ndarray:
    m = np.array(column.tolist(), dtype=float).reshape(-1, size)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit(vectors: DataFrame, id_: str, vector: str, lists: int | None = None, code_bytes: int = CODE_BYTES, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample; by default about the square root of the rows' number of lists, ``LISTS`` at most."""
    rows = _usable(vectors, id_, vector)
    total = rows.count()
    # About twice the sample by hash, so that the exact choice sorts few rows.
    part = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 2.0 * sample / max(1, total)) * (1 << 30)))) if total > 2 * sample else rows
    got = part.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(got):
        return Model(np.zeros((1, 1)), np.zeros((1, 1, 1)), 1)
    size = int(got["v"].map(len).mode()[0])
    unit = _unit(got["v"][got["v"].map(len) == size], size)
    centres = k_means(unit, min(lists or max(1, min(LISTS, round(total**0.5))), len(unit)))
    rest = _split(unit - centres[_squared(unit, centres).argmin(axis=1)], min(code_bytes, size))
    books = np.stack([k_means(rest[:, s], min(256, len(unit))) for s in range(rest.shape[1])])
    return Model(centres, books, size, _probes(unit, centres))


def _probes(unit: np.ndarray, centres: np.ndarray) -> int:
    """How many of the nearest lists hold ``HELD_NEAR`` of the neighbours that ``ASKED`` vectors have in the sample; 16 at least."""
    of = np.unique(np.linspace(0, len(unit) - 1, ASKED).astype(int))
    similar = unit[of] @ unit.T
    similar[np.arange(len(of)), of] = -2.0
    near = np.argsort(-similar, axis=1, kind="stable")[:, : min(NEAR, len(unit) - 1)]
    rank = _squared(unit[of], centres).argsort(axis=1, kind="stable").argsort(axis=1)
    home = _squared(unit, centres).argmin(axis=1)
    return max(16, 1 + int(np.quantile(np.take_along_axis(rank, home[near], axis=1), HELD_NEAR, method="higher"))) if near.size else 16


def build(vectors: DataFrame, id_: str, vector: str, model: Model, path: str) -> DataFrame:
    """Writes the index to ``path``: list, ids (ascending), codes, vectors and radius (farthest from the centre) of each block, sorted by list.  Every usable vector is in it."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = vectors.schema[id_].dataType.simpleString()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            frame = frame[frame["v"].map(len) == m.size]
            if len(frame):
                unit = _unit(frame["v"], m.size)
                near = m.lists(unit)[:, 0]
                codes = m.encode(unit - m.centres[near])
                yield pd.DataFrame({"list": near, "id": frame["id"], "code": [c.tobytes() for c in codes], "vector": [np.asarray(v).tobytes() for v in frame["v"]], "off": np.linalg.norm(unit - m.centres[near], axis=1)})

    placed = _usable(vectors, id_, vector).mapInPandas(place, f"list int, id {kind}, code binary, vector binary, off double")
    # Blocks are cut inside tasks from rows in the order of lists; a large list is in many tasks' ranges.
    ranged = placed.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            of = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                for c in range(a, b, BLOCK):
                    part = batch.slice(c, min(BLOCK, b - c))
                    if held and (of[a] != now or sum(map(len, held)) + len(part) > BLOCK):
                        yield _block(now, held)
                        held = []
                    now = of[a]
                    held.append(part)
        if held:
            yield _block(now, held)

    blocks = ranged.mapInArrow(cut, f"list int, ids array<{kind}>, codes binary, vectors binary, radius double")
    blocks.write.parquet(path)
    return opened(spark, path)


def _block(list_: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(1))
    codes, vectors = (b"".join(rows.column(i).to_pylist()) for i in (2, 3))
    return pa.RecordBatch.from_arrays(
        [pa.array([list_], pa.int32()), ids, pa.array([codes], pa.binary()), pa.array([vectors], pa.binary()), pa.array([float(rows.column(4).to_numpy().max())])],
        ["list", "ids", "codes", "vectors", "radius"],
    )


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _floats(held: bytes | pa.Buffer, n: int, size: int) -> np.ndarray:
    """``n`` stored vectors, floats or doubles, as doubles."""
    return np.frombuffer(held, "<f4" if len(held) == 4 * n * size else "<f8").reshape(n, size).astype(float)


def _similarity(dots: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Cosines of dot products and products of squared lengths; rounded as by ``half_up``, to six places."""
    return np.floor(np.rint(dots / np.sqrt(squares) * 1e9) / 1e9 * 1e6 + 0.5) / 1e6


def _best(similarity: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest of each row that reach ``least``; ties go to the smaller column."""
    bound = least if similarity.shape[1] <= k else np.maximum(least, np.partition(similarity, -k, axis=1)[:, -k])
    q, at = np.nonzero(similarity >= bound[:, None])
    order = np.lexsort((at, -similarity[q, at], q))
    q, at = q[order], at[order]
    begins = np.searchsorted(q, np.arange(len(similarity)))
    few = np.arange(len(q)) - begins[q] < k
    return q[few], at[few]


def _reaching(x: np.ndarray, y: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``x``, row of ``y`` and similarity of the ``k`` most similar of each row of ``x`` that reach ``least``; ties go to the smaller row of ``y``.

    Products in single precision, less their greatest error, tell which pairs may reach it; only these are compared in full, or
    whole blocks where these are many.
    """
    of_x, of_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
    cosine = (x / np.sqrt(of_x)[:, None]).astype(np.float32) @ (y / np.sqrt(of_y)[:, None]).astype(np.float32).T
    met = cosine >= (least - (x.shape[1] + 8) * 1.2e-7).astype(np.float32)[:, None]
    if np.count_nonzero(met) > met.size // MANY:
        similarity = _similarity(x @ y.T, of_x[:, None] * of_y)
        q, at = _best(similarity, k, least)
        return q, at, similarity[q, at]
    q, at = np.nonzero(met)
    similarity = _similarity((x[q] * y[at]).sum(axis=1), of_x[q] * of_y[at])
    reach = similarity >= least[q]
    q, at, similarity = q[reach], at[reach], similarity[reach]
    order = np.lexsort((at, -similarity, q))
    q, at, similarity = q[order], at[order], similarity[order]
    few = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[few], at[few], similarity[few]


def _found(names: pa.Array, ids: pa.Array, q: np.ndarray, at: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(at)), pa.array(similarity)], ["query", "id", "similarity"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.where(~F.col("query").eqNullSafe(F.col("id"))).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _parts(centres: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each list: lists are halved between two means until ``n`` parts have about as many rows.

    A list of more rows has several parts, over which its blocks are dealt; a list without rows has none.
    """
    first, shares = np.zeros(len(rows), int), np.zeros(len(rows), int)
    todo, begin = [(np.flatnonzero(rows), n)], 0
    while todo:
        at, n = todo.pop()
        if n == 1 or len(at) < 2:
            first[at], shares[at] = begin, n
            begin += n
            continue
        one, two = k_means(centres[at], 2)
        at = at[np.argsort(centres[at] @ (two - one), kind="stable")]
        sums = np.cumsum(rows[at])
        cut = 1 + int(np.abs(sums[:-1] - sums[-1] / 2).argmin())
        left = int(np.clip(np.rint(n * sums[cut - 1] / sums[-1]), 1, n - 1))
        todo += [(at[:cut], left), (at[cut:], n - left)]
    return first, shares


def _met(lists: np.ndarray, first: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, row and list of each probe (``lists``: a row each) and part of its list."""
    row, probed = np.repeat(np.arange(len(lists)), lists.shape[1]), lists.ravel()
    n = shares[probed]
    part = np.repeat(first[probed] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return part, np.repeat(row, n), np.repeat(probed, n)


def search(index: DataFrame, model: Model, vectors: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, probes: int | None = None, keep: int | None = None) -> DataFrame:
    """``query``, ``id``, ``similarity`` and ``rank``: of each row of ``queries`` about the ``k`` most similar of the indexed ``vectors``; ids are unique.

    ``probes``: lists looked at (by default as many as the model's sample asks for); ``keep``: candidates of a query in a block that are compared exactly (ten times k by default).
    """
    kind, keep = vectors.schema[id_].dataType.simpleString(), keep or 10 * (k + 1)
    probes = probes or model.probes
    spark, asked, size = index.sparkSession, _usable(queries, id_, vector), model.size
    held = index.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).toPandas()  # one row a list
    rows = np.zeros(len(model.centres), int)
    rows[held["list"].to_numpy()] = held["n"].to_numpy()
    parts = max(PARTS, -(-int(rows.sum()) * 8 * size // PART_BYTES))
    first, shares = _parts(model.centres, rows, parts)
    shared = spark.sparkContext.broadcast(model)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        m = shared.value
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), size))
            if len(batch):
                raw = batch.column("v").flatten().to_numpy().reshape(-1, size)
                unit = raw.astype(float)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                lists = m.lists(unit, probes)
                # How far the last list is tells a task which ones are probed.
                yield batch, raw, lists, ((unit - m.centres[lists[:, -1]]) ** 2).sum(axis=1) + 1e-9

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, lists, _ in probed(batches):
            part, row, of = _met(lists, first, shares)
            n = np.bincount(np.unique(part * len(lists) + row) // len(lists), minlength=parts)
            work = np.bincount(part, (rows / np.maximum(shares, 1))[of], minlength=parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array(n), pa.array(work)], ["part", "n", "work"])

    of_part = asked.select("v").mapInArrow(count, "part long, n long, work double").groupBy("part").agg(F.sum("n").alias("n"), F.sum("work").alias("work")).toPandas()  # one row a part
    slices = np.ones(parts, int)
    if len(of_part):
        share = of_part["work"] / max(1.0, of_part["work"].sum())
        slices[of_part["part"].to_numpy()] = np.maximum(1, np.maximum(np.ceil(of_part["n"] / SLICE), np.rint(TASKS * share)))
    begin = np.cumsum(slices) - slices

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, lists, reach in probed(batches):
            part, row, _ = _met(lists, first, shares)
            part, row = np.divmod(np.unique(part * len(lists) + row), len(lists))
            task = begin[part] + batch.column("dealt").to_numpy()[row] % slices[part]
            order = np.argsort(task, kind="stable")
            task, row = task[order], row[order]
            edges = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for a, b in zip(edges, edges[1:]):
                for at in (row[c : min(b, c + QUERY_BLOCK)] for c in range(a, b, QUERY_BLOCK)):
                    ids = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column("id").take(pa.array(at)))
                    codes, held = (pa.array([x.tobytes()], pa.binary()) for x in (reach[at], raw[at]))
                    yield pa.RecordBatch.from_arrays([pa.array([task[a]], pa.int32()), pa.nulls(1, pa.int32()), ids, codes, held], ["task", "list", "ids", "codes", "vectors"])

    def answer(blocks: list[dict], asked: list[dict]) -> pa.RecordBatch:
        m = shared.value
        names, ids = (pa.concat_arrays([one["ids"] for one in of]) for of in (asked, blocks))
        raw = np.concatenate([_floats(one["vectors"], len(one["ids"]), size) for one in asked])
        reach = np.concatenate([np.frombuffer(one["codes"]) for one in asked])
        place = np.empty(len(ids), int)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))

        def first(q: np.ndarray, at: np.ndarray, similarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The ``k`` and one best of each query, as it may meet itself; from now on no less is looked at."""
            order = np.lexsort((place[at], -similarity, q))
            rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            last = order[rank == k]
            least[q[last]] = np.maximum(least[q[last]], similarity[last])
            order = order[rank <= k]
            return q[order], at[order], similarity[order]

        least, lengths = np.full(len(raw), -2.0), (raw * raw).sum(axis=1)
        probed = _squared(raw / np.sqrt(lengths)[:, None], m.centres[[one["list"] for one in blocks]]) <= reach[:, None]
        got, start = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0
        for one, of_block in zip(blocks, probed.T):
            n = len(one["ids"])
            mine = np.flatnonzero(of_block)
            codes, held = np.frombuffer(one["codes"], np.uint8).reshape(n, -1), _floats(one["vectors"], n, size)
            squares = (held * held).sum(axis=1)
            for of in (mine[c : c + QUERY_BLOCK] for c in range(0, len(mine), QUERY_BLOCK)):
                v = raw[of]
                if n <= WHOLE * keep:
                    near, dots = None, v @ held.T
                    cosine = dots / np.sqrt(lengths[of])[:, None] / np.sqrt(squares)
                else:
                    far = m.distances(v / np.sqrt(lengths[of])[:, None], one["list"], codes)
                    near = np.argpartition(far, keep - 1, axis=1)[:, :keep]
                    dots = np.stack([held[at] @ x for at, x in zip(near, v)])
                    cosine = dots / np.sqrt(lengths[of][:, None] * squares[near])
                bound = least[of] - _SLACK
                many = np.flatnonzero((cosine >= bound[:, None]).sum(axis=1) > k + 1)
                if len(many):
                    bound[many] = np.maximum(bound[many], np.partition(cosine[many], -k - 1, axis=1)[:, -k - 1] - _SLACK)
                q, at = np.nonzero(cosine >= bound[:, None])
                row = at if near is None else near[q, at]
                got.append(first(of[q], start + row, _similarity(dots[q, at], lengths[of[q]] * squares[row])))
            start += n
            if sum(len(x[0]) for x in got) > 16 * (k + 1) * len(raw):
                got = [first(*(np.concatenate(x) for x in zip(*got)))]
        q, at, similarity = first(*(np.concatenate(x) for x in zip(*got)))
        order = np.arange(len(q))
        order = order[~pc.equal(names.take(pa.array(q[order])), ids.take(pa.array(at[order]))).fill_null(False).to_numpy(zero_copy_only=False)]
        few = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
        return _found(names, ids, q[few], at[few], similarity[few])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, asked = None, [], []
        for batch in batches:
            for row in range(batch.num_rows):
                task, list_, ids, codes, vectors = (column[row] for column in batch.columns)
                one = {"list": list_.as_py(), "ids": ids.values, "codes": codes.as_buffer(), "vectors": vectors.as_buffer()}
                if asked and (task.as_py() != now or sum(len(x["ids"]) for x in asked) >= HELD):
                    yield answer(blocks, asked)
                    asked = []
                if task.as_py() != now:
                    now, blocks = task.as_py(), []
                if one["list"] is not None:
                    blocks.append(one)
                elif blocks:
                    asked.append(one)
        if asked:
            yield answer(blocks, asked)

    # The tasks of each list's blocks, by the block's part.
    tasks = [[np.arange(begin[p], begin[p] + slices[p]).tolist() for p in range(first[x], first[x] + shares[x])] for x in np.flatnonzero(rows)]
    to = spark.createDataFrame(list(zip(np.flatnonzero(rows).tolist(), tasks)), "list int, parts array<array<int>>")
    dealt = index.join(F.broadcast(to), "list").withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), F.size("parts")).cast("int"))
    blocks = dealt.select(F.explode(F.col("parts")[F.col("part")]).alias("task"), "list", "ids", "codes", "vectors")
    pieces = asked.withColumn("dealt", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).mapInArrow(deal, f"task int, list int, ids array<{kind}>, codes binary, vectors binary")
    # Blocks come before queries, so that a task holds its blocks only.
    met = blocks.unionByName(pieces).repartitionById(int(slices.sum()), "task").sortWithinPartitions("task", F.col("list").isNull())
    return _ranked(met.mapInArrow(compare, f"query {kind}, id {kind}, similarity double"), k)


def exact_search(index: DataFrame, model: Model, vectors: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, probes: int = 16, rounds: Rounds | None = None) -> DataFrame:
    """As ``search``, but the ``k`` most similar themselves.  The queries' blocks are written to ``rounds``, or stay in the shared folder."""
    kind = vectors.schema[id_].dataType.simpleString()
    spark, asked = index.sparkSession, _usable(queries, id_, vector)
    first = search(index, model, vectors, queries, id_, vector, k, probes)
    bound = first.where(F.col("rank") == k).select(F.col("query").alias("id"), (F.col("similarity") - _SLACK).alias("bound"))
    bounded = asked.join(bound, "id", "left").select("id", "v", F.coalesce("bound", F.lit(-1.0 - _SLACK)).alias("least"))
    radii = index.groupBy("list").agg(F.max("radius").alias("radius")).toPandas()  # one row a list
    radius = np.full(len(model.centres), -1.0)
    radius[radii["list"].to_numpy()] = radii["radius"].to_numpy()
    shared = spark.sparkContext.broadcast((model, radius))
    size = model.size

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, radius = shared.value
        for frame in frames:
            frame = frame[frame["v"].map(len) == m.size]
            if len(frame):
                far = np.sqrt(_squared(_unit(frame["v"], m.size), m.centres))
                closest = np.maximum(far - radius - 1e-6, 0.0)
                reached = (1.0 - closest * closest / 2.0 >= frame["least"].to_numpy()[:, None]) & (radius >= 0)
                yield pd.DataFrame({"id": frame["id"], "near": far.argmin(axis=1), "least": frame["least"], "vector": [np.asarray(v, float).tobytes() for v in frame["v"]], "reached": [np.packbits(r).tobytes() for r in reached]})

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for frame in frames:
            held = pd.concat([held, frame]) if len(held) else frame
            while len(held) >= EXACT_BLOCK:
                yield joined(held[:EXACT_BLOCK])
                held = held[EXACT_BLOCK:]
        if len(held):
            yield joined(held)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        lists = np.bitwise_or.reduce([np.frombuffer(r, np.uint8) for r in rows["reached"]])
        return pd.DataFrame({"names": [rows["id"].tolist()], "q": [b"".join(rows["vector"])], "least": [rows["least"].to_numpy().tobytes()], "lists": [np.flatnonzero(np.unpackbits(lists)).tolist()]})

    placed = bounded.mapInPandas(place, f"id {kind}, near int, least double, vector binary, reached binary")
    # About a block a partition, so that the pairs are dealt to many tasks.
    ranged = placed.repartitionByRange(max(1, -(-asked.count() // EXACT_BLOCK)), "near", F.xxhash64("id")).sortWithinPartitions("near")
    rounds = rounds or Rounds(spark, "asked")
    blocks = rounds.table(ranged.mapInPandas(block, f"names array<{kind}>, q binary, least binary, lists array<int>"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
                ids, names = one["ids"].values, one["names"].values
                raw, held = _floats(one["q"].as_buffer(), len(names), size), _floats(one["vectors"].as_buffer(), len(ids), size)
                yield _found(names, ids, *_reaching(raw, held, k + 1, np.frombuffer(one["least"].as_buffer())))

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[int, pa.Array, np.ndarray]] = []
        for batch in batches:
            for row in range(batch.num_rows):
                list_, ids, vectors = (column[row] for column in batch.columns)
                some.append((list_.as_py(), ids.values, np.frombuffer(vectors.as_buffer(), np.uint8).reshape(len(ids.values), -1)))
                if sum(len(ids) for _, ids, _ in some) >= BLOCK:
                    yield from together(some)
                    some = []
        if some:
            yield from together(some)

    def together(some: list[tuple[int, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Blocks as one, in the order of ids; those of floats and those of doubles apart."""
        for width in sorted({v.shape[1] for *_, v in some}):
            of = [one for one in some if one[2].shape[1] == width]
            ids = pa.concat_arrays([ids for _, ids, _ in of])
            order = pc.sort_indices(ids)
            held = np.concatenate([v for *_, v in of])[order.to_numpy()]
            columns = [pa.array([sorted({list_ for list_, *_ in of})], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(order)), pa.array([held.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["held", "ids", "vectors"])

    # Small lists stand together, so that a block of queries is read a few times only.
    n_held = index.agg(F.sum(F.size("ids"))).first()[0] or 0
    near = index.select("list", "ids", "vectors").repartitionByRange(max(1, -(-n_held // BLOCK)), "list").sortWithinPartitions("list")
    held = rounds.table(near.mapInArrow(coarse, f"held array<int>, ids array<{kind}>, vectors binary"))
    pairs = blocks.join(held, F.arrays_overlap("lists", "held"))
    return _ranked(pairs.select("names", "q", "least", "ids", "vectors").mapInArrow(compare, f"query {kind}, id {kind}, similarity double"), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    all_ = exact.count()
    return exact.join(found.select("query", "id"), ["query", "id"], "left_semi").count() / all_ if all_ else 1.0
