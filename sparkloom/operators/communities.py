"""Communities by modularity (Louvain): moves of single nodes while modularity grows, then the graph of communities, level by level.

Nodes are dealt by hash to parts of about ``PART_EDGES`` edges, whatever the session's partitions are.  In a round every part
sweeps over its nodes one after the other, each to the community around it whose gain is greatest, with the nodes of other parts
as the round found them; a round passes once over the edges, which tells the quality of the round before, too.  Where that does
not raise the modularity, because parts spoiled each other's moves, half of the moved nodes go; where even that does not, single
moves count from the round's begin: of a half, a node only moves if no neighbour of the half has a greater hash, so that no two
nodes next to each other move; and at last only moves that share no community with one of greater gain: their gains add up.  So
modularity grows with every round, and the result does not depend on how rows are dealt out: weights are whole thousandths, quality
is told by whole numbers, parts, halves and classes follow from hashes.

Nodes that are longs, up to ``NODES`` of them, are numbered; parts are stored once a level as arrays, and a round sends them the
communities of all nodes (four bytes each, and eight for its weight) and shuffles nothing.  A part then sweeps by ``CHUNKS``, whose nodes
decide at once, by doubles.  Other and more nodes meet their edges by joins in every round, as whole numbers.

Defined results: edges are taken without direction and summed; loops count for their node; null ends and weights that are null
or not positive leave no edge; nodes without edges are not there; ties go to the greater community label, then node.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Rounds

_BLOCK = "part int, own binary, k binary, starts binary, to binary, w binary"

#: Weights are rounded to this part.
SCALE = 1000
#: Growth of modularity in a round below which a level ends.
LEAST_GAIN = 1e-3
#: Edges of the nodes that one task sweeps over, about.
PART_EDGES = 500_000
#: Sweeps of a part in a round, where there are several parts.
SWEEPS = 3
#: Nodes whose communities are sent to all tasks, at most; chunks of a part, and sweeps of one that is alone, at most.
NODES = 10_000_000
CHUNKS = 64
MOST_SWEEPS = 20
_BIG = "decimal(38,0)"


def _undirected(edges: DataFrame) -> DataFrame:
    """a, b and w (whole) in both directions; a loop stands once, with twice its weight."""
    w = F.rint(F.col("weight") * SCALE).cast("long")
    rows = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")).where("w > 0 and a is not null and b is not null")
    ways = F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return rows.select(F.explode(ways).alias("e")).select("e.*").groupBy("a", "b").agg(F.sum("w").alias("w"))


def _sums(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """label, inside and total of each community."""
    of_a, of_b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    met = graph.join(of_a, "a").join(of_b, "b")
    return met.groupBy(F.col("label_a").alias("label")).agg(F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("total"))


def _quality(sums: DataFrame, all_: int) -> int:
    """Modularity times the square of all weights, as a whole number."""
    big = lambda c: F.col(c).cast(_BIG)
    got = sums.agg(F.sum(big("inside")).alias("i"), F.sum((big("total") * big("total")).cast(_BIG)).alias("t")).first()
    return int(got.i or 0) * all_ - int(got.t or 0)


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of communities (node, label) in an undirected weighted graph (src, dst, weight)."""
    graph = _undirected(edges)
    all_ = graph.agg(F.sum("w")).first()[0] or 0
    return _quality(_sums(graph, labels), all_) / all_**2 if all_ else 0.0


def _moves(graph: DataFrame, labels: DataFrame, sums: DataFrame, all_: int) -> DataFrame:
    """node, label, target and gain (whole, over 0): the best move of each node that has one."""
    own = graph.groupBy("a").agg(F.sum("w").alias("k")).join(labels.select(F.col("node").alias("a"), "label"), "a")
    near = graph.where("a != b").join(labels.select(F.col("node").alias("b"), F.col("label").alias("target")), "b").groupBy("a", "target").agg(F.sum("w").alias("w"))
    met = near.join(own, "a").join(sums.select(F.col("label").alias("target"), "total"), "target")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    stays = F.col("target") == F.col("label")
    worth = (big("w") * F.lit(Decimal(all_)) - F.when(stays, big("total") - big("k")).otherwise(big("total")) * big("k")).cast(_BIG)
    valued = met.withColumn("worth", worth).groupBy("a", "label", "k").agg(F.max(F.when(stays, F.col("worth"))).alias("here"), F.max(F.when(~stays, F.struct("worth", "target"))).alias("best"))
    # A node without neighbours in its community: what staying is worth follows from the total alone.
    alone = valued.join(sums.select("label", "total"), "label")
    here = F.coalesce("here", (-(big("total") - big("k")) * big("k")).cast(_BIG))
    return alone.select(F.col("a").alias("node"), "label", F.col("best.target").alias("target"), (F.col("best.worth") - here).cast(_BIG).alias("gain")).where("gain > 0")


def _half(moves: DataFrame, round_: int) -> DataFrame:
    """The moves of every other node, by a hash of this round."""
    return moves.where(F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(2)) == 0)


def _apart(graph: DataFrame, moves: DataFrame, round_: int) -> DataFrame:
    """Moves of nodes none of whose neighbours moves and has a greater hash."""
    rank = F.struct(F.xxhash64("node", F.lit(round_)).alias("hash"), "node")
    told = graph.where("a != b").join(moves.select(F.col("node").alias("a"), rank.alias("rank")), "a").groupBy(F.col("b").alias("node")).agg(F.max("rank").alias("other"))
    return moves.join(told, "node", "left").where(F.col("other").isNull() | (rank > F.col("other"))).drop("other")


def _disjoint(moves: DataFrame) -> DataFrame:
    """Moves that share neither community with a greater one."""
    rank = F.struct("gain", "node")
    touched = moves.select(rank.alias("rank"), F.explode(F.array("label", "target")).alias("c")).groupBy("c").agg(F.max("rank").alias("most"))
    most = lambda c: touched.select(F.col("c").alias(c), F.col("most").alias(f"most_{c}"))
    return moves.join(most("label"), "label").join(most("target"), "target").where((rank == F.col("most_label")) & (rank == F.col("most_target"))).select(moves.columns)


def _climb(own: list, edges: tuple[list, list], label: dict, total: dict, all_: int, parts: int) -> None:
    """Sweeps over ``own`` (node, begin and end of its ``edges``, weight), each node to where it gains most, told by whole numbers.
    ``label`` and ``total`` change; a move counts in the totals once for each of the ``parts``, as the others, dealt by hash, move
    alike at the same time.  One part goes on until no node gains; several sweep ``SWEEPS`` times a round, as what they
    know of each other grows old."""
    to, w = edges
    moved, sweep = 1, 0
    while moved and (parts == 1 or sweep < SWEEPS):
        moved, sweep = 0, sweep + 1
        for node, i, j, k in own:
            here = label[node]
            near = {here: 0}
            for n, x in zip(to[i:j], w[i:j]):
                if n != node:
                    c = label[n]
                    near[c] = near.get(c, 0) + x
            stays = near[here] * all_ - (total[here] - k) * k
            worth, best = stays, here
            for c, x in near.items():
                value = x * all_ - total[c] * k
                if c != here and (value > worth or value == worth and best != here and c > best):
                    worth, best = value, c
            if best != here:
                label[node] = best
                total[here] -= k * parts
                total[best] += k * parts
                moved += 1


def _swept(rows: pd.DataFrame, all_: int, parts: int) -> pd.DataFrame:
    """node, k and label after sweeps over the nodes ``a`` of a part, and in a row without node its share of the quality before.

    ``rows``: the edges of these nodes with label and total of ``b``, and a row of each node with itself.  Nodes of other parts
    stay as they are.
    """
    a, b = (rows[c].to_numpy() for c in "ab")
    order = np.lexsort((b, a))
    a, to, w, of, held = a[order], b[order].tolist(), rows["w"].to_numpy()[order].tolist(), rows["label"].to_numpy()[order].tolist(), rows["total"].to_numpy()[order].tolist()
    label, total = dict(zip(to, of)), dict(zip(of, held))
    edges = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
    own = [(n, i, j, sum(w[i:j])) for n, i, j in zip(a[edges[:-1]].tolist(), edges, edges[1:])]
    inside = sum(w[i] for n, i, j, _ in own for i in range(i, j) if of[i] == label[n])
    quality = inside * all_ - sum(k * total[label[n]] for n, _, _, k in own)
    _climb(own, (to, w), label, total, all_, parts)
    columns = {"node": [n for n, *_ in own], "k": [k for *_, k in own], "label": [label[n] for n, *_ in own], "share": [None] * len(own)}
    return pd.DataFrame({c: pd.Series([*v, Decimal(quality) if c == "share" else None], dtype=object) for c, v in columns.items()})


def _step(level: _Level, label: np.ndarray) -> tuple[np.ndarray, int]:
    """A pass over the edges: the labels that the parts' sweeps make of such labels, and the quality before them."""
    return level.sweep(label)


def _joined_step(rounds: Rounds, parts: DataFrame, labels: DataFrame, all_: int, n: int) -> tuple[DataFrame, int]:
    """node, k and label that the parts' sweeps make of such ``labels``, and the quality before them."""
    sums = labels.groupBy("label").agg(F.sum("k").alias("total"))
    state = rounds.table(labels.join(sums, "label").select(F.col("node").alias("b"), "label", "total"))
    kind = labels.schema["node"].dataType.simpleString()
    met = parts.join(state, "b").repartition(4 * n, "part").groupBy("part").applyInPandas(lambda rows: _swept(rows, all_, n), f"node {kind}, k bigint, label {kind}, share {_BIG}")
    swept = rounds.table(met)
    quality = swept.agg(F.sum("share")).first()[0]
    rounds.forget(state)
    return swept.where("share is null").drop("share"), int(quality or 0)


def _level(rounds: Rounds, graph: DataFrame, all_: int, least_gain: float) -> tuple[DataFrame | None, int]:
    """node and label when no round gains any more, or None if none did; and their quality."""
    n = max(1, -(-graph.count() // PART_EDGES))
    of = graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    labels = rounds.table(of.select("node", "k", F.col("node").alias("label")))
    selves = labels.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("w"))
    whole = graph.unionByName(selves).groupBy("a", "b").agg(F.sum("w").alias("w"))
    parts = rounds.table(whole.select(F.pmod(F.xxhash64("a"), F.lit(n)).cast("int").alias("part"), "a", "b", "w"))
    swept, quality = _joined_step(rounds, parts, labels, all_, n)
    moved, round_ = False, 0
    while True:
        round_ += 1
        held, offered = labels, swept
        to = offered.select("node", F.col("label").alias("target")).join(held.select("node", "label"), "node").where("label != target")
        if to.isEmpty():  # no node gains by itself
            break

        def single() -> DataFrame:
            now = held.select("node", "label")  # noqa: B023
            return rounds.table(_moves(graph, now, _sums(graph, now), all_))

        grown = False
        for chosen in (None, lambda: _half(to, round_), lambda: _apart(graph, _half(single(), round_), round_), lambda: _disjoint(single())):  # noqa: B023
            if chosen is None:
                tried = offered
            else:
                tried = rounds.table(held.join(chosen().select("node", "target"), "node", "left").select("node", "k", F.coalesce("target", "label").alias("label")))
            after, got = _joined_step(rounds, parts, tried, all_, n)
            if got > quality:
                grown = True
                break
        if not grown:
            break
        gain, quality, labels, swept, moved = (got - quality) / all_**2, got, tried, after, True
        if gain < least_gain:
            break
    rounds.forget(parts)
    return (labels.select("node", "label") if moved else None), quality


# --- the same with numbered nodes, whose communities all tasks know


def _hash(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Mixed 32 bits of numbers."""
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.int64)


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, by a and b, with the sums of w."""
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.int32), np.add.reduceat(w[order], first) if len(first) else w[:0]


def _dealt(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Edges from a to b in pieces, one a part of a."""
    part = _hash(a) % n
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(ends)):
        of = order[ends[p] : ends[p + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([v[of].astype(kind).tobytes()], pa.binary()) for v, kind in ((a, "<i4"), (b, "<i4"), (w, "<i8")))], ["part", "a", "b", "w"])


class _Level:
    """A graph with numbered nodes: blocks of edges in both directions without loops, and what each node weighs, loops included."""

    def __init__(self, rounds: Rounds, pieces: DataFrame, parts: int, nodes: int) -> None:
        """``pieces``: part, a, b and w (binary); a loop counts once."""
        self.rounds, self.parts, self.spark = rounds, parts, rounds.spark

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and held[0]["part"] != row["part"]:
                        yield made(held)
                        held = []
                    held.append(row)
            if held:
                yield made(held)

        def made(rows: list[dict]) -> pa.RecordBatch:
            a, b, w = _summed(*(np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("a", "<i4"), ("b", "<i4"), ("w", "<i8"))))
            own, at = np.unique(a, return_inverse=True)
            k = np.zeros(len(own), np.int64)
            np.add.at(k, at, w)
            plain = a != b
            starts = np.concatenate([[0], np.cumsum(np.bincount(at[plain], minlength=len(own)))])
            columns = [own.astype("<i4"), k, starts.astype("<i8"), b[plain], w[plain]]
            return pa.RecordBatch.from_arrays([pa.array([rows[0]["part"]], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["part", "own", "k", "starts", "to", "w"])

        self.blocks = rounds.table(pieces.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(block, _BLOCK))
        self.k = np.zeros(nodes, np.int64)
        for row in self.blocks.select("own", "k").toLocalIterator():
            self.k[np.frombuffer(row.own, "<i4")] = np.frombuffer(row.k, "<i8")
        self.all_ = int(self.k.sum())

    def each(self, of, sent: tuple, kind: str) -> DataFrame:  # noqa: ANN001
        """Rows (dicts) that ``of`` makes of a block (own, k, starts, to, w) and what is ``sent`` to all tasks."""
        held = self.spark.sparkContext.broadcast(sent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    block = [np.frombuffer(batch[c][i].as_buffer(), k) for c, k in (("own", "<i4"), ("k", "<i8"), ("starts", "<i8"), ("to", "<i4"), ("w", "<i8"))]
                    yield from of(*block, *held.value)

        return self.blocks.select("own", "k", "starts", "to", "w").mapInArrow(run, kind)

    def sweep(self, label: np.ndarray) -> tuple[np.ndarray, int]:
        """Labels after sweeps of all parts, and the quality before them."""
        total = np.zeros(len(label), np.int64)
        np.add.at(total, label, self.k)
        parts, all_ = self.parts, self.all_

        def of(own, k, starts, to, w, label, total):  # noqa: ANN001, ANN202
            outside = int(w[np.repeat(label[own], np.diff(starts)) != label[to]].sum())
            now = _sweeps(own, k, starts, to, w, label.copy(), total.astype(float), all_, parts)
            moved = own[now != label[own]]
            yield pa.RecordBatch.from_arrays([pa.array([moved.tobytes()], pa.binary()), pa.array([now[now != label[own]].astype("<i4").tobytes()], pa.binary()), pa.array([outside])], ["node", "label", "outside"])

        after, outside = label.copy(), 0
        for row in self.each(of, (label, total), "node binary, label binary, outside bigint").collect():  # what moved
            after[np.frombuffer(row.node, "<i4")] = np.frombuffer(row.label, "<i4")
            outside += row.outside
        heavy = total[total > 0].astype(object)
        return after, (self.all_ - outside) * self.all_ - int(heavy @ heavy if len(heavy) else 0)

    def single(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best move of each node from ``label``, all others staying, and its gain (0: none)."""
        total, all_ = np.zeros(len(label), np.int64), self.all_
        np.add.at(total, label, self.k)

        def of(own, k, starts, to, w, label, total):  # noqa: ANN001, ANN202
            best, gain = _best(own, k, starts, to, w, label, total, all_)
            hit = gain > 0
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (own[hit], best[hit].astype("<i4"), gain[hit])], ["node", "label", "gain"])

        target, gains = label.copy(), np.zeros(len(label))
        for row in self.each(of, (label, total.astype(float)), "node binary, label binary, gain binary").collect():  # what can move
            node = np.frombuffer(row.node, "<i4")
            target[node], gains[node] = np.frombuffer(row.label, "<i4"), np.frombuffer(row.gain, "<f8")
        return target, gains

    def apart(self, moving: np.ndarray, round_: int) -> np.ndarray:
        """Which of the ``moving`` nodes have no moving neighbour of greater hash (ties: number)."""

        def of(own, k, starts, to, w, moving):  # noqa: ANN001, ANN202
            row = np.repeat(own, np.diff(starts))
            x, y = _hash(row, round_), _hash(to, round_)
            lost = row[moving[row] & moving[to] & ((y > x) | (y == x) & (to > row))]
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(lost).tobytes()], pa.binary())], ["node"])

        kept = moving.copy()
        for row in self.each(of, (moving,), "node binary").collect():
            kept[np.frombuffer(row.node, "<i4")] = False
        return kept

    def merged(self, of_label: np.ndarray, nodes: int) -> tuple[DataFrame, int]:
        """Pieces of the graph whose nodes are the communities ``of_label``, and its number of parts."""
        parts = max(1, min(self.parts, -(-nodes * nodes // PART_EDGES)))

        def of(own, k, starts, to, w, label):  # noqa: ANN001, ANN202
            degree, mine = np.diff(starts), label[own]
            row = np.repeat(mine, degree)
            inside = np.zeros(len(own), np.int64)
            np.add.at(inside, np.repeat(np.arange(len(own)), degree), w)
            yield from _dealt(*_summed(np.concatenate([row, mine]), np.concatenate([label[to], mine]), np.concatenate([w, k - inside])), parts)

        return self.each(of, (of_label,), "part int, a binary, b binary, w binary"), parts


def _best(own, k, starts, to, w, label, total, all_):  # noqa: ANN001, ANN202
    """The community in which each node gains most (ties: the greater), and by how much more than where it is."""
    here, best, gain, degree = label[own], label[own].copy(), np.zeros(len(own)), np.diff(starts)
    if not len(to):
        return best, gain
    row = np.repeat(np.arange(len(own), dtype=np.int64), degree)
    key = row << 32 | label[to]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    row, c = key[first] >> 32, key[first] & 0xFFFFFFFF
    weight, stays = k[row].astype(float), c == here[row]
    worth = np.add.reduceat(w[order], first) * float(all_) - np.where(stays, total[c] - weight, total[c]) * weight
    stay = -(total[here] - k) * k.astype(float)
    stay[row[stays]] = worth[stays]
    worth[stays] = -np.inf
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    most = np.full(len(own), -np.inf)
    most[row[begins]] = np.maximum.reduceat(worth, begins)
    at = np.flatnonzero((worth == most[row]) & ~stays)
    best[row[at]] = c[at]  # of equal ones the last
    gain = np.maximum(most - stay, 0)
    return np.where(gain > 0, best, here), gain


def _sweeps(own, k, starts, to, w, label, total, all_, parts):  # noqa: ANN001, ANN202
    """Labels of ``own`` after sweeps, chunk by chunk, as in ``_climb``; ``label`` and ``total`` change."""
    cuts = np.unique(np.linspace(0, len(own), min(len(own), CHUNKS) + 1).astype(int))
    for _ in range(MOST_SWEEPS if parts == 1 else SWEEPS):
        moved = 0
        for i, j in zip(cuts, cuts[1:]):
            x, y = starts[i], starts[j]
            nodes, heavy = own[i:j], k[i:j]
            best, gain = _best(nodes, heavy, starts[i : j + 1] - x, to[x:y], w[x:y], label, total, all_)
            hit = gain > 0
            if hit.any():
                np.subtract.at(total, label[nodes[hit]], heavy[hit] * float(parts))
                np.add.at(total, best[hit], heavy[hit] * float(parts))
                label[nodes[hit]] = best[hit]
                moved += 1
        if not moved:
            break
    return label[own]


def _numbered_level(level: _Level, nodes: int, least_gain: float) -> tuple[np.ndarray | None, int]:
    """As ``_level``: the label of each number, or None if no round gained, and the quality."""
    label = np.arange(nodes, dtype=np.int32)
    offered, quality = _step(level, label)
    moved, round_ = False, 0
    while True:
        round_ += 1
        held, numbers = label, np.arange(nodes)
        if (offered == held).all():
            break
        half = _hash(numbers, round_) % 2 == 0
        alone: list[np.ndarray] = []

        def single() -> list[np.ndarray]:
            return alone or alone.extend(level.single(held)) or alone  # noqa: B023

        def few() -> np.ndarray:
            target, gain = single()
            return np.where(level.apart((gain > 0) & half, round_), target, held)  # noqa: B023

        def disjoint() -> np.ndarray:
            target, gain = single()
            order = np.lexsort((numbers, gain))[int((gain <= 0).sum()) :]  # noqa: B023
            most = np.full(nodes, -1)
            most[held[order]] = order  # noqa: B023
            other = np.full(nodes, -1)
            other[target[order]] = order
            place = np.full(nodes + 1, -1)
            place[order] = np.arange(len(order))
            best = np.where(place[most] > place[other], most, other)
            chosen = order[(best[held[order]] == order) & (best[target[order]] == order)]  # noqa: B023
            out = held.copy()  # noqa: B023
            out[chosen] = target[chosen]
            return out

        for choose in (lambda: offered, lambda: np.where(half, offered, held), few, disjoint):  # noqa: B023
            tried = choose()
            after, got = _step(level, tried)
            if got > quality:
                break
        else:
            break
        gain, quality, label, offered, moved = (got - quality) / level.all_**2, got, tried, after, True
        if gain < least_gain:
            break
    return (label if moved else None), quality


def _numbered(rounds: Rounds, pairs: DataFrame, ids: np.ndarray, least_gain: float) -> tuple[DataFrame, float]:
    """As ``_found``, of ``pairs`` (a, b, w; each once, a loop with twice its weight) of the nodes ``ids``."""
    spark, nodes = rounds.spark, len(ids)
    known = spark.sparkContext.broadcast(ids)
    parts = max(1, -(-2 * pairs.count() // PART_EDGES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([np.searchsorted(known.value, batch["a"].to_numpy()), np.searchsorted(known.value, batch["b"].to_numpy()), batch["w"].to_numpy()])
            n += len(batch)
            if n >= PART_EDGES:
                yield from both(held)
                held, n = [], 0
        if n:
            yield from both(held)

    def both(held: list) -> Iterator[pa.RecordBatch]:
        a, b, w = (np.concatenate(x) for x in zip(*held))
        other = a != b
        yield from _dealt(np.concatenate([a, b[other]]), np.concatenate([b, a[other]]), np.concatenate([w, w[other]]), parts)

    level = _Level(rounds, pairs.select("a", "b", "w").mapInArrow(deal, "part int, a binary, b binary, w binary"), parts, nodes)
    rounds.forget(pairs)
    member, quality = np.arange(nodes), 0
    while True:
        label, quality = _numbered_level(level, len(level.k), least_gain)
        if label is None:
            break
        names, up = np.unique(label, return_inverse=True)
        member = up[member]
        pieces, parts = level.merged(up.astype(np.int32), len(names))
        higher = _Level(rounds, pieces, parts, len(names))
        rounds.forget(level.blocks)
        level = higher
    least = np.full(nodes, nodes)
    np.minimum.at(least, member, np.arange(nodes))
    sent = spark.sparkContext.broadcast((ids, least[member]))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, (ids, least) = batch["id"].to_numpy(), sent.value
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[least[i]])], ["node", "community"])

    found = rounds.keep(rounds.table(spark.range(nodes, numPartitions=-(-nodes // PART_EDGES)).mapInArrow(name, "node bigint, community bigint")))
    return found, quality / level.all_**2


def _found(rounds: Rounds, edges: DataFrame, least_gain: float) -> tuple[DataFrame, float]:
    """node and community, kept, and their modularity."""
    if {edges.schema[c].dataType.simpleString() for c in ("src", "dst")} == {"bigint"}:
        w = F.rint(F.col("weight") * SCALE).cast("long")
        rows = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") == F.col("dst"), 2 * w).otherwise(w).alias("w"))
        pairs = rounds.table(rows.where("w > 0").groupBy("a", "b").agg(F.sum("w").alias("w")))
        ids = rounds.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        if 0 < ids.count() <= NODES:
            return _numbered(rounds, pairs, np.sort(ids.toArrow()["node"].to_numpy()), least_gain)
        rounds.forget(pairs, ids)
    graph = rounds.table(_undirected(edges))
    all_ = graph.agg(F.sum("w")).first()[0] or 0
    members = rounds.table(graph.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    quality = 0
    while all_:
        labels, quality = _level(rounds, graph, all_, least_gain)
        if labels is None:
            break
        up = labels.select(F.col("node").alias("held"), F.col("label").alias("above"))
        higher = rounds.table(members.join(up, F.col("label") == F.col("held")).select("node", F.col("above").alias("label")))
        of_a, of_b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
        merged = rounds.table(graph.join(of_a, "a").join(of_b, "b").groupBy(F.col("label_a").alias("a"), F.col("label_b").alias("b")).agg(F.sum("w").alias("w")))
        rounds.forget(graph, members)
        graph, members = merged, higher
    least = members.groupBy("label").agg(F.min("node").alias("community"))
    found = rounds.keep(rounds.table(members.join(least, "label").select("node", "community")))
    return found, quality / all_**2 if all_ else 0.0


def louvain(edges: DataFrame, least_gain: float = LEAST_GAIN) -> DataFrame:
    """node and community (its least node) of an undirected weighted graph (src, dst, weight)."""
    with Rounds(edges.sparkSession, "louvain") as rounds:
        return _found(rounds, edges, least_gain)[0]


def rated(edges: DataFrame, least_gain: float = LEAST_GAIN) -> DataFrame:
    """As ``louvain``, with the modularity of all communities (six places), which the rounds know."""
    with Rounds(edges.sparkSession, "louvain") as rounds:
        found, quality = _found(rounds, edges, least_gain)
    return found.withColumn("modularity", F.lit(round(quality, 6)))
