"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. A document's set is its distinct word shingles, as 64-bit hashes.  Equal sets form one class; the rest works on classes.
2. One permutation fills 128 bins; an empty bin copies a bin picked by its own fixed random order (optimal densification).
   32 bands of 4 bins are the buckets.  A pair at similarity 0.85 shares fewer than ``SHARED`` of them about once in
   5 * 10**8, at 0.8 once in 10**6; fewer are taken for chance.
3. Within a bucket every member is a candidate of the bucket's centre only, so candidates grow with the members, never with
   their square.  The centre is the member that meets most others over all its buckets: of a group of edited copies, the one
   nearest to what they were copied from, to which all links of the group can be expected.
4. Each class's likeliest candidate is confirmed on full sets; linked classes form components.
5. What stars can lose is searched to the end: classes that still share buckets across components meet by the prefix rule.
   Two similar sets share a shingle among the first of each, in any one order of all shingles.  In the order taken here those
   that only one component has come first, and then the rare ones.  Classes that share such a shingle are dealt out in blocks
   and compared inside the tasks, which return only the pairs that are confirmed next; no list of pairs is made.

Defined results: null, empty or wordless texts have no shingles and stand alone; null doc_ids take part, but never name a
component unless all its ids are null; repeated rows share their component; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import scratch, written
from ._words import LOWER, NOT_SPACE, hashes, mix, shingle_hashes, slices, words
from .components import components

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: Buckets that two classes must share.
SHARED = 2
#: Deviations by which a sketch must fall short before a pair is not compared in full.
SIGMAS = 6.0
#: Members of a block in the exact finish, and mixed shingles up to which a set goes there itself, not only as its sketch.
BLOCK = 512
SMALL = 256
#: Ids of the texts to be compared in full, up to which they are broadcast; beyond, both sides shuffle.
BROADCAST_IDS = 100_000

_rng = np.random.default_rng(20240229)
#: For each bin, the order in which it looks for a bin to copy.
_DONORS = np.array([_rng.permutation(BINS) for _ in range(BINS)])
_WEIGHTS = _rng.integers(1, 1 << 63, size=(BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each band.  ``shingles``: sorted distinct hashes, whose top bits are their bins."""
    return _keys(bins(shingles))


def bins(shingles: np.ndarray) -> np.ndarray:
    """The densified bins of a set."""
    bits = 64 - BINS.bit_length() + 1
    first = np.searchsorted(shingles, np.arange(BINS, dtype=np.uint64) << np.uint64(bits))
    at = np.minimum(first, len(shingles) - 1)
    value = shingles[at]
    full = (first < len(shingles)) & ((value >> np.uint64(bits)) == np.arange(BINS, dtype=np.uint64))
    if not full.all():
        empty = np.flatnonzero(~full)
        donor = _DONORS[empty]
        value[empty] = value[donor[np.arange(len(empty)), full[donor].argmax(axis=1)]]
    return mix(value)


def _keys(value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((value.reshape(BANDS, ROWS) * _WEIGHTS).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part, data, at in slices(batch, "text"):
        data = LOWER[data]
        starts, ends, first = words(data, at, NOT_SPACE)
        word = hashes(data, starts, ends)
        yield part, [np.unique(shingle_hashes(word[a:b], k)) for a, b in zip(first, first[1:])]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(documents: DataFrame, k: int, least: int) -> DataFrame:
    """Columns of ``documents`` but the text, plus n_shingles, set_id (null without shingles), and the bands and the sketch, a byte
    of each bin (both null below ``least`` shingles)."""
    fields = [f for f in documents.schema.names if f != "text"]
    schema = documents.select(*fields, F.lit(0).cast("long").alias("n_shingles"), F.expr("cast(null as binary) as set_id"), F.expr("cast(null as array<bigint>) as bands"), F.expr("cast(null as binary) as sketch")).schema

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, k):
                keep = [part.column(part.schema.get_field_index(f)) for f in fields]
                n = pa.array([len(s) for s in sets], pa.int64())
                ids = pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())
                values = [bins(s) if len(s) >= least else None for s in sets]
                bands = pa.array([None if v is None else _keys(v) for v in values], pa.list_(pa.int64()))
                sketch = pa.array([None if v is None else v.astype(np.uint8).tobytes() for v in values], pa.binary())
                yield pa.RecordBatch.from_arrays([*keep, n, ids, bands, sketch], [*fields, "n_shingles", "set_id", "bands", "sketch"])

    return documents.mapInArrow(sign, schema)


def _full_sets(documents: DataFrame, k: int) -> DataFrame:
    """set_id and the sorted set as bytes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["set_id", "shingles"])

    return documents.select("text").mapInArrow(sets, "set_id binary, shingles binary")


def _likely(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose sketches do not speak against the similarity by more than ``SIGMAS`` deviations."""
    sketches = sets.select("node", "n", "sketch")
    left, right = (sketches.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("s" + c)) for c in "ab")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = percent / 100
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(get(n).to_pylist()), np.uint8).reshape(-1, BINS) for n in ("sa", "sb"))
                n = np.minimum(np.minimum(get("na").to_numpy(), get("nb").to_numpy()), BINS)
                keep = (x == y).mean(axis=1) >= t - SIGMAS * np.sqrt(t * (1 - t) / n)
                yield pa.RecordBatch.from_arrays([get("a"), get("b")], ["a", "b"]).filter(pa.array(keep))

    return edges.select("a", "b").join(left, "a").join(right, "b").mapInArrow(judge, "a bigint, b bigint")


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose sets are similar enough: 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            xs, ys = (batch.column(batch.schema.get_field_index(n)) for n in "xy")
            for i in range(batch.num_rows):
                x, y = np.frombuffer(xs[i].as_py(), np.uint64), np.frombuffer(ys[i].as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in "ab"], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return edges.select("a", "b").join(left, "a").join(right, "b").mapInArrow(judge, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept, a row per document."""
    documents = documents.select("doc_id", "text")
    with scratch(documents.sparkSession) as kept:
        least = -(-percent // max(1, 100 - percent))  # of smaller sets, even one shingle more or less is too much: only equal ones link
        signed = written(signatures(documents, k, least), "signatures")
        classes = written(
            signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()),
            "classes",
        )
        # What is aggregated is written before it is joined back: both sides are then plain shuffles, and a hot key can be split.
        banded = classes.where("bands is not null").select("node", "n", F.explode("bands").alias("key"))
        shared = written(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        members = written(banded.join(shared, "key"), "members")
        score = members.groupBy("node").agg(F.sum("size").alias("score"), F.count("*").alias("buckets"))
        score = written(score.where(F.col("buckets") >= SHARED).select("node", "score"), "score")
        members = written(members.drop("size").join(score, "node"), "members")
        sets = written(_sets_of(documents, classes, score, k), "sets")
        component = _linked(members, sets, percent)
        named = classes.select("node", "set_id", "rep").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = written(named, "named")
        names = written(named.groupBy("component").agg(F.min("rep").alias("component_id")), "names")
        by_set = written(named.join(names, "component").select("set_id", "component_id"), "named")
        signed = written(signed.select("doc_id", "n_shingles", "set_id"), "sets_of_documents")
        kept += [by_set, signed]
    out = signed.join(by_set, "set_id", "left")
    component_id = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component_id.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sets_of(documents: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, n, sketch and full set of the classes ``nodes``."""
    wanted = written(classes.select("node", "set_id", "rep", "n", "sketch").join(nodes.select("node"), "node", "left_semi"), "wanted")
    ids = wanted.select(F.col("rep").alias("wanted_id"))
    few = wanted.count() <= BROADCAST_IDS
    texts = documents.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    found = _full_sets(texts, k).join(wanted.select("node", "set_id", "n", "sketch"), "set_id")
    return found.select("node", "n", "sketch", "shingles").dropDuplicates(["node"])


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after more links (a, b): components are linked as wholes."""
    of_a, of_b = (labels.select(F.col("node").alias(c), F.col("component").alias("c" + c)) for c in "ab")
    over = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = components(over, "a", "b")
    root_of = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = labels.join(root_of, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return written(old.unionByName(roots.join(labels.select("node"), "node", "left_anti")), "labels")


def _sized(percent: int) -> Column:
    """Whether two sets' sizes alone allow the similarity."""
    return 100 * F.least("n", "x.n") >= percent * F.greatest("n", "x.n")


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node and component of every class with a link.  ``members``: key, node, n and score."""
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    centres = written(members.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("score", "node")).alias("x")), "centres")
    pairs = members.join(centres, "key").where((F.col("node") != F.col("x.node")) & _sized(percent))
    stars = written(pairs.groupBy(*ordered("node", "x.node")).agg(F.count("*").alias("buckets")).where(F.col("buckets") >= SHARED), "stars")
    # The likeliest candidate of each class: where it links, the class's others need no test.
    ways = stars.select(F.col("a").alias("node"), F.col("b").alias("to"), "buckets").union(stars.select("b", "a", "buckets"))
    best = ways.groupBy("node").agg(F.max_by("to", F.struct("buckets", "to")).alias("to")).select(*ordered("node", "to")).distinct()
    likely = written(_likely(best, sets, percent), "likely")
    labels = components(written(_confirmed(likely, sets, percent), "links"), "a", "b")
    rest = written(_rest(members, labels, sets, percent), "rest")
    if rest.isEmpty():
        return labels
    links = written(_confirmed(rest, sets, percent), "links")
    return labels if links.isEmpty() else _joined(labels, links)


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components, every one that is similar enough among them."""
    named = written(members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "members")
    mixed = written(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key"), "mixed")
    nodes = named.join(mixed, "key").groupBy("node").agg(F.first("component").alias("component"), F.count("*").alias("buckets"))
    nodes = written(nodes.where(F.col("buckets") >= SHARED).select("node", "component"), "nodes")
    sizes = written(nodes.groupBy("component").agg(F.count("*").cast("int").alias("size")), "sizes")
    sets = written(sets.join(nodes.join(sizes, "component"), "node"), "sets")
    shingles = _shingles(sets)
    # The component with most members is a shingle's main one: of each pair across components at least one member is outside it.
    of = F.struct("size", "component")
    met = shingles.groupBy("shingle").agg(F.count("*").alias("df"), F.min(of).alias("low"), F.max(of).alias("high"))
    met = written(met.where("low != high").select("shingle", "df", F.col("high.component").alias("main")), "met")
    lists = shingles.select("node", "shingle").join(met, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", "main"))).alias("mixed"))
    # Similar sets share percent * n shingles of either, so one is among the first n - that + 1; those of one component come first.
    first = F.expr(f"n - ({percent} * n + 99) div 100 + 1") - (F.col("n") - F.size("mixed"))
    small = F.when(F.size("mixed") <= SMALL, F.array_sort(F.transform("mixed", lambda x: x["shingle"])))
    lists = lists.join(sets.select("node", "n", "component", "sketch"), "node").withColumns({"first": first.cast("int"), "small": small}).where("first > 0")
    own = F.col("n") - F.size("mixed")
    prefix = lists.select("node", "n", "component", "sketch", "small", own.alias("own"), F.posexplode(F.slice("mixed", F.lit(1), F.col("first"))).alias("i", "x"))
    left = (F.col("n") - F.col("own") - F.col("i")).alias("left")
    prefix = prefix.select("node", "n", left, "component", "sketch", "small", "x.shingle", (F.col("component") == F.col("x.main")).alias("main"))
    return _compared(written(prefix, "prefix"), percent)


def _shingles(sets: DataFrame) -> DataFrame:
    """node, component, size and shingle, a row per shingle of ``sets``."""
    fields = ["node", "component", "size"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.schema.get_field_index("shingles"))
            for at in range(0, batch.num_rows, 500):
                each = [np.frombuffer(x.as_py(), np.int64) for x in found[at : at + 500]]
                rows = np.repeat(np.arange(at, at + len(each)), [len(x) for x in each])
                keep = [batch.column(batch.schema.get_field_index(f)).take(pa.array(rows)) for f in fields]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(np.concatenate(each))], [*fields, "shingle"])

    return sets.select(*fields, "shingles").mapInArrow(explode, "node bigint, component bigint, size int, shingle bigint")


def _compared(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a shingle of ``prefix``, differ in component and may be similar enough.

    ``left`` counts a set's shingles from the shared one on, in the common order.  If that is the first one they share, they
    share no more than that; if it allows too little, it is not the first or they are not similar, and the pair needs no test.
    The members of a shingle are dealt to blocks by hash: main ones against others, and others among themselves.  A block
    against a block is one group, so that no group grows with the shingle's members.
    """
    counts = prefix.groupBy("shingle").agg(F.count_if("main").alias("mains"), F.count_if(~F.col("main")).alias("others"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    counts = written(counts.where("others > 0 and mains + others > 1").select("shingle", blocks("mains"), blocks("others")), "blocks")
    dealt = prefix.join(counts, "shingle")
    own = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others")))).cast("int")
    dealt = dealt.withColumn("own", own)
    others = F.sequence(F.lit(0), F.col("others") - 1)
    key = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    against_main = F.when(F.col("mains") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("mains")) - 1), lambda m: key(-1 - m, F.col("own"))))
    among = F.transform(others, lambda c: key(F.least("own", c), F.greatest("own", c)))
    groups = F.when(F.col("main"), F.transform(others, lambda c: key(-1 - F.col("own"), c))).otherwise(F.concat(F.coalesce(against_main, F.array().cast("array<struct<i:int,j:int>>")), among))
    dealt = dealt.select("shingle", F.explode(groups).alias("g"), "node", "n", "left", "component", "sketch", "small", F.when(F.col("main"), -1 - F.col("own")).otherwise(F.col("own")).alias("own"))
    dealt = dealt.select("shingle", "g.i", "g.j", "own", "node", "n", "left", "component", "sketch", "small").repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("shingle", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if b > a:
                    key = tuple(keys[:, a].tolist())
                    if key != at and held:
                        yield _similar(pa.Table.from_batches(held).combine_chunks(), percent)
                        held = []
                    held.append(batch.slice(a, b - a))
                    at = key
        if held:
            yield _similar(pa.Table.from_batches(held).combine_chunks(), percent)

    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def _similar(group: pa.Table, percent: int) -> pa.RecordBatch:
    """Of one block against another, the pairs that sizes, sketches and, for small sets, the sets themselves allow."""
    own, node, n, rest, component = (group[c].to_numpy() for c in ("own", "node", "n", "left", "component"))
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
    small = [x.values.to_numpy() if x.is_valid else None for x in group["small"]]
    t, out = percent / 100, []
    for x in left:
        y = right if i != j else right[right > x]
        y = y[(component[y] != component[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        y = y[(100 + percent) * np.minimum(rest[y], rest[x]) >= percent * (n[y] + n[x])]
        if not len(y):
            continue
        m = np.minimum(np.minimum(n[y], n[x]), BINS)
        y = y[(sketch[y] == sketch[x]).mean(axis=1) >= t - SIGMAS * np.sqrt(t * (1 - t) / m)]
        if small[x] is not None and len(y):
            exact = np.array([small[q] is not None for q in y])
            if exact.any():
                sets = [small[q] for q in y[exact]]
                flat = np.concatenate(sets)
                at = np.minimum(np.searchsorted(small[x], flat), len(small[x]) - 1)
                both = np.bincount(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), weights=small[x][at] == flat, minlength=len(sets))
                ok = ~exact
                ok[exact] = 100 * both >= percent * (n[x] + n[y[exact]] - both)
                y = y[ok]
        out += [(min(node[x], node[q]), max(node[x], node[q])) for q in y]
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def op4(documents: DataFrame) -> DataFrame:
    """The contract's columns: three-word shingles, similarity of 0.85."""
    return near_duplicates(documents, k=3, percent=85)
