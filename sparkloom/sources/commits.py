"""Commit histories, read from the object store of a repository: ``spark.read.format("commit_objects").option("path", ...)``.

Objects lie alone or in packs.  A pack's index says where an object of some id begins (a table of 256 counts by the first byte,
then the ids in order); objects are whole or chains of changes against others.  Tasks share the ids by ranges of their first
byte: each finds the commits of its range, whatever pack they are in, and compares a commit's tree with that of its parent.
Nothing is run and no log is walked, so a long history is many tasks.  With the option ``pushdown`` a filter on ``committed`` (``>``
or ``>=``) is taken by the reader, which then leaves older commits before it compares trees; the session must push filters to
Python sources (``spark.sql.python.filterPushdown.enabled``).

Defined results: merges and first commits name no files; messages that are not UTF-8 keep what can be read; commits that no
branch reaches any more are there, too (``ancestors`` gives those of one head); an empty repository gives no rows.
"""

from __future__ import annotations

import datetime
import mmap
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from .scratch import Rounds

SCHEMA = "commit string, parents array<string>, author string, email string, authored timestamp, committed timestamp, subject string, body string, type string, files array<string>"

_COMMIT, _TREE = 1, 2
_BY_OFFSET, _BY_ID = 6, 7
_KINDS = {b"commit": 1, b"tree": 2, b"blob": 3, b"tag": 4}


class Pack:
    """One pack with its index (format version 2)."""

    def __init__(self, index: str) -> None:
        with open(index, "rb") as file:
            self.index = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        with open(index[: -len("idx")] + "pack", "rb") as file:
            self.data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        if self.index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{index} is no pack index of version 2")
        self.n = self._count(255)

    def _count(self, byte: int) -> int:
        """Ids whose first byte is at most this."""
        return int.from_bytes(self.index[8 + 4 * byte : 12 + 4 * byte], "big") if byte >= 0 else 0

    def _id(self, i: int) -> bytes:
        return self.index[1032 + 20 * i : 1052 + 20 * i]

    def _place(self, i: int) -> int:
        at = 1032 + 24 * self.n + 4 * i
        place = int.from_bytes(self.index[at : at + 4], "big")
        if place >> 31:  # beyond 2 GB: in a table of longer numbers
            at = 1032 + 28 * self.n + 8 * (place & 0x7FFFFFFF)
            place = int.from_bytes(self.index[at : at + 8], "big")
        return place

    def find(self, id_: bytes) -> int | None:
        low, high = self._count(id_[0] - 1), self._count(id_[0])
        while low < high:
            mid = (low + high) // 2
            if self._id(mid) < id_:
                low = mid + 1
            else:
                high = mid
        return self._place(low) if low < self._count(id_[0]) and self._id(low) == id_ else None

    def between(self, low: int, high: int) -> Iterator[tuple[bytes, int]]:
        """Ids with a first byte from ``low`` up to ``high``, and where their objects begin."""
        for i in range(self._count(low - 1), self._count(high - 1)):
            yield self._id(i), self._place(i)

    def header(self, place: int) -> tuple[int, int | bytes | None, int]:
        """Kind, what it is a change of (a place or an id), and where its bytes begin."""
        byte = self.data[place]
        kind, at = byte >> 4 & 7, place + 1
        while byte & 0x80:
            byte = self.data[at]
            at += 1
        if kind == _BY_ID:
            return kind, self.data[at : at + 20], at + 20
        if kind == _BY_OFFSET:
            byte = self.data[at]
            back, at = byte & 0x7F, at + 1
            while byte & 0x80:
                byte = self.data[at]
                back, at = (back + 1) << 7 | byte & 0x7F, at + 1
            return kind, place - back, at
        return kind, None, at

    def bytes_at(self, at: int) -> bytes:
        out, unpack = [], zlib.decompressobj()
        while not unpack.eof:
            out.append(unpack.decompress(self.data[at : at + 65536]))
            at += 65536
        return b"".join(out)


def changed(base: bytes, change: bytes) -> bytes:
    """What a change makes of its base: copies of ranges of it, and new bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = change[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if not byte & 0x80:
                return value, at

    _, at = number(0)
    size, at = number(at)
    out = bytearray()
    while at < len(change):
        op = change[at]
        at += 1
        if op & 0x80:
            parts = []
            for bit in range(7):
                parts.append(change[at] if op >> bit & 1 else 0)
                at += op >> bit & 1
            begin = int.from_bytes(bytes(parts[:4]), "little")
            out += base[begin : begin + (int.from_bytes(bytes(parts[4:]), "little") or 0x10000)]
        else:
            out += change[at : at + op]
            at += op
    if len(out) != size:
        raise ValueError("a change does not give the size that it states")
    return bytes(out)


class Store:
    """All objects of a repository (its folder, or the one with ``objects`` in it)."""

    def __init__(self, path: str) -> None:
        root = Path(path.removeprefix("file://"))
        self.root = root / ".git" if (root / ".git").is_dir() else root
        self.packs = [Pack(str(p)) for p in sorted((self.root / "objects" / "pack").glob("*.idx"))]
        self.read = lru_cache(4096)(self._read)

    def _alone(self, id_: bytes) -> tuple[int, bytes] | None:
        name = id_.hex()
        try:
            raw = zlib.decompress((self.root / "objects" / name[:2] / name[2:]).read_bytes())
        except FileNotFoundError:
            return None
        head, _, data = raw.partition(b"\0")
        return _KINDS[head.split(b" ")[0]], data

    def _read(self, id_: bytes) -> tuple[int, bytes]:
        for pack in self.packs:
            place = pack.find(id_)
            if place is not None:
                return self._at(pack, place)
        found = self._alone(id_)
        if found is None:
            raise KeyError(id_.hex())
        return found

    def _at(self, pack: Pack, place: int) -> tuple[int, bytes]:
        changes = []
        while True:
            kind, base, at = pack.header(place)
            if kind not in (_BY_OFFSET, _BY_ID):
                data = pack.bytes_at(at)
                break
            changes.append(pack.bytes_at(at))
            if kind == _BY_ID and (inside := pack.find(base)) is None:
                kind, data = self.read(base)
                break
            place = inside if kind == _BY_ID else base
        for change in reversed(changes):
            data = changed(data, change)
        return kind, data

    def _kind(self, pack: Pack, place: int) -> int:
        """An object's kind, from headers only."""
        while True:
            kind, base, _ = pack.header(place)
            if kind == _BY_OFFSET:
                place = base
            elif kind == _BY_ID:
                inside = pack.find(base)
                if inside is None:
                    return self.read(base)[0]
                place = inside
            else:
                return kind

    def commits(self, low: int, high: int) -> Iterator[tuple[bytes, bytes]]:
        """Ids with a first byte from ``low`` up to ``high``, and contents of the commits; each once."""
        seen = set()
        for pack in self.packs:
            for id_, place in pack.between(low, high):
                if id_ not in seen and self._kind(pack, place) == _COMMIT:
                    seen.add(id_)
                    yield id_, self._at(pack, place)[1]
        for byte in range(low, high):
            folder = self.root / "objects" / f"{byte:02x}"
            for name in sorted(os.listdir(folder)) if folder.is_dir() else ():
                id_ = bytes.fromhex(folder.name + name) if re.fullmatch("[0-9a-f]{38}", name) else None
                found = self._alone(id_) if id_ and id_ not in seen else None
                if found and found[0] == _COMMIT:
                    yield id_, found[1]

    def _entries(self, tree: bytes | None) -> dict[bytes, tuple[bytes, bytes]]:
        """Name to mode and id."""
        out = {}
        data = self.read(tree)[1] if tree else b""
        at = 0
        while at < len(data):
            end = data.index(b"\0", at)
            mode, name = data[at:end].split(b" ", 1)
            out[name] = mode, data[end + 1 : end + 21]
            at = end + 21
        return out

    def differing(self, old: bytes | None, new: bytes | None, prefix: bytes = b"") -> Iterator[bytes]:
        """Paths of the files that two trees don't share."""
        a, b = self._entries(old), self._entries(new)
        for name in sorted(a.keys() | b.keys()):
            x, y = a.get(name), b.get(name)
            if x == y:
                continue
            folders = [e[1] if e and e[0] == b"40000" else None for e in (x, y)]
            if any(folders):
                yield from self.differing(*folders, prefix + name + b"/")
            if any(e and e[0] != b"40000" for e in (x, y)):
                yield prefix + name


_PERSON = re.compile(rb"^(.*?) ?<([^>]*)> (-?\d+)", re.S)


def _time(seconds: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)


def row_of(store: Store, id_: bytes, data: bytes, since: tuple[datetime.datetime, bool] | None) -> tuple | None:
    """A commit as a row of ``SCHEMA``; None if it is older than ``since`` (a time, and whether it counts itself)."""
    head, _, message = data.partition(b"\n\n")
    fields: dict[bytes, list[bytes]] = {}
    for line in re.sub(rb"\n ", b"\0", head).split(b"\n"):
        key, _, value = line.partition(b" ")
        fields.setdefault(key, []).append(value)
    text = lambda b: b.decode("utf-8", "replace")
    (name, email, authored), (_, _, committed) = (_PERSON.match(fields[k][0]).groups() for k in (b"author", b"committer"))
    when = _time(int(committed))
    if since and (when < since[0] or when == since[0] and not since[1]):
        return None
    parents = [bytes.fromhex(p.decode()) for p in fields.get(b"parent", ())]
    files = []
    if len(parents) == 1:
        tree_of = lambda c: bytes.fromhex(re.match(rb"tree ([0-9a-f]{40})", store.read(c)[1])[1].decode())
        files = [text(p) for p in store.differing(tree_of(parents[0]), bytes.fromhex(fields[b"tree"][0].decode()))]
    subject, _, body = message.strip(b"\n").partition(b"\n\n")
    subject = " ".join(text(subject).split("\n"))
    return id_.hex(), [p.hex() for p in parents], text(name), text(email), _time(int(authored)), when, subject, text(body).strip("\n"), "revert" if subject.startswith("Revert ") else "commit", files


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.parts = options["path"], min(256, int(options.get("parts", 16)))
        self.since: tuple[datetime.datetime, bool] | None = None

    def partitions(self) -> Sequence[InputPartition]:
        edges = [256 * i // self.parts for i in range(self.parts + 1)]
        return [_Range(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        store = Store(self.path)
        for id_, data in store.commits(partition.low, partition.high):
            row = row_of(store, id_, data, self.since)
            if row:
                yield row


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("committed",):
                at = f.value if f.value.tzinfo else f.value.astimezone(datetime.timezone.utc)
                bound = (at, isinstance(f, GreaterThanOrEqual))
                self.since = bound if self.since is None else max(self.since, bound, key=lambda x: (x[0], not x[1]))
            else:
                yield f


class CommitObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commit_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(self.options)


def commits(spark: SparkSession, path: str, parts: int = 16) -> DataFrame:
    """All commits of a repository, which executors must be able to read.  Filters are pushed where the session pushes them to Python sources."""
    spark.dataSource.register(CommitObjects)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("commit_objects").option("path", path).option("parts", parts).option("pushdown", pushes).load()


def ancestors(log: DataFrame, heads: DataFrame) -> DataFrame:
    """The commits (of ``commits``) that ``heads`` (commit) reach: ways of 1, 2, 4 ... steps, so that a long history takes few rounds."""
    with Rounds(log.sparkSession, "ancestors") as rounds:
        jumps = rounds.table(log.select("commit", F.explode("parents").alias("parent")).distinct())
        seen = rounds.table(heads.select("commit").distinct())
        while not jumps.isEmpty():
            after = rounds.table(seen.unionByName(jumps.join(seen, "commit").select(F.col("parent").alias("commit"))).distinct())
            on = jumps.select(F.col("commit").alias("parent"), F.col("parent").alias("further"))
            longer = rounds.table(jumps.join(on, "parent").select("commit", F.col("further").alias("parent")).distinct())
            rounds.forget(seen, jumps)
            seen, jumps = after, longer
        rounds.keep(seen)
    return log.join(seen, "commit", "left_semi")
