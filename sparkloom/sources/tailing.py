"""Streaming sources that read on from where they stopped: lines of growing files, rows of growing tables.

The offset of ``event_tail`` holds for every file how many bytes are read, up to the end of a line, and a hash of its first bytes.  A file
that grew is read from there; one whose beginning changed or that shrank was rewritten, and is read from its beginning; one
that is gone leaves the offset.  The offset of ``table_tail`` holds the greatest rowid, and a hash of the first row: another
first row is another table, read anew.  Spark writes offsets before it reads and commits after, so a run that is lost reads the
same ranges again, and one that resumes reads nothing twice.

Ranges are cut into parts of ``PART_BYTES`` or ``PART_ROWS``, each a task.  A line belongs to the part in which it begins.

Defined results: a last line without its end waits until it has one; blank lines are rows like others; files without a
complete line, empty folders and empty tables give no rows.  A file that is rewritten while a batch reads it gives the lines
that are there at that moment, and is read anew in the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PART_BYTES = 64 << 20
PART_ROWS = 1_000_000
#: First bytes by which a file is known, and bytes that are looked through at once for the end of a line.
_HEAD = 64
_STEP = 1 << 20


class _Range(InputPartition):
    def __init__(self, place: str, low: int, high: int) -> None:
        self.place, self.low, self.high = place, low, high


def _opened(folder: str):  # noqa: ANN202
    """The file system of a folder (local, HDFS, object stores) and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _hash(head: bytes) -> str:
    return hashlib.sha256(head).hexdigest()[:16]


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.suffix = options.get("suffix", ".jsonl")
        self.part = int(options.get("partbytes", PART_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        system, root = _opened(self.folder)
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix) and not info.base_name.startswith(("_", ".")):
                with system.open_input_file(info.path) as file:
                    size = self._whole_lines(file, info.size)
                    if size:
                        head = file.read_at(min(_HEAD, size), 0)
                        out[info.path[len(root) :].lstrip("/")] = {"size": size, "known": len(head), "head": _hash(head)}
        return out

    @staticmethod
    def _whole_lines(file, size: int) -> int:  # noqa: ANN001
        """Bytes up to the end of the last complete line."""
        while size > 0:
            low = max(0, size - _STEP)
            at = file.read_at(size - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            size = low
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = _opened(self.folder)
        out = []
        for name, now in end.items():
            before, low = start.get(name), 0
            if system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                continue  # what was not read before it went is not there to read
            if before and before["size"] <= now["size"]:
                with system.open_input_file(f"{root}/{name}") as file:
                    low = before["size"] if _hash(file.read_at(before["known"], 0)) == before["head"] else 0
            out += [_Range(name, a, min(a + self.part, now["size"])) for a in range(low, now["size"], self.part)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = _opened(self.folder)
        if system.get_file_info(f"{root}/{partition.place}").type == fs.FileType.NotFound:
            return
        with system.open_input_file(f"{root}/{partition.place}") as file:
            at, rest = partition.low, b""
            if at and file.read_at(1, at - 1) != b"\n":  # the line that goes over the border is the part before's
                while chunk := file.read_at(_STEP, at):
                    end = chunk.find(b"\n")
                    at += len(chunk) if end < 0 else end + 1
                    if end >= 0:
                        break
            begins = at
            while begins < partition.high and (chunk := file.read_at(_STEP, at)):
                at += len(chunk)
                lines = (rest + chunk).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if begins >= partition.high:
                        return
                    begins += len(line) + 1
                    yield (partition.place, line.decode("utf-8", "replace").removesuffix("\r"))


class EventTail(DataSource):
    """``spark.readStream.format("event_tail").option("path", folder)``: file and value of new lines of the files with ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "event_tail"

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _TailReader(self.options)


class _TableReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.table, self.fields = options["path"], options["table"], [f.name for f in schema]
        self.part = int(options.get("partrows", PART_ROWS))

    def _all(self, sql: str, *values: int) -> Iterator[tuple]:
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            yield from db.execute(sql, values)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"row": 0, "first": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        first = next(self._all(f'select rowid, * from "{self.table}" order by rowid limit 1'), None)
        last = next(self._all(f'select max(rowid) from "{self.table}"'))[0]
        return {"row": last or 0, "first": "" if first is None else _hash(repr(first).encode())}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low = start["row"] if start["first"] == end["first"] and start["row"] <= end["row"] else 0
        return [_Range("", a, min(a + self.part, end["row"])) for a in range(low, end["row"], self.part)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join("rowid" if n == "rowid" else f'"{n}"' for n in self.fields)
        yield from self._all(f'select {names} from "{self.table}" where rowid > ? and rowid <= ? order by rowid', partition.low, partition.high)


class TableTail(DataSource):
    """``spark.readStream.format("table_tail").schema(...).option("path", file).option("table", name)``: new rows of a row-store file,
    whose rowids are positive and grow."""

    @classmethod
    def name(cls) -> str:
        return "table_tail"

    def schema(self) -> str:
        raise ValueError("give the columns by schema(...)")

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _TableReader(self.options, schema)


def event_tail(spark: SparkSession, folder: str, suffix: str = ".jsonl", part_bytes: int = PART_BYTES) -> DataFrame:
    spark.dataSource.register(EventTail)
    return spark.readStream.format("event_tail").option("path", folder).option("suffix", suffix).option("partbytes", part_bytes).load()


def table_tail(spark: SparkSession, path: str, name: str, schema: str, part_rows: int = PART_ROWS) -> DataFrame:
    spark.dataSource.register(TableTail)
    return spark.readStream.format("table_tail").schema(schema).option("path", path).option("table", name).option("partrows", part_rows).load()
