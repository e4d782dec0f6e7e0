"""WARC archives: a writer, and a reader that salvages what is left of damaged files.

Each record is a gzip member of its own.  The reader goes from member to member (or from version line to version line in
plain archives, and in members of several records) and checks lengths and digests.  After a failed check it searches for the
next place at which a whole valid record begins, goes on from there, and logs the bytes between as a quarantined gap; gaps
inside a member have the member's place and, in ``problem``, their own bytes.  A member that is cut or damaged is unpacked up to
the byte at which that shows; its records that are whole and have their digests are kept.

Archives are rows of (archive, content), as ``binaryFile`` reads them, so that they can lie in any store that Spark reads.

Defined results: a null html is an empty payload; a null url leaves its header out; a null page_id never is what others
refer to, unless all ids of its payload are null; repeated rows of the largest page_id are responses each; other columns
are ignored; no pages make no archives, and null or empty archives hold neither records nor gaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

#: Compressed bytes after which a new archive begins.
ARCHIVE_BYTES = 4 << 20
#: Rows of the table of payloads that occur more than once, up to which it is broadcast.
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"

_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not yet compressed.  A revisit has the head of its response, not the payload."""
    digest = sha1_base32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_types(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html, revisit and refers_to: of equal payloads, the largest page_id is the response.

    Only payloads that occur twice or more are joined back; if they are few they are broadcast, else both sides shuffle.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha1("html"))
    many = written(keyed.select("key", "page_id").groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    few = many.count() <= broadcast_rows
    joined = keyed.join(F.broadcast(many) if few else many, "key", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(typed: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive and content: each task fills archives of about ``archive_bytes`` with its rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        size = 0
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{number:05d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "url", "html", "refers_to", "revisit")]
            for i in range(batch.num_rows):
                page_id, url, html, refers_to, revisit = (c[i].as_py() for c in columns)
                parts.append(member(record(page_id, url, html.encode(), refers_to, revisit)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield archive()
                    number, size = number + 1, 0
                    parts.clear()
        if parts:
            yield archive()

    return typed.mapInArrow(write, "archive string, content binary")


def _unpacked(content: memoryview, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at a place gives, and its end; None if it breaks off or its check fails: then it is what comes before that."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    while not unpack.eof and pos < len(content):
        before = unpack.copy()
        try:
            out.append(unpack.decompress(content[pos : pos + _CHUNK]))
        except zlib.error:
            for i in range(pos, min(pos + _CHUNK, len(content))):  # up to the very byte
                try:
                    out.append(before.decompress(content[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), None
        pos += _CHUNK
    return b"".join(out), min(pos, len(content)) - len(unpack.unused_data) if unpack.eof else None


def _parsed(data: bytes | memoryview, at: int) -> tuple[dict, int] | str:
    """The record at a place and its end, or what is wrong with it."""
    end = -1
    if bytes(data[at : at + 6]) != _VERSION[:6]:
        return "no version line"
    window = 1 << 13
    while end < 0:
        head = bytes(data[at : at + window])
        end = head.find(b"\r\n\r\n")
        if end < 0 and at + window >= len(data):
            return "no end of headers"
        window *= 4
    fields = {}
    for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        return "no content length"
    start = at + end + 4
    stop = start + int(length)
    if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
        return "wrong content length"
    block = bytes(data[start:stop])
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + sha1_base32(block):
        return "wrong block digest"
    kind = fields.get("warc-type", "")
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "response" and fields.get("warc-payload-digest", "") != "sha1:" + sha1_base32(payload):
        return "wrong payload digest"
    size = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", http.replace(b"\r", b""))
    page = re.fullmatch(r"<urn:page:(-?\d+|None)>", fields.get("warc-record-id", ""))
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
    return {
        "record_type": kind,
        "page_id": int(page[1]) if page and page[1] != "None" else None,
        "url": fields.get("warc-target-uri"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": len(payload) if kind == "response" else int(size[1]) if size else None,
        "refers_to": int(refers[1]) if refers else None,
        "payload": payload if kind == "response" else None,
    }, stop + 4


def _of_member(data: bytes, whole: bool) -> list[dict]:
    """Records and gaps of what a member gave; the last gap of a broken one says so."""
    out, at = [], 0
    while at < len(data) or not whole:
        found = _parsed(data, at) if at < len(data) else "broken member"
        if not isinstance(found, str):
            out.append(found[0] | {"kind": "record", "problem": None})
            at = found[1]
            continue
        to = data.find(_VERSION[:7], at + 1)
        while to >= 0 and isinstance(_parsed(data, to), str):
            to = data.find(_VERSION[:7], to + 1)
        if to < 0:
            what = found if whole else "broken member"
            out.append({"kind": "gap", "problem": f"{what}, bytes {at} to {len(data) if whole else 'the end'} of the member"})
            break
        out.append({"kind": "gap", "problem": f"{found}, bytes {at} to {to} of the member"})
        at = to
    return out


def _records_at(content: memoryview, at: int) -> tuple[list[dict], int | None] | str:
    """Rows of the member or record at a place, at least one of them a record, and its end (None: broken); or what is wrong."""
    if bytes(content[at : at + 2]) == b"\x1f\x8b":
        data, end = _unpacked(content, at)
        rows = _of_member(data, end is not None)
        if any(r["kind"] == "record" for r in rows):
            return rows, end
        return "broken member" if end is None else rows[0]["problem"].partition(",")[0] if rows else "empty member"
    parsed = _parsed(content, at)
    return parsed if isinstance(parsed, str) else ([parsed[0] | {"kind": "record", "problem": None}], parsed[1])


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def _next_records(content: memoryview, at: int) -> tuple[int, tuple[list[dict], int | None] | str]:
    """The next place after this one at which there are records, and these; the end if there is none."""
    while True:
        m = _START.search(content, at + 1)
        if not m:
            return len(content), ""
        at = m.start()
        found = _records_at(content, at)
        if not isinstance(found, str):
            return at, found


def salvage(content: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in order, with their start and end.  Of a broken member come the records before the damage;
    they and its gap end where the next records begin."""
    view, at = memoryview(content), 0
    found = _records_at(view, at) if len(view) else ""
    while at < len(view):
        if isinstance(found, str):
            to, after = _next_records(view, at)
            yield {"kind": "gap", "start": at, "end": to, "problem": found}
        else:
            rows, to = found
            if to is None:
                to, after = _next_records(view, at)
            else:
                after = _records_at(view, to) if to < len(view) else ""
            for row in rows:
                yield row | {"start": at, "end": to}
        at, found = to, after


FIELDS = "archive string, kind string, start bigint, end bigint, problem string, record_type string, page_id bigint, url string, payload_digest string, payload_bytes bigint, refers_to bigint"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record and per quarantined gap of ``archives`` (archive, content); with the payloads if asked."""
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payloads
    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in FIELDS.split(", ")] + [pa.binary()] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, contents = (batch.column(batch.schema.get_field_index(n)) for n in ("archive", "content"))
            for i in range(batch.num_rows):
                rows = []
                for row in salvage(contents[i].as_py() or b""):
                    rows.append(row | {"archive": of[i].as_py()} | ({} if payloads else {"payload": None}))
                    if payloads and len(rows) == 100:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    return archives.select("archive", "content").mapInArrow(read, FIELDS + ", payload binary" * payloads)


def op10(pages: DataFrame) -> DataFrame:
    """The contract's columns, a row per record of the archives as they are read back."""
    archives = written(write_archives(with_types(pages)), "archives")
    return read_archives(archives).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
