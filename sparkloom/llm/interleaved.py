"""Interleaved documents: ordered text and media references parsed from HTML, payloads resolved by digest.

Media are stored once a payload, apart from the documents, as PNG images of 8-bit grey samples in rows of 576.  A document
refers to them by digest; the digest join brings together references and what was computed from the stored bytes, and
positions and captions stay with their references.

Defined results: a null html has no elements; a null or empty text is an empty payload, stored as one row of padding;
references without a stored payload stay, with nulls; repeated rows and equal payloads give equal values; other columns
pass through ``parse`` unchanged; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

ROW = 576
PADDING = 255
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "body", "html", "header", "footer"}
_HIDDEN = {"script", "style", "template", "noscript"}
#: What a head may hold; any other tag ends it.
_IN_HEAD = {"base", "link", "meta", "title", "script", "style", "noscript", "template", "head", "html"}

ELEMENTS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
ELEMENTS_SQL = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


class _Sequence(HTMLParser):
    """Text and media of a page in order.  A figure's caption goes to all its media, else an image's alt text is its caption."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.head = False
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append({"position": len(self.out), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.head = tag == "head" or self.head and tag in _IN_HEAD
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BREAKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []
        elif tag in _MEDIA and not self.hidden and not self.head:
            given = dict(attrs)
            src = given.get("src") or ""
            digest = src.removeprefix("sha256:").lower() if src.startswith("sha256:") else given.get("data-sha256")
            if src or digest:
                self.out.append({"position": len(self.out), "kind": _MEDIA[tag], "text": None, "digest": digest, "caption": given.get("alt") or None})
                if self.figure is not None:
                    self.figure.append(len(self.out) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _MEDIA or tag in _BREAKS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "head":
            self.head = False
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure or []:
                self.out[i]["caption"] = text or self.out[i]["caption"]
            self.caption = None
        elif tag == "figure":
            self.figure = self.caption = None
        if tag in _BREAKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.head:
            (self.words if self.caption is None else self.caption).append(data)


def elements(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def parse(documents: DataFrame) -> DataFrame:
    """Replaces ``html`` by ``elements``: ordered structs of text and media references."""
    fields = [f for f in documents.schema.names if f != "html"]
    schema = documents.select(*fields, F.lit(None).cast(ELEMENTS_SQL).alias("elements")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html")).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f)) for f in fields), pa.array([elements(x) for x in html], ELEMENTS)], [*fields, "elements"])

    return documents.mapInArrow(read, schema)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples; the payload's length is a multiple of a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    filtered = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered, 3)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """The samples of such an image as rows; raises ValueError if it is damaged or of another form."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, shape = 8, [], None
    while at < len(stored):
        (size,) = struct.unpack(">I", stored[at : at + 4])
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not plain 8-bit grey")
            shape = height, width + 1
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Height, mean and spread of the samples, and a 64-bit hash of which of 8 x 8 blocks are brighter than all together."""
    height = len(samples)
    total = samples.sum(dtype=np.int64)
    squares = (samples.astype(np.int64) ** 2).sum()
    n = samples.size
    edges = (np.arange(9) * height) // 8
    blocks = samples.reshape(height, 8, ROW // 8).sum(axis=2, dtype=np.int64)
    bits = 0
    for a, b in zip(edges, edges[1:]):
        b = max(b, a + 1)  # fewer than eight rows: some count twice
        part = blocks[a:b].sum(axis=0)
        for x in part:
            bits = bits << 1 | int(x * n > total * (b - a) * (ROW // 8))
    return f"{height}:{total // n}:{(squares * n - total * total) // (n * n)}:{bits:016x}"


def padded(text: bytes) -> bytes:
    return text + bytes([PADDING]) * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def store_media(texts: DataFrame) -> DataFrame:
    """``media``: the stored form of each text's payload."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for a in range(0, batch.num_rows, 200):
                part = column[a : a + 200].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([to_png(padded((x or "").encode())) for x in part], pa.binary())], ["media"])

    return texts.select("text").mapInArrow(encode, "media binary")


def media_features(media: DataFrame) -> DataFrame:
    """One row per payload: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, all from
    the stored bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for x in batch.column(batch.schema.get_field_index("media")):
                stored = x.as_py()
                samples = from_png(stored)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    read = media.mapInArrow(decode, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return read.groupBy(F.col("payload_sha256").alias("digest")).agg(*[F.first(c).alias(c) for c in read.columns])


def resolve(references: DataFrame, features: DataFrame) -> DataFrame:
    """References (with ``digest``) and what is known of their payloads; those without one keep nulls."""
    return references.join(features, "digest", "left")


def payload_digest(text: F.Column) -> F.Column:
    """SHA-256 of a text's padded payload."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    fill = F.greatest(F.lit(1), F.ceil(size / ROW)) * ROW - size
    return F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit(f"{PADDING:02X}"), fill.cast("int")))), 256)


def op6(documents: DataFrame) -> DataFrame:
    """The contract's columns, a row per document, then the position and caption of its reference."""
    documents = documents.select("doc_id", "text")
    media = written(store_media(documents), "media")
    pages = documents.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.concat(F.lit('<article><figure><img src="sha256:'), payload_digest(F.col("text")), F.lit('"><figcaption>Text of document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("</figcaption></figure></article>")).alias("html"),
    )
    found = parse(pages).select("doc_id", "n_bytes", F.explode("elements").alias("e")).where("e.kind = 'image'")
    references = found.select("doc_id", "n_bytes", "e.digest", "e.position", "e.caption")
    features = written(media_features(media), "features")  # plain shuffles on both sides: a payload of very many documents is split
    out = resolve(references, features)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
