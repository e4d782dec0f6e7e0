"""Token ids of whole texts by a public byte-level BPE vocabulary, a batch at a time."""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np

from ._words import hashes

#: How the vocabulary's own tokenizer splits text into pieces (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces that a worker remembers, about 150 bytes each.
CACHE_PIECES = 200_000

_LETTER, _NUMBER, _SPACE, _OTHER, _SLOW = range(5)


def _kind(code: int) -> int:
    c = chr(code)
    if code in (0x20, *range(0x09, 0x0E)):
        return _SPACE
    if c == "'" or c.isspace() and not 0x1C <= code <= 0x1F:
        return _SLOW  # contractions and wide spaces are left to the library
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)


class Encoder:
    """Ids as the vocabulary's tokenizer gives them.

    Texts whose characters are all below U+0800 and which have no apostrophe are split into pieces by array operations;
    each piece is encoded once and remembered.  Other texts, and those that hold one of the vocabulary's added tokens, go
    through the library whole.  Both ways give the same ids.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        vocabulary: dict[str, int] = whole["model"]["vocab"]
        added = {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
        # Byte-level vocabularies write each byte as a printable character: itself, or the next one from U+0100.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and token not in added}
        self.library = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = [t.encode() for t in added]
        self.wide = max(*vocabulary.values(), *added.values()) > 0xFFFF
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.cache: dict[int, bytes] = {}
        self.one = np.array([_kind(b) if b < 0x80 else _OTHER for b in range(256)], dtype=np.uint8)
        self.two = np.array([_kind(c) for c in range(0x800)], dtype=np.uint8)

    def _bytes(self, text: str) -> bytes:
        return array("I" if self.wide else "H", self.library.encode(text, allowed_special="all")).tobytes()

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and the last end."""
        n = len(at) - 1
        kind = self.one[data]
        lead = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
        both = self.two[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
        kind[lead] = kind[lead + 1] = both
        kind[data >= 0xE0] = _SLOW
        slow = np.zeros(n, dtype=bool)
        slow[np.searchsorted(at, np.flatnonzero(kind == _SLOW), side="right") - 1] = True
        raw = data.tobytes()
        for token in self.added:
            place = raw.find(token)
            while place >= 0:
                slow[np.searchsorted(at, place, side="right") - 1] = True
                place = raw.find(token, place + 1)

        change = np.ones(len(data) + 1, dtype=bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[at] = True
        runs = np.flatnonzero(change[:-1])
        space = kind[runs] == _SPACE
        ends = np.append(runs[1:], len(data))
        inside = ~change[:-1]  # becomes: where pieces start
        inside[:] = False
        opening = np.zeros(len(data), dtype=bool)
        opening[at[:-1][at[:-1] < len(data)]] = True
        word = runs[~space]
        attached = (word > 0) & (data[word - 1] == 0x20) & ~opening[word]
        inside[word - attached] = True
        inside[runs[space]] = True
        last = ends[space]
        last = last[(last < len(data))]
        last = last[~opening[last]]  # a run of spaces that a text ends with stays whole
        inside[last - 1] = True
        starts = np.flatnonzero(inside)
        first = np.searchsorted(starts, at)
        if slow.any():
            keep = ~slow[np.searchsorted(at, starts, side="right") - 1]
            ends = np.append(starts[1:], len(data))[keep]
            starts = starts[keep]
            first = np.searchsorted(starts, at)
        else:
            ends = np.append(starts[1:], len(data))
        ids, counts = self._pieces(data, starts, ends)
        sums = np.concatenate(([0], np.cumsum(counts)))
        offsets = sums[first]
        if slow.any():
            parts, lengths = [], []
            for i in range(n):
                own = np.frombuffer(self._bytes(raw[at[i] : at[i + 1]].decode()), self.dtype) if slow[i] else ids[offsets[i] : offsets[i + 1]]
                parts.append(own)
                lengths.append(len(own))
            return np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)))
        return ids, offsets

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        keys, example, which = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        get = self.cache.get
        names = keys.tolist()
        found = [get(k) for k in names]
        raw = data.tobytes()
        for i, x in enumerate(found):
            if x is None:
                j = example[i]
                found[i] = self.cache[names[i]] = self._bytes(raw[starts[j] : ends[j]].decode())
        size = self.dtype.itemsize
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // size
        flat = np.frombuffer(b"".join(found), self.dtype)
        begin = np.cumsum(length) - length
        counts = length[which]
        where = np.repeat(begin[which] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return flat[where], counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
