"""Exact token counts of every prefix of every text, by dynamic programming over prefixes.

In a byte-pair encoding each prefix of a piece (a word with its leading space, a run of digits, of signs or of white space)
ends with exactly one token that also fits the last token before it, where two tokens fit if the pair encodes to itself.  So
the last token of a prefix follows from those of shorter prefixes, and ``count[i] = count[i - size of the last token] + 1``.
That is done once for each distinct piece; a text's counts are the sums of the pieces before plus the counts inside a piece.

A prefix is encoded on its own, so counts can fall as a prefix grows.  Three places are looked after: a run of white space is
one piece as long as nothing follows, but gives up its last character to what follows; contractions are whole only with
their last letter; the vocabulary's added tokens (``<|endoftext|>``) are ordinary text until their last character.

``prefix_table`` stores the counts in blocks of code points; ``tokens_at``, ``longest_within`` and ``truncated`` answer from
the stored table without encoding anything again.

Defined results: a null or empty text has one block without counts and no tokens; very long texts have as many blocks as
they need, and no row holds more than one; repeated rows each have their blocks; no rows give no rows; other columns pass
through, but for ``text`` and those named like the ones added, which are replaced.  Where several prefixes share a count,
the longest is taken.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import unused
from ._words import columns, hashes, slices

#: Code points in a block of counts.
BLOCK = 1 << 16
#: Pieces that a worker remembers, about 250 bytes each; longer ones than ``KEEP_BYTES`` are not remembered.
CACHE_PIECES = 400_000
KEEP_BYTES = 64
#: Pairs of tokens that a worker remembers.
CACHE_PAIRS = 500_000
#: Tokens above which ``op11`` reports a text.
LIMIT = 512

#: The contractions that the vocabulary's tokenizer takes for pieces (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_LETTER, _NUMBER, _SPACE, _SIGN, _SLOW = range(5)
#: Characters that count as white space in patterns; Python has four more.
_SPACES = {chr(c) for c in range(0x3001) if chr(c).isspace()} - {chr(c) for c in range(0x1C, 0x20)}


def _kind(code: int) -> int:
    import unicodedata

    c = chr(code)
    if c in _SPACES:
        return _SPACE if code < 0x80 else _SLOW
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _SIGN)


class PrefixCounter:
    """Counts for texts in a row, with a tokenizer of byte-level pairs (a ``tokenizers`` file)."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        self.added = [t["content"] for t in whole.get("added_tokens", ())]
        if any(a != b and a in b for a in self.added for b in self.added):
            raise ValueError("an added token lies inside another")
        self.tokens = [t for t in whole["model"]["vocab"] if t not in self.added]
        #: Finds every token that ends at each place of a piece; its value is the token's number here and its size.
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        # Byte-level vocabularies write each byte as a printable character: itself, or the next one from U+0100.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.printed = {b: rest.get(b, b) for b in range(256)}
        self.pieces: dict[int, bytes] = {}
        #: Whether tokens fit, by their numbers; -1 stands for the beginning.
        self.fits: dict[tuple[int, int], bool] = {}
        self.one = np.array([_kind(b) if b < 0x80 else _SIGN for b in range(256)], dtype=np.uint8)
        self.two = np.array([_kind(c) for c in range(0x800)], dtype=np.uint8)

    # --- one piece ---

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b can follow token a, or begin."""
        if len(self.fits) > CACHE_PAIRS:
            self.fits.clear()
        tokens = [self.tokens[i] for i in (a, b) if i >= 0]
        fit = self.fits[a, b] = [t.value for t in self.tokenizer.model.tokenize("".join(tokens))] == tokens
        return fit

    def chain(self, piece: str) -> tuple[list[int], list[int]]:
        """For each prefix of a piece (printed bytes, from none on), its count and its last token."""
        count, last = [0] * (len(piece) + 1), [-1] * (len(piece) + 1)
        known, done = self.fits.get, 0
        for at, (token, size) in self.automaton.iter(piece):
            end = at + 1
            if end == done:
                continue
            before = end - size
            fit = known((last[before], token))
            if fit or fit is None and self._fit(last[before], token):
                last[end], count[end], done = token, count[before] + 1, end
        if 0 in count[1:]:
            raise ValueError("the vocabulary has no token for a byte")
        return count, last

    def of_piece(self, piece: bytes) -> bytes:
        """Counts of the prefixes of a piece, one for each code point, 4 bytes each."""
        plain = piece.decode("latin-1")
        count = self.chain(plain.translate(self.printed))[0]
        if plain in CONTRACTIONS:
            count[1:-1] = range(1, len(piece))  # its first letters are pieces of their own
        if piece.isascii():
            return array("i", count[1:]).tobytes()
        return array("i", [n for n, following in zip(count[1:], [*piece[1:], 0]) if following & 0xC0 != 0x80]).tobytes()

    # --- texts ---

    def counts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the prefixes of 1, 2, ... code points of all texts in a row, and where each text's counts begin."""
        kind = self.one[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        kind[lead] = kind[lead + 1] = self.two[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
        kind[data >= 0xE0] = _SLOW
        slow = np.zeros(len(at) - 1, dtype=bool)
        slow[np.searchsorted(at, np.flatnonzero(kind == _SLOW), side="right") - 1] = True
        raw = data.tobytes()
        for token in self.added:
            place = raw.find(token.encode())
            while place >= 0:
                slow[np.searchsorted(at, place, side="right") - 1] = True
                place = raw.find(token.encode(), place + 1)
        if not slow.any():
            return self._summed(data, at, self._starts(data, at, kind), kind == _SPACE)
        found, lengths = [], [0]
        for i in range(len(at) - 1):
            own, inside = data[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]])
            if slow[i]:
                found.append(self._with_added(raw[at[i] : at[i + 1]].decode()))
            else:
                here = kind[at[i] : at[i + 1]]
                found.append(self._summed(own, inside, self._starts(own, inside, here), here == _SPACE)[0])
            lengths.append(len(found[-1]))
        return np.concatenate(found), np.cumsum(lengths)

    def _with_added(self, text: str) -> np.ndarray:
        """One text, cut at the added tokens in it."""
        out, base, here = [np.zeros(0, np.int32)], 0, 0
        while True:
            met = min(((p, t) for t in self.added if (p := text.find(t, here)) >= 0), default=None)
            if met is None:
                out.append(base + self._by_library(text[here:]))
                return np.concatenate(out).astype(np.int32)
            place, token = met
            part = self._by_library(text[here : place + len(token) - 1])  # the token's own prefixes are ordinary text
            out.append(base + part)
            base += 1 + (int(part[place - here - 1]) if place > here else 0)
            out.append(np.array([base], np.int32))
            here = place + len(token)

    def _by_library(self, text: str) -> np.ndarray:
        """One text without added tokens, cut into pieces by the library."""
        sizes = np.array([len(c.encode()) for c in text], np.int64)
        byte = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(text.encode(), np.uint8)
        starts = byte[[a for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if b > a]] if text else np.zeros(0, np.int64)
        space = np.repeat(np.array([c in _SPACES for c in text], bool), sizes)
        return self._summed(data, np.array([0, len(data)]), starts, space)[0]

    @staticmethod
    def _starts(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where the pieces begin."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        edge = np.zeros(n + 1, dtype=bool)
        edge[0] = True
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[at] = True
        opening = np.zeros(n + 1, dtype=bool)
        opening[at] = True
        run = np.flatnonzero(edge[:-1])
        end = np.append(run[1:], n)
        space = kind[run] == _SPACE
        begins = np.zeros(n + 1, dtype=bool)
        word = run[~space]
        taken = (word > 0) & ~opening[word]  # a blank before a word belongs to it
        taken &= data[word - 1] == 0x20
        begins[word - taken] = True
        begins[run[space]] = True
        last = end[space]
        begins[last[~opening[last]] - 1] = True  # white space gives its last character up, but not where the text ends
        apart = word[~taken & (data[word] == 0x27)]
        apart = apart[(apart + 1 < n) & ~opening[np.minimum(apart + 1, n)]]
        for text in CONTRACTIONS:
            letters = np.frombuffer(text.encode(), np.uint8)
            met = apart[apart + len(letters) <= n]
            for i in range(1, len(letters)):
                met = met[(data[met + i] == letters[i]) & ~opening[met + i]]
            begins[met + 1] = False
            after = met + len(letters)
            begins[after[after < n]] |= kind[after[after < n]] == _LETTER
        return np.flatnonzero(begins[:-1])

    def _summed(self, data: np.ndarray, at: np.ndarray, starts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all texts from their pieces, and where each text's counts begin."""
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        if not len(starts):
            return np.zeros(0, np.int32), chars[at]
        ends = np.append(starts[1:], len(data))
        which, flat, begin, sizes = self._looked_up(data, starts, ends)
        total = flat[begin + sizes - 1][which].astype(np.int64)
        before = np.cumsum(total) - total
        first = np.searchsorted(starts, at[:-1])
        text = np.searchsorted(at, starts, side="right") - 1
        before -= np.append(before, 0)[first][text]
        n = sizes[which]
        place = np.cumsum(n) - n
        out = flat[np.repeat(begin[which] - place, n) + np.arange(n.sum())] + np.repeat(before, n).astype(np.int32)
        blank = np.flatnonzero(space[starts[:-1]] & space[ends[:-1] - 1] & space[starts[1:]] & (text[1:] == text[:-1]))
        if len(blank):  # up to the last character of a run, the run is one piece
            lead = data[starts[blank + 1]]
            stop = starts[blank + 1] + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            which, flat, begin, sizes = self._looked_up(data, starts[blank], stop)
            out[place[blank + 1]] = before[blank] + flat[begin + sizes - 1][which]
        return out, chars[at]

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which distinct piece each is; the counts of all distinct pieces in a row, where each begins and how many it has."""
        keys, example, which = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        names, raw = keys.tolist(), data.tobytes()
        found = [self.pieces.get(k) for k in names]
        for i, known in enumerate(found):
            if known is None:
                piece = raw[starts[example[i]] : ends[example[i]]]
                found[i] = self.of_piece(piece)
                if len(piece) <= KEEP_BYTES:
                    self.pieces[names[i]] = found[i]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return which, np.frombuffer(b"".join(found), np.int32), np.cumsum(sizes) - sizes, sizes


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One a worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ADDED = ("n_bytes", "block", "start", "last", "counts")


def prefix_table(documents: DataFrame, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """Columns of ``documents`` but ``text``, plus ``n_bytes`` (UTF-8, of the text), ``block`` (its number), ``start`` (code points
    before it), ``last`` (whether it ends the text) and ``counts``: tokens of the prefixes of start + 1, start + 2, ... code points.
    """
    fields = [c for c in documents.columns if c.lower() not in (*_ADDED, "text")]
    (size,) = unused(documents, "n_bytes")
    plain = documents.select(*fields, "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias(size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = counter(vocabulary or default_vocabulary())
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                flat, offsets = code.counts(data, at)
                per = np.maximum(1, -(-np.diff(offsets) // block))
                of = np.repeat(np.arange(part.num_rows), per)
                number = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
                begin = offsets[of] + number * block
                last = number == per[of] - 1
                for a in range(0, len(of), 1 + (1 << 22) // block):  # few blocks of a very long text at once
                    b = min(len(of), a + 1 + (1 << 22) // block)
                    edges = np.append(begin[a:b], offsets[of[b - 1] + 1] if last[b - 1] else begin[b - 1] + block)
                    values = pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(flat[edges[0] : edges[-1]]))
                    own = [x.take(pa.array(of[a:b])) for x in columns(part, *fields, size)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(number[a:b]), pa.array(number[a:b] * block), pa.array(last[a:b]), values], [*fields, *_ADDED])

    none = "cast(null as bigint) as block", "cast(null as bigint) as start", "cast(null as boolean) as last", "cast(null as array<int>) as counts"
    return plain.mapInArrow(count, plain.selectExpr(*(f"`{c}`" for c in fields), f"`{size}` as n_bytes", *none).schema)


def n_tokens() -> F.Column:
    """Tokens of the whole text, on its last block."""
    return F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)).cast("long")


def tokens_at(prefixes: DataFrame, questions: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``questions`` (``key``, ``n_chars``, others) plus ``n_tokens`` of the prefix of so many code points; null beyond the text."""
    asked = questions.drop("n_tokens", "block").withColumn("block", F.greatest(F.lit(0), F.floor((F.col("n_chars") - 1) / block)).cast("long"))
    there = prefixes.select(key, "block", "start", "counts")
    (start, counts) = unused(asked, "start", "counts")
    met = asked.join(there.withColumnsRenamed({"start": start, "counts": counts}), [key, "block"], "left")
    inside = F.when(F.col("n_chars") > 0, F.try_element_at(counts, (F.col("n_chars") - F.col(start)).cast("int")))
    return met.withColumn("n_tokens", F.when((F.col("n_chars") == 0) & F.col(start).isNotNull(), 0).otherwise(inside).cast("long")).drop("block", start, counts)


def longest_within(prefixes: DataFrame, budget: int, *key: str) -> DataFrame:
    """For each ``key``: ``n_chars``, the most code points whose prefix has at most ``budget`` tokens, and its ``n_tokens``."""
    fits = F.transform("counts", lambda c, i: F.when(c <= budget, F.struct((F.col("start") + i + 1).alias("n_chars"), c.cast("long").alias("n_tokens"))))
    none = F.struct(F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("n_tokens"))
    return prefixes.groupBy(*key).agg(F.max(F.coalesce(F.array_max(fits), none)).alias("most")).select(*key, "most.n_chars", "most.n_tokens")


def truncated(documents: DataFrame, prefixes: DataFrame, budget: int, key: str) -> DataFrame:
    """``documents`` with ``text`` cut to the longest prefix of at most ``budget`` tokens; ``key`` is unique."""
    n, used = unused(documents, "n_chars", "n_tokens")
    cut = longest_within(prefixes, budget, key).withColumnsRenamed({"n_chars": n, "n_tokens": used})
    text = F.col("text").substr(F.lit(1), F.col(n).cast("int"))
    return documents.join(cut, key, "left").withColumn("text", text).drop(n, used).select(documents.columns)


def op11(documents: DataFrame) -> DataFrame:
    """The contract's columns: one row per document, from the last block of its counts."""
    whole = prefix_table(documents.select("doc_id", "text")).where("last")
    return whole.select("doc_id", "n_bytes", n_tokens().alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
