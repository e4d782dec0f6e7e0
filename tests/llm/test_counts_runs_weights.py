"""Prefix token counts, periodic runs and importance resampling: against brute force, and on nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import periodic, prefixcounts, resampling
from sparkloom.llm._shared import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "n_bytes block start last counts n_words runs longest collapsed key n_features weight score rank n_chars n_tokens"


@pytest.fixture(scope="module")
def counter():
    return prefixcounts.PrefixCounter(prefixcounts.default_vocabulary())


def library(counter, texts):
    return [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


def odd(spark):
    """Nulls, empty and long texts, repeats, and columns named like those inside."""
    names = CLASHING.split()
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 30), (4, "a b " * 30), (None, "x y x y x y x y"), (None, None), (7, "w" * 70_000), (8, " ".join(f"u{i % 7}" for i in range(30_000))), (9, "漢字 it's <|endoftext|> é")]
    return spark.createDataFrame([(i, t, *range(len(names))) for i, t in texts], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))


# --- prefix token counts ---


def test_counts_of_every_prefix(counter):
    rnd = random.Random(7)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "'r", "l", "S", "1", "22", "!", "...", "é", "ß", " ", "\u0085", "　", "漢", "😀", "<|endoftext|>", "<|", "endoftext", "\x1c", "-" * 16, "=", "́", "²"]
    for n in (12, 16, len(parts)):
        texts = ["".join(rnd.choice(parts[:n]) for _ in range(rnd.randint(0, 25))) for _ in range(150)]
        raw = [t.encode() for t in texts]
        flat, offsets = counter.counts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
        for i, text in enumerate(texts):
            assert flat[offsets[i] : offsets[i + 1]].tolist() == (library(counter, [text[:k] for k in range(1, len(text) + 1)]) if text else []), repr(text)


def test_last_tokens_spell_the_encoding(counter):
    """Going back by the last tokens gives the library's own encoding, for pieces of any kind."""
    rnd = random.Random(3)
    for piece in ["tokenization", "a" * 500, "=-" * 300, *("".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 30))) for _ in range(200))]:
        printed = piece.encode().decode("latin-1").translate(counter.printed)
        count, last = counter.chain(printed)
        spelled, at = [], len(printed)
        while at:
            spelled.append(counter.tokens[last[at]])
            at -= len(spelled[-1])
        assert spelled[::-1] == [t.value for t in counter.tokenizer.model.tokenize(printed)] and len(spelled) == count[-1]


def test_op11(spark, sf, counter):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in prefixcounts.op11(docs).collect():
        (n,) = library(counter, [texts[r.doc_id]])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_prefix_table(spark, counter):
    docs = odd(spark)
    held = prefixcounts.prefix_table(docs, block=1000).cache()
    assert sorted(held.columns) == sorted({*docs.columns, *prefixcounts._ADDED} - {"text"})
    want = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    assert held.where("last").count() == docs.count() and held.where("doc_id = 7").count() == 70
    for doc, text in want.items():
        rows = {r.block: r for r in held.where(f"doc_id = {doc}").collect()}
        assert sum(len(r.counts) for r in rows.values()) == len(text) and all(r.start == 1000 * b for b, r in rows.items())
    assert {r.weight for r in held.collect()} == {11}
    ids = sorted((r.doc_id or -1, r.n_tokens) for r in prefixcounts.op11(docs).collect())
    assert ids == sorted((r.doc_id or -1, library(counter, [r.text or ""])[0]) for r in docs.collect())
    assert prefixcounts.op11(docs.limit(0)).collect() == []


def test_questions_without_encoding(spark, sf, counter):
    docs = table(spark, sf, "documents").where("doc_id < 40").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    held = prefixcounts.prefix_table(docs, block=256).cache()
    asked = spark.createDataFrame([(d, n, 5) for d in texts for n in (0, 1, 255, 256, 257, len(texts[d]), len(texts[d]) + 1)] + [(None, 1, 5), (9999, 0, 5)], "doc_id bigint, n_chars bigint, start int")
    for r in prefixcounts.tokens_at(held, asked, "doc_id", block=256).collect():
        text = texts.get(r.doc_id)
        assert r.start == 5 and r.n_tokens == (None if text is None or r.n_chars > len(text) else library(counter, [text[: r.n_chars]])[0] if r.n_chars else 0)
    for r in prefixcounts.longest_within(held, 50, "doc_id").collect():
        counts = [0, *library(counter, [texts[r.doc_id][:k] for k in range(1, min(len(texts[r.doc_id]), 600) + 1)])]
        assert r.n_chars == max(k for k, n in enumerate(counts) if n <= 50) and r.n_tokens == counts[r.n_chars] <= 50
    cut = {r.doc_id: r.text for r in prefixcounts.truncated(docs, held, 50, "doc_id").collect()}
    assert all(texts[d].startswith(t or "") and library(counter, [t or ""])[0] <= 50 for d, t in cut.items()) and len(cut) == len(texts)
    assert prefixcounts.longest_within(prefixcounts.prefix_table(odd(spark)), 0, "doc_id").where("n_chars > 0 or n_tokens > 0").count() == 0


# --- periodic runs ---


def plain_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("least,exponent", [(6, 4), (1, 4), (9, 5)])
def test_runs_equal_brute_force(least, exponent):
    rnd = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(0, 4)):
            w = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 70))]
            if w and rnd.random() < 0.6:
                a = rnd.randrange(len(w))
                p = 1 + (len(w) - a) // rnd.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w)
        at = np.concatenate(([0], np.cumsum([len(w) for w in texts], dtype=np.int64)))
        got = periodic.runs(np.array(sum(texts, []), np.int64), at, least, exponent)
        assert got == [plain_runs(w, least, exponent) for w in texts]


def test_runs_of_very_long_texts():
    assert periodic.runs(np.zeros(50_000, np.int64), np.array([0, 50_000])) == [[(0, 50_000, 1)]]
    assert periodic.runs(np.arange(40_000) % 10_000, np.array([0, 40_000])) == [[(0, 40_000, 10_000)]]
    assert periodic.runs(np.arange(40_000), np.array([0, 40_000])) == [[]]
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.int64), np.array([0, 9]), exponent=3)


def test_z_function():
    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.randrange(2) for _ in range(rnd.randint(0, 20))]
        assert periodic.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_op12_odd_rows(spark):
    docs = odd(spark)
    rows = periodic.op12(docs).collect()
    assert len(rows) == docs.count() and periodic.op12(docs.limit(0)).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].n_runs, by[1].start, by[1].collapsed_sha256, by[3].runs_sha256) == (0, None, nothing, nothing)
    plain = {r.doc_id: r for r in periodic.periodic(docs).where("text is not null").collect()}
    assert [tuple(x) for x in plain[4].runs] == [(0, 60, 2)] and plain[4].collapsed == "a b" and tuple(plain[8].longest) == (0, 30_000, 7)
    assert [tuple(x) for x in plain[None].runs] == [(0, 8, 2)] and plain[None].collapsed == "x y" and plain[7].n_words == 1
    assert sorted(periodic.periodic(docs).columns) == sorted(docs.columns) and plain[4].weight == 11


# --- importance resampling ---


def plain_features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain_weights(docs, items):
    rows = [(d, *plain_features(t)) for d, t in docs]
    source, target = sum((c for _, _, c in rows), Counter()), sum((plain_features(t)[1] for t in items), Counter())
    s, t = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000)))) for b in source}
    out = []
    for d, n, c in rows:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        out.append((d, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0]))
    rank = {x[0]: i + 1 for i, x in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((x[0], *x[2:], rank.get(x[0])) for x in out), key=repr)


def test_op13(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = sorted((tuple(r) for r in resampling.op13(docs, items).collect()), key=repr)
    assert got == plain_weights([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])


def test_op13_odd_rows(spark):
    docs = odd(spark)
    items = spark.createDataFrame([("i", "a b a b"), (None, None), ("i", "漢字 it"), ("j", "")], "item_id string, text string")
    got = sorted((tuple(r) for r in resampling.op13(docs, items).collect()), key=repr)
    assert got == plain_weights([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    assert resampling.op13(docs.limit(0), items).collect() == [] and resampling.op13(docs, items.limit(0)).count() == docs.count()


def test_ranks_break_ties_and_count_repeats(spark):
    rows = [(i % 50, 20, 3, 7, 5) for i in range(100)] + [(None, 20, 3, 7, 5), (3, 19, 1, 9, 99)]
    scored = spark.createDataFrame(rows, "key bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    taken = sorted((r["rank"], r.key) for r in resampling.drawn(scored, percent=6).where("rank is not null").collect())
    assert taken == [(1, None), (2, 0), (3, 0), (4, 1), (5, 1), (6, 2)]


def test_matrix_is_the_counts(spark, sf, monkeypatch):
    """Blocks hold each document's counts, also where a text is hashed in several parts."""
    docs = table(spark, sf, "documents").where("doc_id < 30").select("doc_id", "text").collect()
    for step in (50, 1 << 18):
        monkeypatch.setattr(resampling, "STEP_WORDS", step)
        raw = [(r.text or "").encode() for r in docs]
        per, cells, counts = resampling._row_counts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))), 3, 10_000)
        for i, r in enumerate(docs):
            n, want = plain_features(r.text)
            own = cells // 10_000 == i
            assert per[i] == n and dict(zip((cells[own] % 10_000).tolist(), counts[own].tolist())) == want
    long = ("x" * 100 + "é" * 200 + " b").encode()
    starts, ends = np.array([0, 501]), np.array([500, 502])
    got = [int(x[0]) for _, x in resampling.gram_buckets(np.frombuffer(long, np.uint8), starts, ends, np.array([1, 0]), 2, 10_000)]
    assert got == [zlib.crc32(long[:500]) % 10_000, zlib.crc32(long) % 10_000]
