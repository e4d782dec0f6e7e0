"""The pipeline over the smallest documents, stage by stage against plain versions of what each stage decides."""

import collections
import re

import corpus_pipeline
from sparkloom.llm import linededup
from sparkloom.llm._shared import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = "[^\x20\x09-\x0d]+"


def cut_lines(texts):
    seen, out = set(), {}
    for doc, text in sorted(texts.items()):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if re.search(SPACE, x)]
        gone = set()
        for a in range(len(full)):
            n = 0
            for b in range(a, len(full)):
                n += len(re.findall(SPACE, lines[full[b]]))
                if n >= linededup.MIN_WORDS:
                    run = tuple(lines[i] for i in full[a : b + 1])
                    if run in seen:
                        gone |= set(full[a : b + 1])
                    seen.add(run)
        if not gone or len(gone) < len(full):
            out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def first_of_groups(texts):
    sets = {}
    for doc, text in texts.items():
        w = re.findall(SPACE, text.translate(LOW))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {d: t for d, t in texts.items() if least[d] == d}


def clean(texts, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for item in items:
        w = word.findall(item.translate(LOW))
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    out = {}
    for doc, text in texts.items():
        w, hit = word.findall(text.translate(LOW)), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out[doc] = text
    return out


def test_stages_against_plain_versions(spark, sf):
    docs = table(spark, sf, "documents")
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    want = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    plain = {"language ID": lambda t: t, "line dedup": cut_lines, "MinHash near-dedup": first_of_groups, "benchmark decontamination": lambda t: clean(t, items)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs.cache()
        want = plain[name](want)
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = collections.Counter()
    tokens = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        pieces[r.doc_id] += r.length
        tokens[r.doc_id] = r.doc_tokens
    assert pieces == tokens and set(tokens) == set(want)


def test_thresholds_come_from_all_labelled_texts(spark, monkeypatch):
    from sparkloom.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes, real = [], langid.identify
    monkeypatch.setattr(langid, "identify", lambda rows, model: (sizes.append(rows.count()), real(rows, model))[1])
    corpus_pipeline.identify_language(spark, docs, "/root/testdata/sf0.1")
    assert sizes[0] == docs.where(~langid.held_out()).where("lang is not null").count() > 4000
