"""The text index after refreshes against one built at once and against plain BM25; the stemmer against known stems."""

import math
import random
import re

from pyspark.sql import functions as F

from sparkloom.functions.porter import stem, stemmed
from sparkloom.operators import textindex as T


def plain(docs, words, of=lambda w: w):
    """Score of each document for a set of words."""
    bags = {d: [of(w) for w in re.findall(r"[^\W_]+", (t or "").lower())] for d, t in docs.items()}
    mean = sum(map(len, bags.values())) / len(bags)
    out = {}
    for w in {of(x) for x in words}:
        df = sum(w in b for b in bags.values())
        for d, b in bags.items():
            if tf := b.count(w):
                idf = max(1e-6, math.log((len(bags) - df + 0.5) / (df + 0.5)))
                out[d] = out.get(d, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))
    return out


def test_refreshed_index_equals_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)  # so that terms have several blocks and segments several sizes
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["Éclair"]
    text = lambda: None if rnd.random() < 0.05 else " ".join(rnd.choices(vocabulary, weights=range(31, 0, -1), k=rnd.randint(0, 25)))
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, text string")
    index, now = T.TextIndex(spark, str(tmp_path / "a"), buckets=4), {}
    for step in range(6):
        changed = {rnd.randrange(60): text() for _ in range(15)}
        gone = rnd.sample(range(60), 4)
        index.refresh(frame(list(changed.items())), "id", "text", frame([(g, None) for g in gone]))
        now = {d: t for d, t in (now | changed).items() if d in changed or d not in gone}
    assert len(index._numbers()) < 6  # some were merged
    whole = T.TextIndex(spark, str(tmp_path / "b"), buckets=4)
    whole.refresh(frame(list(now.items())), "id", "text")
    asked = [("common", "W0"), ("common", "w1"), ("rare", "éclair"), ("rare", "w29"), ("none", "nothing")]
    df = spark.createDataFrame(asked, "query string, word string")
    got = [sorted(map(tuple, i.search(df).collect())) for i in (index, whole)]
    assert got[0] == got[1]
    for q in ("common", "rare", "none"):
        found, want = {d: s for query, d, s in got[0] if query == q}, plain(now, [w.lower() for query, w in asked if query == q])
        assert found.keys() == want.keys() and all(abs(found[d] - want[d]) < 2e-6 for d in want)
    assert whole._blocks(0).groupBy("term").count().where("count > 1").count() > 0


def test_reads_touch_only_the_terms(spark, tmp_path):
    index = T.TextIndex(spark, str(tmp_path / "a"), stemmed, buckets=4)
    index.refresh(spark.createDataFrame([(1, "connecting hopes"), (2, "connection"), (3, "other relational things")], "id bigint, text string"), "id", "text")
    found = index.search(spark.createDataFrame([(0, "connected"), (0, "hoping")], "query int, word string"))
    assert {r.doc for r in found.collect()} == {1, 2}
    plan = index._live([0], lambda b: b.where(F.col("term").isin("connect", "hope")))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [connect,hope])" in plan or "In(term" in plan
    empty = T.TextIndex(spark, str(tmp_path / "b"))
    assert empty.search(spark.createDataFrame([(0, "x")], "query int, word string")).collect() == []


def test_pieces_are_made_where_the_postings_are():
    """Words of whole documents become pieces of blocks inside a task: counts summed, no piece over the block, none of two terms."""
    import pyarrow as pa

    rows = pa.table({"doc": pa.array([1, 1, 1, 2, 3, 3, 9]), "term": ["b", "a", "b", "b", "b", "c", "b"], "tf": pa.array([1, 1, 1, 1, 1, 2, 1], pa.int64())})
    got = [r for batch in T._pieces(rows, 2) for r in batch.to_pylist()]
    assert sorted((r["term"], tuple(zip(r["docs"], r["tfs"]))) for r in got) == [("a", ((1, 1),)), ("b", ((1, 2), (2, 1))), ("b", ((3, 1), (9, 1))), ("c", ((3, 2),))]


def test_every_word_of_an_item_is_asked_for(spark, tmp_path):
    """The word that tells documents apart stands after many others."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from sparkloom.plans import catalog

    item = "the plain words that all of them have come before the zebra"
    docs = ["zebra alone here", "nothing of it here", None, "the plain words that are elsewhere", "other things here", "more things here", "things here"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(docs)), pa.int64()), "text": docs}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([5], pa.int64()), "text": [item]}), tmp_path / "benchmark.parquet")
    got = catalog.queries()["text_index_search"](spark, str(tmp_path)).orderBy("rank").collect()
    want = plain(dict(enumerate(docs)), item.split())
    assert {r.doc for r in got} == {0, 3, 1} & want.keys() and [(r.query, r["rank"]) for r in got] == [(5, i + 1) for i in range(len(got))]
    assert all(abs(r.score - want[r.doc]) < 2e-6 for r in got)


def test_the_best_are_those_of_all_scores(spark, tmp_path, monkeypatch):
    from pyspark.sql import Window

    from sparkloom.sources.scratch import Rounds

    monkeypatch.setattr(T, "QUERIES", 2)
    monkeypatch.setattr(T, "DOCS", 7)
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choices([f"w{i}" for i in range(40)], weights=range(41, 1, -1), k=n))
    index = T.TextIndex(spark, str(tmp_path / "a"), buckets=4)
    index.refresh(spark.createDataFrame([(d, text(9)) for d in range(150)], "id bigint, text string"), "id", "text")
    index.refresh(spark.createDataFrame([(d, text(rnd.randint(0, 12))) for d in range(90)], "id bigint, text string"), "id", "text", spark.createDataFrame([(140,)], "id bigint"))
    asked = spark.createDataFrame([(q, w) for q in "abcde" for w in text(8).split()] + [("none", "nothing"), (None, "w3")], "query string, word string")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    want = index.search(asked).withColumn("rank", F.row_number().over(order)).where("rank <= 4").select("query", "doc", "score", "rank")
    with Rounds(spark, "best") as rounds:
        got = index.best(asked, 4, rounds).collect()
    assert len(got) == 24 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want.collect())))


def test_known_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
        "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
        "vileli": "vile", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
        "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
        "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adoption": "adopt", "communism": "commun", "activate": "activ",
        "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "2nd": "2nd",
    }
    assert {w: stem(w) for w in known} == known
