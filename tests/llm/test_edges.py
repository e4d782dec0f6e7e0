"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import article, decontam, interleaved, langid, linededup, minhash, packing, pii, urlfilter, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, a int, b int, queue int, `key` string, html string, th int"
LINE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"word{i % 977} x{i}" for i in range(40_000))


def documents(spark, texts):
    rows = [(i, t, "en" if t and (i or 0) % 2 else None, None if (i or 0) % 3 else "s", 1, "n", 1, 2, 3, "k", "h", 4) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, None), (2, ""), (3, "  \n\t"), (4, LINE), (5, LINE), (5, LINE), (6, f"head\n{LINE}\ntail words here"), (None, LINE), (None, None), (7, LONG), (8, "a b"), (9, "a b"), (10, "é ß 日本 😀"), (11, "12 34 !!")]
    return documents(spark, texts)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_op1(docs, none):
    rows = langid.op1(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == by[11].lang_pred == "und"
    assert by[4].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    assert langid.op1(none).collect() == []


def test_op2(docs, none):
    rows = linededup.op2(docs).collect()
    assert len(rows) == docs.count()
    removed = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in rows)
    assert removed == [(-1, 0), (-1, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (5, 1), (6, 1), (7, 0), (8, 0), (9, 0), (10, 0), (11, 0)]
    by = {r.doc_id: r for r in rows}
    assert by[6].text == "head\ntail words here" and by[1].text is None and by[2].text == ""
    assert linededup.op2(none).collect() == []


def test_op3(spark):
    urls = [None, "", "x", "http://", "https://A.EXAMPLE.net/en/1?x#y", "https://net", "http://net/", "http://a.org/fr/", "http://a.example.com/de/x/y/z/w", "ftp://u:p@H.org:80?q", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)] + [(4, urls[4], "h", "t"), (None, urls[4], "h", "t")], "page_id int, url string, host string, template string")
    by = {r.page_id: r for r in urlfilter.op3(pages).collect()}
    assert urlfilter.op3(pages).count() == pages.count()
    assert [(by[i].host, by[i].path, by[i].rule, by[i].verdict) for i in range(11)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/1", "example.net/en/", "allow"), ("net", "", None, "allow"),
        ("net", "/", "net/", "block"), ("a.org", "/fr/", "org/fr/", "allow"), ("a.example.com", "/de/x/y/z/w", "example.com/de/", "block"), ("u:p@h.org:80", "", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]
    assert urlfilter.op3(pages.limit(0)).collect() == []


def test_op3_generalises_labels(spark):
    bad = [(i, f"http://shop.test/buy/{i}.html") for i in range(60)] + [(100, "http://shop.test/buy/a"), (101, "http://shop.test/news/1")]
    pages = spark.createDataFrame(bad, "page_id int, url string")
    rules = (*[(f"shop.test/buy/{i}.html", "block") for i in range(50)],)
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, rules).collect()}
    assert got[55] == "block" and got[100] == got[101] == "allow"


def test_op4(docs, none):
    rows = minhash.op4(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[4].component_id, by[5].component_id, by[6].component_id, by[8].component_id, by[9].component_id) == (4, 4, 6 if 58 * 100 < 85 * 62 else 4, 8, 8)
    assert (by[1].n_shingles, by[1].component_id, by[1].kept, by[8].n_shingles) == (0, 1, True, 1)
    assert sum(r.kept for r in rows if r.doc_id in (4, 5)) == 1
    assert minhash.op4(none).collect() == []


def test_op3_long_urls(spark):
    rows = [(1, "http://a.net/" + "x/" * 300 + "y" * 100_000), (2, "http://a.net/" + "x/" * 300 + "z"), (3, "http://" + "h" * 50_000)]
    rows += [(10 + i, "http://trap.org/" + "a/b/" * i) for i in range(60)]  # each path goes on from the one before
    spark.sparkContext.setJobGroup("long urls", "")
    try:
        got = {r.page_id: r.verdict for r in urlfilter.op3(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == {1: "block", 2: "block", 3: "allow"} | {10 + i: "allow" for i in range(60)}
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("long urls")) < 60


def test_op5_entities(spark):
    rows = [(1, "a@b.co +1 555 123 4567"), (1, "a@b.co +1 555 123 4567"), (None, "1.2.3.4, 4111 1111 1111 1111"), (2, None)]
    got = sorted((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0, 1, 1, 0), (1, 1, 0, 0, 1), (1, 1, 0, 0, 1), (2, 0, 0, 0, 0)]


def test_clashing_columns(spark):
    """Operators, not only the queries, on tables that have the names of what they add or use inside."""
    names = "score n_words hits items n_lines n_removed removed base terms window queue node a b th did cuts row lang_pred n_grams contaminated n_hit round block".split()
    df = spark.createDataFrame([(1, LINE, "en", "s", *range(len(names))), (2, LINE, "en", None, *range(len(names)))], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    items = spark.createDataFrame([("i", LINE)], "item_id string, text string")
    model = langid.learn(df.select("lang", "text"))
    for out, added in (
        (langid.identify(df, model), {"lang_pred", "score", "n_grams"}), (linededup.dedup_lines(df), {"n_lines", "n_removed", "removed"}), (pii.with_spans(df), {"base", "terms"}),
        (decontam.verdicts(decontam.contamination(df, items)), {"n_words", "hits", "items", "n_hit", "contaminated"}), (decontam.contamination(df, items, shard_words=20), {"n_words", "hits", "items"}),
    ):
        assert sorted(out.columns) == sorted({*df.columns, *added}) and len(out.collect()) == 2
        kept = [c for c in df.columns if c not in added and c != "text"]
        assert [tuple(r) for r in out.orderBy("doc_id").select(*kept).collect()] == [tuple(r) for r in df.orderBy("doc_id").select(*kept).collect()]
    assert len(minhash.near_duplicates(df).collect()) == 2 and packing.packed(df).count() == 2


def test_op5(docs, none):
    assert pii.op5(docs).count() == docs.count()
    assert {r.base_sha256 for r in pii.op5(docs).collect()} == {hashlib.sha256(b"").hexdigest()}
    assert pii.op5(none).collect() == []


def test_op6(docs, none):
    rows = interleaved.op6(docs).collect()
    assert len(rows) == docs.count() and {r.payload_bytes % 576 for r in rows} == {0}
    empty = [r for r in rows if r.n_bytes == 0]
    assert len(empty) == 3 and len({r.feature for r in empty}) == 1
    assert interleaved.op6(none).collect() == []


def test_op7(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<article><p>a &amp; b<p>c", "t"), (3, "u", "<p><<<>><!-- x", "t"), (4, "u", "<article>" + "<p>word</p>" * 3000, "t")], "page_id int, url string, html string, text string")
    by = {r.page_id: r for r in article.op7(pages).collect()}
    assert by[1].text == by[2].text == "" and by[None].text == "a & b\n\nc" and by[None].n_chars == 8
    assert by[4].text == "\n\n".join(["word"] * 3000)
    assert article.op7(pages.limit(0)).collect() == []


def test_op8(docs, none):
    rows = packing.op8(docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.start == 0 for r in rows) == docs.count()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.op8(none).collect() == []


def test_op9(spark, docs, none):
    items = spark.createDataFrame([("i", LINE), ("i2", None), ("i3", "!!"), ("i4", "A b"), ("i4", "A b")], "item_id string, text string")
    by = {r.doc_id: r for r in decontam.op9(docs, items).collect()}
    assert (by[4].n_hit, by[4].n_items, by[4].contaminated) == (60, 1, True)
    assert (by[8].n_hit, by[8].n_items, by[1].n_words, by[1].contaminated) == (2, 1, 0, False)
    assert decontam.op9(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.op9(none, items).collect() == []


def test_op9_items_without_an_id(spark, docs):
    """Their windows count as hits; only their name is left out."""
    items = spark.createDataFrame([(None, LINE), (None, "A b"), (None, None)], "item_id string, text string")
    by = {r.doc_id: r for r in decontam.op9(docs, items).collect()}
    assert (by[4].n_hit, by[4].n_items, by[4].contaminated) == (60, 0, True)
    assert (by[8].n_hit, by[8].n_items) == (2, 0)


def test_op10(spark):
    pages = spark.createDataFrame([(1, "http://a\nb", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (None, "u", "y"), (5, "u", "é" * 100_000), (2, None, "x")], "page_id bigint, url string, html string")
    rows = warc.op10(pages).collect()
    assert sorted(((r.page_id or -1), r.payload_bytes, r.record_type, r.refers_to) for r in rows) == [
        (-1, 1, "response", None), (-1, 1, "revisit", 2), (1, 1, "revisit", 2), (2, 1, "response", None), (2, 1, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 200_000, "response", None)
    ]
    assert warc.op10(pages.limit(0)).collect() == []


def test_stages(spark, docs, none, sf):
    for table in (docs, none):
        held = table
        for name, stage in corpus_pipeline.STAGES:
            held = stage(spark, held, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert held.columns == corpus_pipeline.COLUMNS, name
        assert held.count() >= 0
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} >= {4, 5, 8, 9}
    assert kept.where(F.col("text").isNull()).count() == 0
