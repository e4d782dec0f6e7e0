"""Queries that SQL cannot express, against plain second implementations over the smallest tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparkloom.llm import _words, article, decontam, interleaved, langid, linededup, minhash, packing, pii, tokens, urlfilter, warc
from sparkloom.llm._shared import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_language_held_out_accuracy(docs):
    rows = langid.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95


def test_repeated_line_runs(docs, texts):
    seen, want = set(), {}
    for doc, text in sorted(texts.items()):
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        gone = set()
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(re.findall(r"[^ \t\n\v\f\r]+", lines[b]))
                if words >= linededup.MIN_WORDS:
                    run = tuple(lines[a : b + 1])
                    if run in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(run)
        want[doc] = gone
    for r in linededup.op2(docs).collect():
        got = {i for x in r.removed.split(",") if x for i in range(*map(int, x.split(":")))}
        assert got == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicate_components(docs, texts, k, percent):
    sets = {}
    for doc, text in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", text.translate(LOW))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    least = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    for r in minhash.near_duplicates(docs, k, percent).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), least[r.doc_id], least[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("k,percent,n", [(3, 85, 8), (5, 80, 8)])
def test_smallest_sets_that_link(spark, k, percent, n):
    """6 of 7 shingles (k 3) and 4 of 5 (k 5) are enough; one shingle fewer each is not."""
    word = lambda tag, i: f"{tag}{i}"
    rows = [(0, " ".join(word("a", i) for i in range(n))), (1, " ".join(word("a", i) for i in range(n + 1)))]
    rows += [(2, " ".join(word("b", i) for i in range(n - 1))), (3, " ".join(word("b", i) for i in range(n)))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_edited_copies_stay_together(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):  # copies of one text, each with a few edits: linked to the original more than to each other
        copy = list(base)
        for j in rng.choice(300, size=i % 6, replace=False):
            copy[j] = f"e{i}x{j}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.op4(df).collect()} == {0}


def test_pairs_that_are_never_centres(spark):
    """Texts from one pool of paragraphs share big buckets and do not link; each one's only partner is a copy with three exchanged.
    Stars alone lose links."""
    rng = np.random.default_rng(11)
    pool = [[f"p{i}w{j}" for j in range(12)] for i in range(100)]
    rows = []
    for i in range(60):
        order = rng.permutation(100)
        for d, chosen in enumerate((order[:85], order[3:88])):
            rows.append((2 * i + d, " ".join(w for p in sorted(chosen) for w in pool[p])))
    sets = {i: {tuple(w[j : j + 3]) for w in [t.split()] for j in range(len(w) - 2)} for i, t in rows}
    least = {i: i for i in sets}
    for a, b in ((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])):
        low, high = sorted((least[a], least[b]))
        least = {i: low if c == high else c for i, c in least.items()}
    assert len(set(least.values())) > 40
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == least


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            yield f"{kind}:{m.start()}:{m.end()}"


def test_base_spans(spark, texts):
    cases = ["a@b.c", "a@b.c_d@e.f.", "x@y z@q..r a@b.c..d %+@-.-", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.1.01 99999999999999999999.1.1.1", "4111 1111-1111 1111 4111111111111111  411111111111111 1 5",
             "+1 (743) 555-3824 +44 20.7946 0958. +1 +12345678", "😀 a@b.co é 1.1.1.1", "a@b@c.d", "1 2 3 4" * 5000, "9" * 50_000, "a" * 50_000 + "@b", "a.b.c." * 9000 + "@d.e" * 3, "a@b.c@d.e", "--@--.--"]
    rows = [*enumerate(cases), *((1000 + d, t) for d, t in texts.items())]
    got = {r.doc_id: r for r in pii.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        spans = list(base_spans(text))
        assert got[doc].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (doc, text[:60])
        assert [got[doc][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]


def revealed(texts, support=pii.SUPPORT, certainty=pii.CERTAINTY, bits=pii.BITS, chars=pii.CONTEXT_CHARS):
    """Plain version of the terms that reveal an entity."""
    word = re.compile(r"[^\W_]+")
    distinct = set(texts)
    has, near, held = collections.Counter(), collections.Counter(), collections.Counter()
    for text in distinct:
        has.update({w for w in word.findall(text.lower()) if any(c.isalpha() for c in w)})
        pairs, entities = set(), set()
        for span in base_spans(text):
            kind, start, end = span.split(":")
            start, end = int(start), int(end)
            value = kind + ":" + text[start:end].lower()
            before, after = text[max(0, start - chars) : start], text[end : end + chars]
            before = re.sub(r"^[^\W_]+", "", before) if start > chars else before
            after = re.sub(r"[^\W_]+$", "", after) if len(text) > end + chars else after
            entities.add(value)
            pairs |= {(value, w) for w in word.findall((before + " " + after).lower()) if any(c.isalpha() for c in w)}
        near.update(pairs)
        held.update(entities)
    return {w for (e, w), n in near.items() if n >= support and n / has[w] >= certainty and np.log2(n / has[w] * len(distinct) / held[e]) >= bits}


def test_revealing_terms(spark):
    """Planted: a name before, a project behind one person's address; a word that stands everywhere; one that stands with many."""
    rows = [(i, f"Note {i}: Zorblax wrote from z@b.com about Quuxery today, said clerk") for i in range(5)]
    rows += [(5, "Who is Zorblax? the end zorblax"), (6, "İ Zorblax İ!")]
    rows += [(10 + i, f"Mail c{i}@d.com said clerk number {i} today") for i in range(12)]
    rows += [(30 + i, f"plain words {i} here at now contact the " * 20) for i in range(60)] + [(99, None), (100, ""), (101, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = revealed([t or "" for _, t in rows])
    assert {"zorblax", "quuxery"} <= want and not {"clerk", "today", "plain", "contact"} & want
    spanned = pii.base_spans(df)
    assert {r.term for r in pii.revealing_terms(spanned).collect()} == want
    got = {r.doc_id: r for r in pii.with_spans(df).collect()}
    for doc, text in rows:
        inside = [(t.start, t.end) for t in got[doc].terms]
        base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text or "")]
        plain = [m.span() for m in re.finditer(r"[^\W_]+", text or "") if m[0].lower() in want and not any(a < m.end() and m.start() < b for a, b in base)]
        assert inside == plain, doc
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[5] == "Who is [TERM]? the end [TERM]" and clean[0].endswith("today, said clerk") and "z@b.com" not in clean[0]


def plain_tree(pages, rules):
    """Plain version of the template tree: verdicts of urls that no rule decides."""
    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].translate(LOW), m[2]) if m else ("", "")

    def ruled(host, path):
        fits = [(len(r), v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(fits)[1] if fits else None

    shapes = collections.defaultdict(lambda: [0, 0, 0])
    for url in pages:
        host, path = parts(url)
        key = host, re.sub("[^/]{33,}", "{s}", re.sub("[0-9]+", "{n}", path))
        v = ruled(host, path)
        for i, x in enumerate((1, v == "block", v == "allow")):
            shapes[key][i] += x
    b, a = sum(x[1] for x in shapes.values()), sum(x[2] for x in shapes.values())
    prior = min(0.5, b / (a + b)) if a + b else 0.0
    smooth = lambda b, a, to: (b + 10.0 * to) / (b + a + 10.0)
    template = {k: "" for k in shapes}
    pattern = {k: "" for k in shapes}
    todo = {k: k[1].split("/") for k in shapes}

    def rates(keys):
        sums = collections.defaultdict(lambda: [0, 0])
        for k in keys:
            for i in (0, 1):
                sums[pattern[k]][i] += shapes[k][i + 1]
        return {p: smooth(*x, prior) for p, x in sums.items()}

    level = 1
    while any(len(x) > level for x in todo.values()):
        here = [k for k, x in todo.items() if len(x) > level]
        nodes = collections.defaultdict(lambda: collections.defaultdict(list))
        for k in here:
            nodes[k[0], template[k]][todo[k][level]].append(k)
        step, left = {}, {}
        for children in nodes.values():
            size = {s: sum(shapes[k][0] for k in ks) for s, ks in children.items()}
            alone = sum(map(len, children.values())) == 1
            for s, ks in children.items():
                rare = len(children) > 16 and size[s] < 0.02 * sum(size.values())
                for k in ks:
                    step[k] = "/" + "/".join(todo[k][level:]) if alone else "/*" if rare else "/" + s
                    left[k] = 0 if alone else len(todo[k]) - level - 1
                    pattern[k] += step[k]
        rate = rates(here)
        for node, children in nodes.items():
            branches = collections.defaultdict(list)
            for ks in children.values():
                for k in ks:
                    branches[step[k]].append(k)
            found = {}
            for s, ks in branches.items():
                n, bb, aa = (sum(shapes[k][i] for k in ks) for i in range(3))
                r = smooth(bb, aa, sum(shapes[k][0] * rate[pattern[k]] for k in ks) / n)
                found[s] = n, (min(left[k] for k in ks), max(left[k] for k in ks)), r, r * (1 - r) / (bb + aa + 11)
            for s, (n, beneath, r, v) in found.items():
                top = max((x[0], t) for t, x in found.items() if x[1] == beneath)[1]
                alike = abs(r - found[top][2]) <= 2 * np.sqrt(v + found[top][3])
                for k in branches[s]:
                    template[k] = node[1] + (f"{top}|{beneath}" if alike else s)
        todo = {k: todo[k] for k in here if left[k]}
        level += 1
    rate = rates(shapes)
    of = collections.defaultdict(list)
    for k in shapes:
        of[k[0], template[k]].append(k)
    purity = {}
    for ks in of.values():
        n, b, a = (sum(shapes[k][i] for k in ks) for i in range(3))
        p = round(smooth(b, a, sum(shapes[k][0] * rate[pattern[k]] for k in ks) / n), 9)
        purity |= {k: p for k in ks}
    out = []
    for url in pages:
        host, path = parts(url)
        p = purity[host, re.sub("[^/]{33,}", "{s}", re.sub("[0-9]+", "{n}", path))]
        out.append((ruled(host, path) or ("block" if p >= 0.8 else "allow"), p))
    return out


def planted_urls():
    """Spam templates that rules label on some hosts stand on others as well, deep and with slugs; news templates do not."""
    out = []
    for i in range(40):
        out += [f"http://s{i % 8}.example.net/de/win/a/b/{i}.html", f"http://s{i % 8}.example.net/en/news/{i}/x{i}", f"http://n{i % 4}.example.com/en/news/{i}/y{i}", f"http://m{i % 4}.test/de/win/a/b/{i}.html", f"http://m{i % 4}.test/about/{i}"]
    out += [f"http://slugs.test/u/{chr(97 + i % 26)}{chr(97 + i // 26)}/posts/{i}" for i in range(200)] + [None, "", "x", "http://h/", "http://h"]
    return out


@pytest.mark.parametrize("which", ["table", "planted"])
def test_template_tree(spark, which):
    urls = planted_urls() if which == "planted" else [r.url for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.op3(df).collect()}
    want = plain_tree(urls, urlfilter.RULES)
    for i, (verdict, purity) in enumerate(want):
        assert (got[i].verdict, round(got[i].purity or 0.0, 6)) == (verdict, round(purity, 6)), urls[i]
    unruled = [i for i in got if got[i].rule is None]
    assert any(got[i].verdict == "block" for i in unruled) and any(got[i].verdict == "allow" for i in unruled)
    if which == "planted":
        spam = {i for i in unruled if "/win/" in (urls[i] or "")}
        assert spam == {i for i in unruled if got[i].verdict == "block"}
        assert len({got[i].template for i in got if "slugs.test" in (urls[i] or "")}) == 1


def test_hashes_of_thue_morse_words(spark):
    """Words that collide under every polynomial hash modulo a power of two."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - x for x in bits]
    one, two = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    for n in (64, 512, 1024, 4096):
        data = np.frombuffer((one[:n] + two[:n]).encode(), np.uint8)
        first, second = _words.hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert first != second
    tail = "\n" + " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("a", one + " " + tail[1:30]), ("b", two + " " + tail[1:30])], "doc_id string, text string")
    assert [r.n_removed for r in linededup.dedup_lines(df, 3).collect()] == [0, 0]
    assert {r.component_id for r in minhash.near_duplicates(df.selectExpr("doc_id", "text"), 3, 85).collect()} == {"a", "b"}


def test_string_ids(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [("x", line), (None, line), ("a", "top\n" + line), ("", line)]
    got = {r.doc_id: (r.n_removed, r.text) for r in linededup.op2(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {None: (0, line), "": (1, ""), "a": (1, "top"), "x": (1, "")}


def test_media_round_trip(docs, texts):
    for r in interleaved.op6(docs).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.caption) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), f"Text of document {r.doc_id}")


def test_ordered_elements():
    html = '<p>a <b>b</b><figure><img src="sha256:AA" alt="x"><img src="sha256:bb"><figcaption>cap &amp; t</figcaption></figure>tail<script>z<img src=no></script><p>e'
    found = interleaved.elements(html)
    assert [(e["kind"], e["text"], e["digest"], e["caption"]) for e in found] == [("text", "a b", None, None), ("image", None, "aa", "cap & t"), ("image", None, "bb", "cap & t"), ("text", "tail", None, None), ("text", "e", None, None)]
    assert [e["position"] for e in found] == list(range(5))


def test_main_text(spark, sf):
    import html

    pages = table(spark, sf, "pages")
    got = {r.page_id: r.text for r in article.op7(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


def test_html_that_leaves_tags_out():
    tree = article.trained()

    def text(html):
        found = article.blocks(html)
        keep = tree.predict(article.features(found)) > 0.5 if found else []
        return [b[0] for b, c in zip(found, keep) if c]

    long = "This is a paragraph of running text with enough words to be read as the content of a page, and a few more to be sure."
    assert text(f"<html><head><title>t</title><body><article><p>{long}</article>") == [long]
    assert text(f"<title>t</title><article><p>{long}</article><article class='comment'><p>{long}</article>") == [long]
    assert text(f"<article><p>{long}<ul><li class='share'>x<li>{long}</ul><p>{long}</article>") == [long, long, long]
    assert text(f"<article><div class='form-factor'><p>{long}</div><div class='login-form'><p>{long}</div></article>") == [long]
    assert [e["text"] for e in interleaved.elements("<html><head><title>t</title><body><p>a")] == ["a"]


def test_tokens_equal_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = tokens.Encoder(P.path("byte_bpe_50k.json"))
    cases = ["", "a", " ", "  ", "a  b", "a \n b", "\n\n", "x\n", "  lead", "it's 'so' they'll", "é à  ü z", "日本 語", "ab12 3c !!? ..", "\t\tq", "a\n\n\nb  ", "<|endoftext|> a", "x <|endoftext|><|endoftext|> \n", "<|endoftext|", "|>", "\r\n a\r\nb", "a\u0085b", "\x1c\x1d a", "😀 hi", "٠١ x"]
    data = np.frombuffer("".join(cases).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in cases])))
    ids, offsets = own.encode(data, at)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(c, add_special_tokens=False).ids for c in cases]


def test_packing(docs, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for d, t in texts.items()}
    rows = packing.op8(docs).collect()
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for doc, found in pieces.items():
        assert sorted((r.start, r.start + r.length) for r in found)[-1][1] == len(ids[doc]) == sum(r.length for r in found)
    for found in places.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(1024 - sum(r.length for r in f) for f in places.values()) < 0.02 * sum(map(len, ids.values()))


def test_mixture_follows_targets(spark):
    rows = [(i, "word " * 50, "a" if i % 3 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scheduled = packing.schedule(packing.tokenized(df).cache(), window=4096)
    sequences = collections.defaultdict(set)
    for r in packing.pack(scheduled, 3).select("sequence_id", "queue").distinct().collect():
        sequences[r.sequence_id].add(r.queue)
    assert sum(len(q) == 2 for q in sequences.values()) >= 0.95 * len(sequences)
    mixed = scheduled.groupBy("window", "queue").sum("n_ids").collect()
    by = collections.defaultdict(dict)
    for r in mixed:
        by[r["window"]][r["queue"]] = r["sum(n_ids)"]
    for w in sorted(by)[:-1]:
        assert abs(by[w]["=a"] / (by[w]["=a"] + by[w]["=b"]) - 2 / 3) < 0.05


def test_contamination(spark, sf, docs, texts):
    benchmark = table(spark, sf, "benchmark")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for r in benchmark.collect():
        w = word.findall(r.text.translate(LOW))
        n = min(13, len(w))
        for i in range(len(w) - n + 1):
            windows[tuple(w[i : i + n])].add(str(r.item_id))
    for shard in (decontam.SHARD_WORDS, 100):  # one automaton, and several
        found = decontam.contamination(docs.select("doc_id", "text"), benchmark, shard_words=shard)
        for r in found.collect():
            w = word.findall(texts[r.doc_id].translate(LOW))
            hit, items = set(), set()
            for n in {len(x) for x in windows}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in windows:
                        hit |= set(range(i, i + n))
                        items |= windows[tuple(w[i : i + n])]
            assert (r.n_words, {i for h in r.hits for i in range(h.start, h.end)}, r["items"]) == (len(w), hit, sorted(items))
        clean = decontam.remove_spans(found).select("doc_id", "text")
        assert decontam.op9(clean.limit(1000), benchmark).where("contaminated").count() == 0


def test_archives(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    pages = pages.union(pages.limit(20).selectExpr("page_id + 1000", "url", "html"))
    by = collections.defaultdict(list)
    for r in pages.collect():
        by[r.html].append(r.page_id)
    got = {r.page_id: r for r in warc.op10(pages).collect()}
    assert len(got) == pages.count()
    for html, ids in by.items():
        raw = html.encode()
        for i in ids:
            r = got[i]
            last = max(ids)
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == last else "revisit", None if i == last else last)


def test_salvage():
    records = [warc.record(i, f"http://x/{i}", (f"payload {i} " * 20).encode(), None, False) for i in range(6)]
    members = [warc.member(r) for r in records]
    bad = bytearray(members[2])
    bad[30] ^= 255
    blob = members[0] + members[1] + bytes(bad) + b"junk\x1f\x8b\x08" + members[3] + records[4] + b"zz" + members[5][:-9]
    rows = list(warc.salvage(blob))
    assert [(r["kind"], r.get("page_id")) for r in rows] == [("record", 0), ("record", 1), ("gap", None), ("record", 3), ("record", 4), ("gap", None), ("record", 5), ("gap", None)]
    assert rows[-2]["payload"] == b"payload 5 " * 20  # its member has lost its end only; record and gap have the member's place
    assert rows[0]["start"] == 0 and rows[-1]["end"] == len(blob) and all(a["end"] == b["start"] for a, b in zip(rows[:-1], rows[1:-1]))
    whole = warc.member(records[0] + records[1] + b"junk" + records[2] + b"tail")
    rows = list(warc.salvage(members[3] + whole + members[4]))
    assert [(r["kind"], r.get("page_id")) for r in rows] == [("record", 3), ("record", 0), ("record", 1), ("gap", None), ("record", 2), ("gap", None), ("record", 4)]
    five = warc.member(b"".join(records[:5]))
    rows = list(warc.salvage(five[:-10] + members[5]))  # cut: what was unpacked before is kept
    assert [r.get("page_id") for r in rows] in ([0, 1, 2, 3, None, 5], [0, 1, 2, 3, 4, None, 5]) and rows[0]["end"] == len(five) - 10
    rnd, texts = random.Random(1), []
    for i in range(5):
        texts.append("".join(rnd.choice("abcdefgh ") for _ in range(5000)))
    five = bytearray(warc.member(b"".join(warc.record(i, "u", t.encode(), None, False) for i, t in enumerate(texts))))
    five[len(five) // 2] ^= 255  # in the middle: at least the records before it
    rows = list(warc.salvage(bytes(five) + members[5]))
    kept = [r["page_id"] for r in rows if r["kind"] == "record"]
    assert kept[:2] == [0, 1] and kept[-1] == 5 and any(r["kind"] == "gap" for r in rows)
    assert all(r["payload"] == texts[r["page_id"]].encode() for r in rows if r["kind"] == "record" and r["page_id"] < 5)
    url = "http://x/" + "u" * 3_000_000
    assert [r["page_id"] for r in warc.salvage(warc.member(warc.record(7, url, b"x", None, False)))] == [7]
    assert list(warc.salvage(b"")) == [] and [r["kind"] for r in warc.salvage(b"nothing")] == ["gap"]
