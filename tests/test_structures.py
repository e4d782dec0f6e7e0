"""Clusters, the vector index, communities and reach against plain second versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import clusters as C
from sparkloom.operators import vectorindex as V
from sparkloom.sources.scratch import Rounds

# --- cosine clusters


def test_clusters_are_the_greedy_ones(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(160):
        words = rnd.choices(vocabulary, weights=range(1, 13), k=rnd.choice([0, 1, 2, 5, 9]))
        rows.append((i, rnd.choice(["x", "y", None]), None if rnd.random() < 0.05 else " ".join(words) + rnd.choice(["", " é!", " q"]), 100 - i))
    df = spark.createDataFrame(rows, "id bigint, domain string, text string, day int")
    bags, by = {}, {}
    for i, domain, text, _ in rows:
        bag = {}
        for w in (text or "").split():
            if w.startswith("w"):
                bag[w] = bag.get(w, 0) + 1
        bags[i] = bag
        by.setdefault(domain, []).append(i)

    def cosine(a, b):
        a, b = bags[a], bags[b]
        n = (sum(x * x for x in a.values()) ** 0.5) * (sum(x * x for x in b.values()) ** 0.5)
        return sum(a[w] * b.get(w, 0) for w in a) / n if n else 0.0

    for least in (0.5, 0.8, 1 / 2**0.5):
        want = set()
        for domain, ids in by.items():
            heads = {}
            for i in ids:
                near = next((h for h in heads if cosine(h, i) >= least - 1e-12), None)
                heads.setdefault(i if near is None else near, []).append(i)
            head, held = max(heads.items(), key=lambda x: (len(x[1]), -x[0]))
            if len(held) >= 3:
                want.add((domain, head, len(held), min(100 - i for i in held), max(100 - i for i in held)))
        got = C.cosine_clusters(df, ["domain"], "id", "text", "day", least - 1e-12, 3).collect()
        assert {(r.domain, r["head"], r.occurrences, r.first_seen, r.last_seen) for r in got} == want
    assert C.cosine_clusters(df.limit(0), ["domain"], "id", "text", "day", 0.8, 3).collect() == []


def test_members_of_a_cluster_meet_its_head_alone(spark, monkeypatch):
    """A cluster of 240 alike texts among others gives a row a member, not all its pairs, whether it begins early or late, and the same clusters as all pairs."""
    monkeypatch.setattr(C, "FRONT", 8)
    monkeypatch.setattr(C, "FEW", 5)
    rnd = random.Random(5)
    rows = []
    for i in range(320):
        group, alike = "uv"[i % 2], rnd.random() < 0.75
        rows.append((i, group, " ".join([f"c{j}" for j in range(30)] if alike else [f"d{rnd.randrange(40)}" for _ in range(12)]) + f" own{i}", i))
    df = spark.createDataFrame(rows, "id bigint, g string, text string, day int")
    with Rounds(spark, "led") as rounds:
        held = rounds.table(C.classes(df, ["g"], "id", "text", "day"))
        table, counts = rounds.table, []

        def counted(df):
            out = table(df)
            counts.extend([out.count()] if out.columns == ["a", "b"] else [])
            return out

        monkeypatch.setattr(rounds, "table", counted)
        got = {r["id"]: r["head"] for r in C.led(rounds.table(C._bags(held)), 0.8, rounds).collect()}
        assert counts and sum(counts) < 320
        pairs = sorted(tuple(r) for r in C.cosine_pairs(held, 0.8).select("a", "b").collect())
    near, want = {}, {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    for i in range(320):
        head = next((a for a in near.get(i, []) if a not in want), None)
        if head is not None:
            want[i] = head
    assert got == want and len(pairs) > 10 * 320 and len(got) > 200


def test_frequent_words_bring_no_pairs(spark):
    """All texts share most of their words; only pairs whose rare parts meet are candidates."""
    common = " ".join(f"c{i}" for i in range(6))
    rows = [(i, "g", f"{common} " + " ".join(f"r{i // 2}x{j}" for j in range(6)), 1) for i in range(200)]
    held = C.classes(spark.createDataFrame(rows, "id bigint, g string, text string, day int"), ["g"], "id", "text", "day")
    assert held.count() == 100  # equal bags are one
    rows = [(i, "g", f"{common} " + " ".join(f"r{i // 2}x{j}" for j in range(6)) + f" own{i}", 1) for i in range(200)]
    held = C.classes(spark.createDataFrame(rows, "id bigint, g string, text string, day int"), ["g"], "id", "text", "day")
    assert C.candidates(C.prefixes(held, 0.8), 0.8).count() == 100 == C.cosine_pairs(held, 0.8).count()


def test_pairs_over_several_blocks(spark):
    """More classes than a block holds, in two groups that share frequent words: the pairs are those of all comparisons, and their plan has no exchange."""
    rng = np.random.default_rng(8)
    bags = rng.poisson(np.array([9, 7, 5] + [0.3] * 40), size=(1300, 43))
    bags[:, 0] = np.maximum(bags[:, 0], 1)
    df = spark.createDataFrame([("xy"[i % 2], i, [f"w{j}" for j in range(43) for _ in range(n[j])]) for i, n in enumerate(bags)], "g string, id bigint, words array<string>")
    found = C.cosine_pairs(df.select(F.struct("g").alias("group"), "id", "words"), 0.9037)
    unit = bags / np.linalg.norm(bags, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.9037, 1))
    assert {(r.a, r.b) for r in found.collect()} == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a % 2 == b % 2}
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().toString()


# --- vector index


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + 0.4 * rng.normal(size=24)).tolist()) for i in range(3000)]
    rows += [(i, rows[7][1]) for i in range(3000, 3600)]  # one vector many times
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [1.0] * 5), (9004, [float("nan")] * 24), (9005, [None] * 24)]
    vectors = spark.createDataFrame(rows + odd, "id bigint, v array<double>").cache()
    model = V.fit(vectors, "id", "v")
    path = str(tmp_path_factory.mktemp("index") / "index")
    return vectors, model, V.build(vectors, "id", "v", model, path), np.array([v for _, v in rows]), [i for i, _ in rows]


def brute(m, ids, queries, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for q in queries:
        sim = np.floor(np.round(unit @ unit[ids.index(q)], 9) * 1e6 + 0.5) / 1e6
        best = sorted((-s, i) for s, i in zip(sim, ids) if i != q)[:k]
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(best)}
    return out


def test_index_holds_every_vector(indexed):
    vectors, model, index, m, ids = indexed
    held = index.select(F.explode("ids").alias("id")).collect()
    assert sorted(r.id for r in held) == sorted(ids)
    assert index.where(F.size("ids") > V.BLOCK).count() == 0 and index.select("list").distinct().count() > 20


def test_recall_and_exact_search(indexed):
    vectors, model, index, m, ids = indexed
    queries = vectors.where("id % 50 = 0")
    want = brute(m, ids, [i for i in ids if i % 50 == 0], 5)
    exact = V.exact_search(index, model, vectors, queries, "id", "v", 5)
    assert {(r["query"], r.id, r["rank"]) for r in exact.collect()} == want
    assert V.recall(V.search(index, model, vectors, queries, "id", "v", 5), exact) >= 0.9
    assert V.recall(V.search(index, model, vectors, queries, "id", "v", 5, probes=1, keep=6), exact) < 1.0


def test_recall_on_the_embeddings(spark, sf):
    """All ids are asked; codes and few lists lose little."""
    from sparkloom.plans import catalog

    q = catalog.queries()
    exact, found = q["vector_index_exact"](spark, "/root/testdata/sf0.01"), q["vector_index_neighbours"](spark, "/root/testdata/sf0.01")
    renamed = [df.withColumnRenamed("vec_id", "id") for df in (found, exact)]
    assert V.recall(*renamed) >= 0.9


def test_ties_and_copies_leave_no_more_than_k_rows(spark, tmp_path):
    """What leaves a task is k of a query and block, however many are alike; floats are held as floats."""
    q, at = V._best(np.array([[0.5, 1.0, 1.0, 1.0], [0.1, 0.2, 0.3, 0.3]]), 2, np.array([-1.0, 0.3]))
    assert (q.tolist(), at.tolist()) == ([0, 0, 1, 1], [1, 2, 2, 3])
    rng = np.random.default_rng(5)
    m = rng.normal(size=(40, 8)).astype("f4")[np.arange(2400) % 40 * (np.arange(2400) % 3 > 0)]  # a third of all are one vector
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, v array<float>").cache()
    model = V.fit(vectors, "id", "v")
    index = V.build(vectors, "id", "v", model, str(tmp_path / "index"))
    assert index.where(F.length("vectors") != 4 * 8 * F.size("ids")).isEmpty()
    exact = V.exact_search(index, model, vectors, vectors, "id", "v", 5)
    asked = list(range(0, 2400, 50))
    assert {(r["query"], r.id, r["rank"]) for r in exact.where("query % 50 = 0").collect()} == brute(m.astype(float), list(range(2400)), asked, 5)


def test_lists_are_dealt_to_about_equal_parts():
    """A list with most rows has several parts, one without rows none; every part has lists."""
    rng = np.random.default_rng(4)
    centres, rows = rng.normal(size=(60, 8)), rng.integers(1, 50, 60)
    rows[[7, 9]] = 0, 4 * rows.sum()
    first, shares = V._parts(centres, rows, 20)
    assert shares[7] == 0 and 14 <= shares[9] <= 17 and (np.delete(shares, [7, 9]) == 1).all()
    of = np.zeros(20)
    for a, n, r in zip(first, shares, rows):
        of[a : a + n] += r / max(1, n)
    assert round(of.sum()) == rows.sum() and of.max() <= 2 * rows.sum() / 20 and of.min() > 0
    part, row, of_list = V._met(np.array([[9, 3], [7, 3]]), first, shares)
    assert sorted(zip(part, row, of_list)) == sorted([(p, 0, 9) for p in range(first[9], first[9] + shares[9])] + [(first[3], 0, 3), (first[3], 1, 3)])


def exchanged(df):
    """Bytes that the exchanges of a collected DataFrame wrote, before they were compressed."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("dataSize").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())] + ([node.plan()] if "QueryStage" in node.nodeName() else [])
    return total


def test_a_query_goes_to_parts_not_to_lists(spark, tmp_path):
    """What a search shuffles are few copies of queries and blocks, not one a list that is probed."""
    m = np.random.default_rng(6).normal(size=(1500, 256))
    vectors = spark.createDataFrame(list(enumerate(m.tolist())), "id bigint, v array<double>").cache()
    model = V.fit(vectors, "id", "v")
    found = V.search(V.build(vectors, "id", "v", model, str(tmp_path / "index")), model, vectors, vectors, "id", "v", 5)
    assert len(found.collect()) == 5 * len(m)
    # Parts of each query and tasks of each block, and two copies for what is found and the rest of a row.
    assert 0 < exchanged(found) < (5 + 24 / 5 + 2) * m.nbytes


def test_recall_without_groups(spark, tmp_path):
    """Vectors without groups have their neighbours in many lists; as many are probed."""
    vectors = spark.createDataFrame(list(enumerate(np.random.default_rng(7).normal(size=(4000, 48)).tolist())), "id bigint, v array<double>").cache()
    model = V.fit(vectors, "id", "v")
    index = V.build(vectors, "id", "v", model, str(tmp_path / "index"))
    queries = vectors.where("id % 50 = 0")
    assert V.recall(V.search(index, model, vectors, queries, "id", "v", 5), V.exact_search(index, model, vectors, queries, "id", "v", 5)) >= 0.9


def test_parts_slices_and_pieces_do_not_change_what_is_found(spark, indexed, monkeypatch):
    """Many small parts, tasks and pieces find what one does, copies that tie and strings as ids included."""
    vectors, model, index, m, ids = indexed
    found = {}
    for parts, tasks, slice_, held in ((1, 1, 1 << 18, 1 << 12), (9, 30, 200, 64)):
        for name, value in (("PARTS", parts), ("TASKS", tasks), ("SLICE", slice_), ("HELD", held)):
            monkeypatch.setattr(V, name, value)
        found[parts] = sorted(map(tuple, V.search(index, model, vectors, vectors, "id", "v", 5).collect()))
    assert found[1] == found[9] and len(found[1]) == 5 * len(ids)
    named = vectors.select(F.format_string("v%05d", "id").alias("id"), "v")
    texts = index.withColumn("ids", F.transform("ids", lambda i: F.format_string("v%05d", i)))
    assert [(int(r["query"][1:]), int(r.id[1:]), r.similarity, r["rank"]) for r in V.search(texts, model, named, named, "id", "v", 5).orderBy("query", "rank").collect()] == sorted(found[9], key=lambda r: (r[0], r[3]))


def test_nothing_to_index(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id bigint, v array<double>")
    model = V.fit(none, "id", "v")
    index = V.build(none, "id", "v", model, str(tmp_path / "index"))
    assert V.search(index, model, none, none, "id", "v", 5).collect() == [] == V.exact_search(index, model, none, none, "id", "v", 5).collect()


def test_single_precision_leaves_out_no_neighbour(monkeypatch):
    """Near ties and equal vectors: what reaches the bound is that of whole comparisons, by few pairs and by many."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 48)), rng.normal(size=(300, 48))
    y[100:140] = 3 * x
    y[140:180] = x * (1 + 1e-7 * rng.normal(size=x.shape))
    whole = V._similarity(x @ y.T, (x * x).sum(axis=1)[:, None] * (y * y).sum(axis=1))
    for least in (np.full(40, 0.999999), np.sort(whole, axis=1)[:, -4], np.full(40, -1.1)):
        q, at = V._best(whole, 3, least)
        for many in (1, 1 << 30):
            monkeypatch.setattr(V, "MANY", many)
            got = V._reaching(x, y, 3, least)
            assert (got[0] == q).all() and (got[1] == at).all() and np.allclose(got[2], whole[q, at], atol=1e-9)


# --- communities


def plain_modularity(edges, label):
    from collections import Counter

    total, inside, all_ = Counter(), 0.0, 0.0
    for a, b, w in edges:
        all_ += 2 * w
        total[label[a]] += w
        total[label[b]] += w
        inside += 2 * w * (label[a] == label[b])
    return inside / all_ - sum((t / all_) ** 2 for t in total.values())


def test_louvain_finds_planted_groups(spark):
    from sparkloom.operators import communities as L
    from sparkloom.operators import graphs as G

    rnd = random.Random(2)
    edges = [(a, b, 1.0) for a in range(60) for b in range(a) if rnd.random() < (0.6 if a // 12 == b // 12 else 0.03)]
    edges += [(0, 0, 2.0), (5, 4, 0.25)]
    df = spark.createDataFrame(edges + [(1, None, 1.0), (1, 2, -1.0), (1, 2, None)], "src bigint, dst bigint, weight double")
    found = {r.node: r.community for r in L.louvain(df).collect()}
    assert len(found) == 60 and all(found[a] == 12 * (a // 12) for a in range(60))
    again = {r.node: r.community for r in L.louvain(df.repartition(7)).collect()}
    assert again == found
    labels = L.louvain(df).withColumnRenamed("community", "label")
    assert abs(L.modularity(df, labels) - plain_modularity(edges, found)) < 1e-9
    assert L.modularity(df, labels) >= L.modularity(df, G.communities(df)) - 1e-12
    assert L.louvain(df.limit(0)).collect() == [] and L.modularity(df.limit(0), labels) == 0.0


def test_moves_beat_label_propagation_on_the_trade(spark, sf):
    from sparkloom.operators import communities as L
    from sparkloom.operators import graphs as G
    from sparkloom.plans import catalog
    from sparkloom.plans.knowledge import _chain

    rows = catalog.queries()["louvain_communities"](spark, sf).collect()
    edges = _chain(spark, sf)
    assert len({r.modularity for r in rows}) == 1 and rows[0].modularity > max(0.0, L.modularity(edges, G.communities(edges)))


def test_parts_sweep_in_few_passes_and_tell_the_modularity(spark, monkeypatch):
    """Four parts find the groups too, however rows are dealt out, in few passes over the edges; what is rated is their modularity."""
    from sparkloom.operators import communities as L

    rnd = random.Random(2)
    edges = [(a, b, 1.0) for a in range(60) for b in range(a) if rnd.random() < (0.6 if a // 12 == b // 12 else 0.03)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    passes, step = [], L._step
    monkeypatch.setattr(L, "PART_EDGES", len(edges) // 2)
    monkeypatch.setattr(L, "_step", lambda *a: (passes.append(1), step(*a))[1])
    rows = L.rated(df).collect()
    found = {r.node: r.community for r in rows}
    assert len(found) == 60 and all(found[a] == 12 * (a // 12) for a in range(60)) and len(passes) < 20
    assert {r.modularity for r in rows} == {round(plain_modularity(edges, found), 6)}
    assert {r.node: r.community for r in L.rated(df.repartition(7)).collect()} == found


def test_numbered_nodes_meet_their_edges_without_joins(spark, monkeypatch):
    """Planted groups of customers and suppliers with long ids, in several parts, loops and both directions: found without a shuffle a
    round, as well as by joins, and rated by their modularity."""
    from sparkloom.operators import communities as L

    rnd, far = random.Random(7), 1 << 40
    edges = [(far + 2 * a, 2 * b + 1, float(rnd.randint(1, 9))) for a in range(90) for b in range(30) if rnd.random() < (0.7 if a // 30 == b // 10 else 0.04)]
    edges += [(b, a, w) for a, b, w in edges[::3]] + [(far, far, 3.0), (7, 7, 0.5)]
    df = spark.createDataFrame(edges + [(None, 1, 1.0), (1, 3, None)], "src bigint, dst bigint, weight double")
    joined, calls = L._joined_step, []
    monkeypatch.setattr(L, "_joined_step", lambda *a: (calls.append(1), joined(*a))[1])
    monkeypatch.setattr(L, "PART_EDGES", len(edges) // 3)
    rows = L.rated(df).collect()
    assert not calls
    found = {r.node: r.community for r in rows}
    assert len(found) == 120 and len(set(found.values())) == 3 and all(found[x] == min(y for y, c in found.items() if c == found[x]) for x in found)
    assert {r.modularity for r in rows} == {round(plain_modularity(edges, found), 6)}
    assert {r.node: r.community for r in L.rated(df.repartition(7)).collect()} == found
    monkeypatch.setattr(L, "NODES", 0)
    assert L.rated(df).first().modularity <= rows[0].modularity + 1e-9 and calls


# --- reach


def plain_reach(edges):
    out, nodes = {}, {x for e in edges for x in e}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        found[n] = len(seen)
    return found


def test_reach_is_exact_below_the_bound_and_near_above(spark):
    from sparkloom.operators import reach as R

    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(300)]  # a chain: far more hops than rounds
    edges += [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)] + [(1003, 1000), (2000, 2000)]  # cycles
    edges += [(3000, 3001 + i) for i in range(80)] + [(2999, 3000), (2998, 2999)]  # many at once
    edges += [(rnd.randrange(5000, 5200), rnd.randrange(5000, 5200)) for _ in range(230)]
    want = plain_reach(edges)
    df = spark.createDataFrame(edges + [(None, 1), (1, None), (0, 1)], "src bigint, dst bigint")
    got = {r.node: r for r in R.reach(df, bound=20).collect()}
    assert set(got) == set(want)
    for n, r in got.items():
        assert r.exact == (want[n] <= 20)
        assert r.reach == want[n] if r.exact else abs(r.reach - want[n]) <= 1 + 0.08 * want[n], n
    assert {n for n, r in R.reach(df, bound=20, estimate=False).where("reach is null").select("node", "reach").collect()} == {n for n, k in want.items() if k > 20}
    assert R.reach(df.limit(0)).collect() == []


def test_reach_takes_over_the_sets_of_ends_alone(spark):
    """In the round from eight hops to sixteen each node of a chain meets one set, not those of all eight; cycles and short cuts stay exact."""
    from sparkloom.operators import reach as R

    hops = [(i, list(range(i + 1, min(i + 9, 31))), [i + 8] if i < 23 else []) for i in range(30)]
    sets = spark.createDataFrame(hops, "src bigint, within array<bigint>, ends array<bigint>")
    got = {r.src: r for r in R._doubled(sets, 20, 2).collect()}
    assert all(sorted(r.within) == list(range(i + 1, min(i + 17, 31))) and r.ends == ([i + 16] if i < 15 else []) for i, r in got.items()) and len(got) == 30
    assert all(r.within is None for i, r in {r.src: r for r in R._doubled(sets, 15, 2).collect()}.items() if i < 15)
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (0, 4), (4, 5), (5, 5)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert {r.node: r.reach for r in R.reach(df).collect()} == plain_reach(edges)


# --- incremental analyzers


def test_states_equal_a_rebuild(spark, tmp_path):
    from sparkloom.operators import incremental as I
    from sparkloom.sources.states import StateTable

    rnd = random.Random(8)
    rows = [(i, rnd.choice(["p", "q", None]), 1_700_000_000 + 7000 * i, rnd.choice(["ai", "git", "other"]), rnd.choice([None, rnd.randrange(10_000)]), rnd.choice([None, rnd.randrange(500)]), rnd.choice("xyz"), rnd.choice([None, rnd.random()]), rnd.choice([None, rnd.random()]), rnd.choice([None, "d", "e"]), rnd.choice([None, [], ["a"], ["a", "b", "a"]])) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, project string, at bigint, source string, s4 bigint, v2 bigint, phase string, hds double, specificity double, domain string, dirs array<string>").withColumn("ts", F.timestamp_seconds("at")).cache()
    for analyzer in (I.direction_by_directory, I.phase_baseline, I.running_profile):
        whole = StateTable(spark, str(tmp_path / f"{analyzer.name}-whole"), analyzer.keys, buckets=4)
        analyzer.rebuild(whole, df, 0)
        parts = StateTable(spark, str(tmp_path / f"{analyzer.name}-parts"), analyzer.keys, buckets=4)
        assert analyzer.answer(parts) is None
        for batch, (a, b) in enumerate(((0, 90), (90, 91), (91, 300), (300, 400))):
            assert analyzer.update(parts, df.where(f"id >= {a} and id < {b}"), batch)
        assert not analyzer.update(parts, df.where("id >= 300"), 3)  # the same batch again
        assert sorted(map(tuple, analyzer.answer(parts).collect()), key=repr) == sorted(map(tuple, analyzer.answer(whole).collect()), key=repr)
        assert parts.events == whole.events
    profile = {r.project: r for r in I.running_profile.answer(whole).collect()}
    for project in ("p", "q", None):
        n, hds = 0, 0.0
        for r in rows:
            if r[1] == project and r[3] == "ai":
                n += 1
                hds += 0.0 if r[7] is None else (r[7] - hds) / n
        assert profile[project].n == n and abs(profile[project].hds - hds) < 1e-4


def test_rebuild_when_due_and_versions(spark, tmp_path):
    from sparkloom.operators import incremental as I
    from sparkloom.sources.states import StateTable

    a = I.phase_baseline
    df = spark.createDataFrame([(i, "x" if i % 2 else "y", i) for i in range(200)], "id bigint, phase string, v2 bigint")
    table = StateTable(spark, str(tmp_path / "t"), a.keys, buckets=4)
    a.update(table, df.where("id < 150"), 0)
    held = table.read()  # a reader of the first version
    changed = df.withColumn("v2", F.col("v2") + 1)  # events changed behind the state: the next update finds 150 and takes all anew
    a.update(table, df.where("id >= 150"), 1, lambda: changed)
    got = {r.phase: (r.n, r.s) for r in table.read().collect()}
    assert got == {"x": (100, sum(i + 1 for i in range(1, 200, 2))), "y": (100, sum(i + 1 for i in range(0, 200, 2)))}
    assert sum(r.n for r in held.collect()) == 150
    a.update(table, df.where("id = 3"), 2, lambda: changed)
    assert {r.phase: r.n for r in table.read().collect()} == {"x": 101, "y": 100} and table.batch == 2
