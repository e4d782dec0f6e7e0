"""Tool logs, row stores, analyzers and dialogue structure."""

import json
import sqlite3

from pyspark.sql import functions as F

from sparkloom.operators import dialogue, graphs, scores
from sparkloom.plans import analyzers
from sparkloom.sources import connectors as C


def test_linked_log_follows_parents(spark):
    say = lambda u, p, role, text: json.dumps({"uuid": u, "parentUuid": p, "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": role, "content": text}})
    lines = [say("c", "b", "user", "third"), say("a", None, "user", "first"), say("b", "a", "assistant", [{"type": "text", "text": "second"}, {"type": "tool_use", "name": "x"}]), "{bad", say("z", "gone", "user", "orphan"), say("y", "b", "user", [])]
    rows = C.linked_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    tree = sorted((r.turn_index, r.content) for r in rows if r.root == "a")
    assert tree == [(0, "first"), (1, "second"), (2, "third")] and [r.content for r in rows if r.root == "z"] == ["orphan"]


def test_item_log_takes_context_of_earlier_lines(spark):
    lines = [(0, {"type": "session_meta", "payload": {"id": "s", "cwd": "/p", "git": {"branch": "b"}}}), (1, {"type": "response_item", "payload": {"role": "user", "content": [{"type": "text", "text": "hi"}]}}), (2, {"type": "response_item", "payload": {"role": "assistant", "content": []}})]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in lines], "file string, line_no int, value string")
    assert [(r.session, r.branch, r.role, r.content, r.turn_index) for r in C.item_log(df).collect()] == [("s", "b", "user", "hi", 0)]


def test_history_document(spark):
    df = spark.createDataFrame([("p", "# log\n#### first\nanswer one\n\n#### second\n")], "path string, value string")
    assert [(r.turn_index, r.role, r.content) for r in C.history_document(df).orderBy("turn_index").collect()] == [(0, "user", "first"), (1, "assistant", "answer one"), (2, "user", "second")]


def test_sqlite_table(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (id text, n int)")
        db.executemany("insert into t values (?, ?)", [(f"k{i}", i) for i in range(100)])
    rows = C.sqlite_table(spark, path, "t", "rowid bigint, id string, n int").collect()
    assert len(rows) == 100 and sum(r.n for r in rows) == 4950
    assert C.sqlite_table(spark, path, "t", "rowid bigint, n int", after=90).count() == 10


def test_exports(spark, tmp_path):
    ev = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-03")], "source string, t string").withColumn("ts", F.to_timestamp("t"))
    row = C.manifest(ev).first()
    assert (row.n_events, row.n_sources, str(row.last_day)) == (2, 2, "2024-01-03")
    C.export_csv(ev.groupBy("source").count(), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_analyzer_order():
    g = analyzers.graph()
    order = g.order()
    assert order.index("maturity") > max(order.index(x) for x in ("efficiency", "loops", "autonomy"))
    assert g.affected({"loops"}) == ["loops", "maturity"]
    g.add(analyzers.Analyzer("x", lambda e, d: e, depends=("y",)))
    g.add(analyzers.Analyzer("y", lambda e, d: e, depends=("x",)))
    assert g.order()[-2:] == ["x", "y"]


def test_merge_states(spark):
    old, new = spark.createDataFrame([(1, 1.0, ["a"])], "k int, s double, t array<string>"), spark.createDataFrame([(1, 2.0, ["b"]), (2, 5.0, None)], "k int, s double, t array<string>")
    got = {r.k: (round(r.s, 6), r.t) for r in scores.merge_states(old, new, ["k"], {"s": "ewma", "t": "union"}).collect()}
    assert got == {1: (1.3, ["a", "b"]), 2: (5.0, None)}


def test_segments_and_outcomes(spark):
    turns = spark.createDataFrame([(1, 0, "fix the parser bug"), (1, 1, "the parser bug again"), (1, 2, "now write docs"), (1, 3, "docs for users")], "c int, t int, x string")
    assert [(r.first_turn, r.last_turn) for r in dialogue.segments(turns, "c", "t", "x").orderBy("segment").collect()] == [(0, 1), (2, 3)]
    rows = spark.createDataFrame([(2, 1, "ok"), (0, 1, "never mind"), (0, 9, "x"), (0, 2, None)], "f int, i int, x string")
    assert [r.o for r in rows.select(dialogue.outcome(F.col("f"), F.col("i"), F.col("x")).alias("o")).collect()] == ["success", "abandoned", "failed", "partial"]


def test_graphs_on_cycles_and_loops(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 3, 1.0), (2, 4, 5.0), (1, 4, 9.0)], "src long, dst long, weight double")
    one = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.hops) for r in graphs.reachable(e, one).collect()} == {(1, 0), (2, 1), (4, 1)}
    assert {(r.node, r.distance) for r in graphs.shortest_paths(e, one).collect()} == {(1, 0.0), (2, 1.0), (4, 6.0)}
    assert {(r.node, r.component) for r in graphs.connected(e).collect()} == {(1, 1), (2, 1), (4, 1)}
    ranks = {r.node: r.rank for r in graphs.pagerank(e).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and graphs.reachable(e.limit(0), one).count() == 1
