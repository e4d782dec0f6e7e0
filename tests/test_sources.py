"""Event logs, projects and streams."""

import json
import time

from pyspark.sql import functions as F

from sparkloom.operators import facts, temporal
from sparkloom.sources import events as E
from sparkloom.streaming import pipelines as P

LINES = [
    json.dumps({"id": "1", "projectId": "", "timestamp": "2024-01-01T10:00:00Z", "source": "git", "type": "commit", "content": {"summary": "s", "project": "p"}, "metadata": {"model": "m", "turn_count": 3, "zzz": "x", "files_modified": ["a"]}}),
    json.dumps({"id": "2", "projectId": "q", "timestamp": "2024-01-02T10:00:00Z", "source": "git", "type": "commit", "content": {"summary": "t"}}),
    "",
    "{broken",
]


def lines(spark):
    return spark.createDataFrame([(x,) for x in LINES], "value string")


def test_parse_and_promote(spark):
    parsed = E.parse_lines(lines(spark))
    assert sorted(r.ok for r in parsed.collect()) == [False, True, True]
    flat = {r.id: r for r in E.promote(parsed.where("ok")).collect()}
    assert (flat["1"].project_id, flat["1"].model_id, flat["1"].turn_count, flat["1"].files_modified) == ("p", "m", 3, ["a"])
    assert json.loads(flat["1"].overflow) == {"zzz": "x"}
    assert (flat["2"].project_id, flat["2"].files_modified, flat["2"].overflow) == ("q", [], "{}")


def test_days_round_trip_and_pruning(spark, tmp_path):
    parsed = E.parse_lines(lines(spark)).where("ok").drop("raw", "ok")
    E.write_days(parsed.withColumn("metadata", F.lit("{}")), str(tmp_path))
    day = E.read_days(spark, str(tmp_path), "2024-01-02", "2024-01-02")
    assert [r.id for r in day.where("ok").collect()] == ["2"]
    counts = E.count_by_day(spark.createDataFrame([("2024-01-01", x) for x in LINES], "event_date string, value string")).first()
    assert (counts.n_lines, counts.n_events) == (3, 2)


def test_projects_by_longest_prefix(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/a/x",), ("/z",), ("/a/bc",)], "path string")
    roots = spark.createDataFrame([("/a", "A"), ("/a/b/", "B")], "root string, project_id string")
    assert {r.path: r.project_id for r in E.match_projects(paths, roots).collect()} == {"/a/b/c": "B", "/a/x": "A", "/z": "unregistered:/z", "/a/bc": "A"}


def test_conversations(spark):
    turns = spark.createDataFrame(
        [("c", 0, "user", "hi", "2024-01-01"), ("c", 1, "user", "please fix", "2024-01-02"), ("c", 2, "assistant", "ok", "2024-01-03")], "conversation_id string, turn_index int, role string, content string, ts string"
    )
    row = E.conversations_to_events(turns).first()
    assert (row.summary, row.turn_count, [t.turn_index for t in row.turns]) == ("please fix", 3, [0, 1, 2])
    calls = spark.createDataFrame([("c", [("Edit", '{"file_path":"f"}'), ("Read", '{"path":"g"}')])], "conversation_id string, tool_use array<struct<name:string,input:string>>")
    assert {(r.file, r.modified) for r in E.tool_files(calls).collect()} == {("f", True), ("g", False)}


def test_greedy_clusters(spark):
    rows = [("p", i, f"2024-01-01 {h:02d}:00:00", f, b) for i, (h, f, b) in enumerate([(0, ["a", "b"], "x"), (1, ["a", "b"], "y"), (2, ["z"], "y"), (9, ["a"], "x")])]
    ev = spark.createDataFrame(rows, "project string, id int, t string, files array<string>, branch string").withColumn("ts", F.to_timestamp("t"))
    assert {r.id: r.cluster for r in temporal.greedy_clusters(ev, ["project"], 120).collect()} == {0: 0, 1: 0, 2: 1, 3: 2}


def test_entity_resolution_and_rules(spark):
    names = spark.createDataFrame([("React",), ("Postgres db",), ("Rust",)], "name string")
    known = spark.createDataFrame([(1, "react v18"), (2, "postgres")], "entity int, alias string")
    assert {r.name: (r.entity, r.how) for r in facts.resolve(names, known).collect()} == {"React": (1, "exact"), "Postgres db": (2, "alias"), "Rust": (None, "new")}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    start = spark.createDataFrame([(1, "seen")], "node int, fact string")
    spread = lambda e, f: e.join(f, e.src == f.node).select(e.dst.alias("node"), "fact")
    assert {(r.node, r.depth) for r in facts.propagate(edges, start, [spread]).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_stream_equals_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = str(tmp_path / "table")
    for _ in range(2):  # the second run finds nothing new
        q = stream.writeStream.foreachBatch(P.merge_into(out, ["user_id"], ["ts", "event_id"])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    newest = {r.user_id: r.event_id for r in P.current(spark, out).collect()}
    want = {r.user_id: r.id for r in table.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("id")).collect()}
    assert newest == want


def test_windowed_and_session_streams(spark, sf, tmp_path):
    src = tmp_path / "in"
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(table.schema).parquet(str(src))
    q = P.windowed_counts(stream, "ts", ["event_type"], "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) as s from w").first()["s"] == table.count()


def test_session_state(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("s", F.col("user_id").cast("string"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = P.session_state(stream, "s", "ts", "value").writeStream.outputMode("update").format("memory").queryName("st").start()
    want, end = table.count(), time.time() + 60
    while time.time() < end and spark.sql("select sum(n) as s from st").first()["s"] != want:  # its timeouts keep batches coming
        time.sleep(0.5)
    q.stop()
    assert spark.sql("select sum(n) as s from st").first()["s"] == want
