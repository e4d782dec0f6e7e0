"""Feature sessions: the cut and folded batch, and the stream, against one plain fold in order."""

import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import features as O
from sparkloom.streaming.features import STATE_STORE, feature_stream

HOUR = 3_600_000_000
SCHEMA = "project string, id bigint, at bigint, branch string, files array<string>"


def plain(rows):
    """project, id, feature and rule, an event after the other."""
    out, state = [], {}
    for project, id_, at, branch, files in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        held = state.setdefault(project, [])
        live = [f for f in held if at - f["last"] <= 7 * 24 * HOUR]
        own, found = set(files or []), None
        if branch and branch not in ("main", "master", "develop"):
            rule, found = "branch", next((f for f in live if f["branch"] == branch), None)
        else:
            rule = "files"
            for f in live:
                union = own | f["files"]
                if found is None and own and at - f["last"] < 4 * HOUR and len(own & f["files"]) / len(union) > 0.4:
                    found = f
            if found is None:
                rule, near = "recent", [f for f in live if at - f["last"] < 2 * HOUR]
                if near:
                    newest = max(f["last"] for f in near)
                    found = next(f for f in near if f["last"] == newest)
        if found is None:
            found, rule = {"id": id_, "branch": branch, "files": own}, "new"
            held.append(found)
        found["last"] = at
        out.append((project, id_, found["id"], rule))
    return sorted(out, key=repr)


def made(seed, n=700):
    rnd = random.Random(seed)
    at, rows = {}, []
    for i in range(n):
        project = rnd.choice(["p", "q", None, "hot", "hot", "hot"])
        step = rnd.choice([0, 5, 30, 110, 200, 239, 240, 241, 600, 60 * 24 * 3, 60 * 24 * 7 - 30, 60 * 24 * 7 + 30]) * 60_000_000
        at[project] = at.get(project, 0) + step
        branch = rnd.choice([None, "", "main", "develop", "feat/a", "feat/b"])
        files = rnd.choice([None, [], ["a"], ["a", "b"], ["b", "c"], ["a", "b", "c", "d"]])
        rows.append((project, i, at[project], branch, files))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_is_the_fold(spark, seed):
    rows = made(seed) + [("p", 10_000, None, "feat/a", ["a"])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("at"))
    got = O.feature_sessions(df, "project", "id", "ts", "branch", "files").select("project", "id", "feature", "rule").collect()
    assert sorted((tuple(r) for r in got if r.rule), key=repr) == plain(rows)
    assert [tuple(r) for r in got if not r.rule] == [("p", 10_000, None, None)]


def test_a_branch_kept_open_by_other_rules(spark):
    """Rules 2 and 3 see a branch's feature after its last own event, so that it is not stale when the branch comes again."""
    day = 24 * HOUR
    rows = [("p", 0, 0, "feat/x", ["a"])]
    rows += [("p", i, i * HOUR, "main", None) for i in range(1, 30)]  # an hour apart: they go to the feature seen last
    rows += [("p", 30, 29 * HOUR + 7 * day, "feat/x", ["b"]), ("p", 31, 31 * HOUR + 14 * day, "feat/x", None), ("p", 32, 32 * HOUR + 14 * day, None, ["b"])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("at"))
    found = {r.id: (r.feature, r.rule) for r in O.feature_sessions(df, "project", "id", "ts", "branch", "files").collect()}
    assert sorted(("p", i, *x) for i, x in found.items()) == sorted(plain(rows))
    assert found[30] == (0, "branch") and found[31] == (31, "new")


def test_summaries_and_empty_tables(spark):
    rows = [("p", 1, 0, "feat/x", ["a"]), ("p", 2, HOUR, None, ["a", "b"]), ("p", 3, 9 * 24 * HOUR, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("at"))
    assigned = O.feature_sessions(df, "project", "id", "ts", "branch", "files")
    got = {r.feature: r for r in O.feature_summaries(assigned, df.agg(F.max("ts").alias("as_of"))).collect()}
    assert (got[1].branch, got[1].n_events, got[1].n_files, got[1].status) == ("feat/x", 2, 2, "stale")
    assert (got[3].branch, got[3].n_events, got[3].n_files, got[3].status) == (None, 1, 0, "active")
    assert O.feature_sessions(df.limit(0), "project", "id", "ts", "branch", "files").collect() == []


def test_stream_is_the_fold_on_shuffled_arrivals(spark, tmp_path):
    rows = [(p or "none", 1000 + i, *x) for p, i, *x in made(5, 150)]  # ids are strings in the stream
    want = [(p, str(i), str(f), rule) for p, i, f, rule in plain(rows)]
    rnd = random.Random(9)
    rnd.shuffle(rows)
    frame = pd.DataFrame(rows, columns=["project", "id", "at", "branch", "files"])
    span = int(frame["at"].max())
    for i in range(3):  # in three files, in no order
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("last", 10**6, 10 * span + 400 * 24 * HOUR, None, None)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "end"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        got = []
        for folder in ("in", "end"):  # the second run only brings an event by which the watermark passes all others
            for file in sorted((tmp_path / folder).glob("*.parquet")):
                target = tmp_path / "arrivals"
                target.mkdir(exist_ok=True)
                (target / f"{folder}-{file.name}").write_bytes(file.read_bytes())
            events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "arrivals")).withColumn("ts", F.timestamp_micros("at"))
            stream = feature_stream(events, "project", "id", "ts", "branch", "files", f"{span // 1_000_000 + 1} seconds")
            run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("project", "id", "feature", "rule").collect()]
        assert sorted(got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
