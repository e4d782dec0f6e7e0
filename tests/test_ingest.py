"""Incremental ingest equals a rebuild: new, grown, rewritten and deleted files, and an invalid line."""

import json
import os
import time

from sparkloom.sources import ingest


def line(i, day, summary="s", **meta):
    return json.dumps({"id": f"e{i}", "projectId": "p", "timestamp": f"{day}T10:00:{i % 60:02d}Z", "source": "git", "type": "commit", "content": {"summary": summary}, "metadata": meta})


def put(folder, day, name, lines, mode="w"):
    os.makedirs(f"{folder}/event_date={day}", exist_ok=True)
    with open(f"{folder}/event_date={day}/{name}", mode, encoding="utf-8") as f:
        f.writelines(x + "\n" for x in lines)
    time.sleep(0.01)


def state(spark, target):
    return sorted((str(r.event_date), r.id, r.summary) for r in ingest.materialised(spark, target).collect())


def test_incremental_equals_rebuild(spark, tmp_path):
    log, target = str(tmp_path / "log"), str(tmp_path / "table")
    one, two = "2024-01-01", "2024-01-02"
    put(log, one, "a.jsonl", [line(i, one) for i in range(3)])
    put(log, two, "a.jsonl", [line(i, two) for i in range(10, 12)])
    assert ingest.materialise(spark, log, target) == {"new": 2}
    assert ingest.materialise(spark, log, target) == {"same": 2}
    put(log, one, "a.jsonl", [line(3, one), "not json", line(0, one, "again")], "a")
    assert ingest.materialise(spark, log, target) == {"grown": 1, "same": 1}
    assert state(spark, target) == [(one, "e0", "again"), *((one, f"e{i}", "s") for i in (1, 2, 3)), (two, "e10", "s"), (two, "e11", "s")]
    put(log, two, "a.jsonl", [line(12, two, "other")])
    put(log, two, "b.jsonl", [line(13, two)])
    assert ingest.materialise(spark, log, target) == {"same": 1, "rewritten": 1, "new": 1}
    os.remove(f"{log}/event_date={one}/a.jsonl")
    assert ingest.materialise(spark, log, target) == {"gone": 1, "same": 2}
    assert state(spark, target) == [(two, "e12", "other"), (two, "e13", "s")]
    fresh = str(tmp_path / "fresh")
    ingest.materialise(spark, log, fresh)
    ingest.materialise(spark, log, target, rebuild=True)
    assert state(spark, fresh) == state(spark, target)
    assert [(str(r.event_date), r.n_files) for r in ingest.partitions(spark, log).collect()] == [(two, 2)]
    assert ingest.stale(spark, log, spark.sql("select timestamp'2000-01-01' as as_of")).first().stale
