"""Streams that resume: nothing twice, nothing lost, rewritten files anew."""

import random
import sqlite3

import pytest

from sparkloom.sources import tailing as S


@pytest.fixture
def run(spark, tmp_path):
    def go(stream, name="out"):
        stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()
        return sorted(map(tuple, rows))

    return go


def test_lines_are_read_once(spark, tmp_path, run):
    log = tmp_path / "log"
    (log / "2024-01-01").mkdir(parents=True)
    a, b = log / "2024-01-01" / "a.jsonl", log / "b.jsonl"
    tail = lambda: S.event_tail(spark, str(log))
    assert run(tail()) == []
    a.write_text("a1\na2\npart")
    (log / "_hidden.jsonl").write_text("no\n")
    (log / "c.txt").write_text("no\n")
    assert [v for _, v in run(tail())] == ["a1", "a2"]
    assert [v for _, v in run(tail())] == ["a1", "a2"]  # nothing new
    a.write_text("a1\na2\npart of it\n\n" + "é" * 10 + "\n")  # grown, and the line has its end
    b.write_text("b1\n")
    assert [v for _, v in run(tail())] == ["", "a1", "a2", "part of it", "é" * 10, "b1"]
    b.write_text("other\nb2\n")  # another beginning: all lines are new
    assert sorted(v for f, v in run(tail()) if f == "b.jsonl") == ["b1", "b2", "other"]
    b.write_text("x\n")  # shrunk
    a.unlink()
    assert sorted(v for f, v in run(tail()) if f == "b.jsonl") == ["b1", "b2", "other", "x"]


def test_parts_cut_anywhere(spark, tmp_path, run):
    rnd = random.Random(1)
    lines = ["".join(rnd.choice("abé \r") for _ in range(rnd.choice([0, 1, 5, 40]))) + "." for _ in range(60)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.jsonl").write_bytes("".join(line + "\n" for line in lines).encode())
    assert [v for _, v in run(S.event_tail(spark, str(tmp_path / "log"), part_bytes=29))] == sorted(lines)


def test_rows_are_read_once(spark, tmp_path, run):
    path = str(tmp_path / "store.db")
    tail = lambda: S.table_tail(spark, path, "t", "rowid bigint, v string", part_rows=3)

    def put(sql, *rows):
        with sqlite3.connect(path) as db:
            db.executemany(sql, rows) if rows else db.execute(sql)
        db.close()

    put("create table t (v text)")
    assert run(tail()) == []
    put("insert into t values (?)", *[(f"r{i}",) for i in range(7)])
    assert [v for _, v in run(tail())] == [f"r{i}" for i in range(7)]
    put("delete from t where v = 'r3'")
    put("insert into t values (?)", ("r7",))
    assert [v for _, v in run(tail())] == [f"r{i}" for i in range(8)]
    put("drop table t")
    put("create table t (v text)")
    put("insert into t values (?)", ("n0",), ("n1",))
    assert sorted(v for _, v in run(tail())) == sorted(["n0", "n1", *[f"r{i}" for i in range(8)]])
