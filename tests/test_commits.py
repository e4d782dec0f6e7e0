"""Commit histories against the log of the tool that made them."""

import datetime
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import commits as C


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """Edits of long files (so that packs hold changes), folders, a merge, a revert; some commits packed, some alone."""
    root = tmp_path_factory.mktemp("repository")
    clock = [1_700_000_000]

    def git(*args):
        clock[0] += 3600
        env = os.environ | {"GIT_AUTHOR_DATE": f"{clock[0]} +0200", "GIT_COMMITTER_DATE": f"{clock[0] + 60} +0000", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
        return subprocess.run(["git", "-c", "user.name=Zoë Q", "-c", "user.email=z@example.org", *args], cwd=root, env=env, check=True, capture_output=True, text=True).stdout

    rnd = random.Random(4)
    git("init", "-q", "-b", "main")
    lines = [f"line {i} {rnd.random()}" for i in range(400)]
    for i in range(25):
        lines[rnd.randrange(400)] = f"changed {i}"
        (root / f"src/deep/{i % 4}").mkdir(parents=True, exist_ok=True)
        (root / f"src/deep/{i % 4}/é file.txt").write_text(f"{i}\n")
        (root / "long.txt").write_text("\n".join(lines))
        git("add", "-A")
        git("commit", "-q", "-m", f"Change {i}\nsecond line\n\nBody of {i}\n\nmore" if i % 3 else f"Revert {i}")
        if i == 10:
            git("checkout", "-q", "-b", "side")
        if i == 14:
            git("checkout", "-q", "main")
        if i == 18:
            git("merge", "-q", "--no-ff", "-X", "ours", "-m", "Merge side", "side")
            git("gc", "-q", "--aggressive")
    git("rm", "-q", "-r", "src/deep/1")
    git("commit", "-q", "-m", "Remove")
    git("checkout", "-q", "-b", "other", "HEAD~5")
    (root / "only.txt").write_text("x")
    git("add", "-A")
    git("commit", "-q", "-m", "On another branch")
    git("checkout", "-q", "main")
    return root, git


def test_rows_are_those_of_the_log(spark, repository):
    root, git = repository
    log = git("log", "--all", "--format=%H%x1f%P%x1f%an%x1f%ae%x1f%at%x1f%ct%x1f%s%x1f%b%x1e")
    want = {}
    for entry in log.strip("\n\x1e").split("\x1e\n"):
        h, parents, name, email, at, ct, subject, body = entry.strip("\n").split("\x1f")
        files = git("-c", "core.quotePath=false", "diff-tree", "--no-commit-id", "--name-only", "-r", h).split("\n")
        want[h] = (parents.split(), name, email, int(at), int(ct), subject, body.strip("\n"), "revert" if subject.startswith("Revert ") else "commit", sorted(f for f in files if f))
    seconds = [F.unix_seconds(c).alias(c) for c in ("authored", "committed")]
    rows = C.commits(spark, str(root), parts=5).select("commit", "parents", "author", "email", *seconds, "subject", "body", "type", "files").collect()
    got = {r.commit: (r.parents, r.author, r.email, r.authored, r.committed, r.subject, r.body, r.type, sorted(r.files)) for r in rows}
    assert len(rows) == len(want) and got == want and any(len(p[0]) == 2 for p in want.values())


def test_ancestors_of_one_head(spark, repository):
    root, git = repository
    head = spark.createDataFrame([(git("rev-parse", "main").strip(),)], "commit string")
    got = {r.commit for r in C.ancestors(C.commits(spark, str(root)), head).collect()}
    assert got == set(git("rev-list", "main").split()) != set(git("rev-list", "--all").split())


def test_since_is_pushed(spark, repository):
    root, git = repository
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    bound = 1_700_000_000 + 3600 * 40
    for on in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        try:
            recent = C.commits(spark, str(root)).where(F.col("committed") > F.timestamp_seconds(F.lit(bound)))
            times = [int(t) for t in git("log", "--all", "--format=%ct").split()]
            assert recent.count() == sum(t > bound for t in times) > 0
        finally:
            spark.conf.set("spark.sql.python.filterPushdown.enabled", old)


def test_copies_of_ranges():
    base = bytes(range(256)) * 300
    change = b"\x80\xd8\x04\x04\x91\x05\x03\x01x"  # sizes of base and result, a copy of three bytes from the fifth on, a new byte
    assert C.changed(base, change) == base[5:8] + b"x"
    assert C.row_of(None, b"\0" * 20, b"tree 00\nauthor a <b> 0 +0000\ncommitter a <b> 5 +0000\n\nx", (datetime.datetime.fromtimestamp(5, datetime.timezone.utc), False)) is None


def test_an_empty_repository(spark, tmp_path):
    (tmp_path / "objects" / "pack").mkdir(parents=True)
    assert C.commits(spark, str(tmp_path)).collect() == []
