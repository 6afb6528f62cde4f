"""Ordered passes, admission, lineage and paths against plain loops."""

import posixpath
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import changes, replicate


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "7")  # a key's rows come in several frames
    yield
    spark.conf.set(name, old)


def test_batches_equal_a_loop(spark, small_batches):
    r = random.Random(1)
    rows = [(r.choice([1, 2, None]), f"{k:03}", r.choice([0, 1, 5, 9, 40])) for k in range(200)]
    want = {}
    for key in {x[0] for x in rows}:
        batch = n = total = 0
        for _, i, b in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            if n and (n >= 4 or total + b > 25):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + b
            want[i] = batch
    got = replicate.batches(spark.createDataFrame(rows, "k int, id string, bytes long"), ["k"], 4, 25)
    assert {x["id"]: x["batch"] for x in got.collect()} == want


def test_admission_takes_what_still_fits(spark, small_batches):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(2), r.randrange(30), k) for k in range(150)]
    rows = [(u, e, o, o * 3 + 1, k) for u, e, o, k in rows]
    used, want = {"a": 0, "b": 0}, {}
    for u, e, o, b, _ in rows:
        if (u, e, o) not in want:
            want[u, e, o] = used[u] + b <= 200
            used[u] += b * want[u, e, o]
    got = replicate.admitted(spark.createDataFrame(rows, "user string, epoch int, object int, bytes int, cursor int").repartition(4), 200).collect()
    assert {(x["user"], x["epoch"], x["object"]): x["admitted"] for x in got} == want and len(got) == len(want)
    assert {x["user"]: x["used"] for x in sorted(got, key=lambda x: x["cursor"])} == used
    assert any(a and not b for a, b in zip([x["admitted"] for x in got][1:], [x["admitted"] for x in got], strict=False))


def test_lineage_by_doubling(spark):
    shape = "workspace string, kind string, row_id string, author string, revision string, previous_revision string, content_hash string, state string"
    row = lambda i, r, p, h="x", s="active": ("w", "k", i, "u", r, p, h, s)
    revisions = [row("long", str(n), str(n - 1) if n > 1 else None) for n in range(1, 38)] + [row("fork", "1", None), row("fork", "2", "1"), row("fork", "3", "1"), row("lost", "9", "8"), row("went", "1", None), row("went", "2", "1"), row("dead", "1", None, None, "deleted"), row("other", "1", None, "y")]
    df = spark.createDataFrame(revisions, shape)
    far = {(x["row_id"], x["leaf"], x["revision"]): x["distance"] for x in replicate.ancestry(df).collect()}
    assert {k: d for k, d in far.items() if k[0] == "long"} == {("long", "37", str(37 - d)): d for d in range(37)}
    assert {k for k in far if k[0] == "fork"} == {("fork", "2", "2"), ("fork", "2", "1"), ("fork", "3", "3"), ("fork", "3", "1")} and ("lost", "9", "8") not in far
    rows = spark.createDataFrame([("w", "k", i, "u", "x") for i in ("long", "fork", "lost", "other", "new")], "workspace string, kind string, row_id string, author string, content_hash string")
    got = {(x["row_id"], x["head"]): (x["action"], x["lineage"]) for x in replicate.replica_feed(rows, df).collect()}
    assert got["long", "37"] == ("replica", [str(k) for k in range(36, 0, -1)]) and got["went", "2"] == ("tombstone", ["2", "1"])
    assert got["fork", "2"] == ("conflict", ["1"]) and got["lost", "9"] == ("replica", []) and got["dead", "1"] == ("replica", []) and got["other", "1"] == ("attest", []) and got["new", None] == ("attest", [])


def test_lineages_walk_and_double_alike(spark, small_batches, monkeypatch):
    r, rows = random.Random(9), []
    for k in range(12):
        for n in range(r.randrange(1, 40)):
            rows.append(("w", "k", f"r{k}", "u", f"{n}", f"{r.randrange(n)}" if n and r.random() < 0.9 else r.choice([None, "lost"])))
    rows += [("w", "k", "copies", "u", *x) for x in (("1", None), ("2", None), ("3", "1"), ("3", "2"), ("3", "1"), ("ring", "ring"))]
    df = spark.createDataFrame(rows, "workspace string, kind string, row_id string, author string, revision string, previous_revision string").repartition(4)
    far = {}
    for x in sorted(replicate.ancestry(df).filter("distance > 0").collect(), key=lambda x: (x["distance"], x["revision"])):
        far.setdefault((x["row_id"], x["leaf"]), []).append(x["revision"])
    told = lambda longest: {(x["row_id"], x["revision"]): x["_lineage"] for x in replicate.lineages(df, longest).collect()}
    assert told(10) == far and far["copies", "3"] == ["1", "2"]
    monkeypatch.setattr(replicate, "ancestry", None)  # short rows do without pairs
    assert told(4096) == far


def test_paths(spark):
    r = random.Random(5)
    paths = ["/", "//", "", ".", "..", "/..", "../..", "a/../..", "/a/../../b", None] + ["".join(r.choice(["/", "a", "..", ".", "/b", "/.c"]) for _ in range(r.randrange(1, 8))) for _ in range(400)]
    want = {p: None if p is None else "/" + posixpath.normpath(p).lstrip("/") if p.startswith("/") else posixpath.normpath(p) for p in paths}
    df = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "p string")
    assert {x["p"]: x["n"] for x in df.select("p", T.normal_path(F.col("p")).alias("n")).collect()} == want
    for scope in ("/a", "/x/../a//", "/", "b/."):
        root = posixpath.normpath(scope)
        inside = {p for p, n in want.items() if n is not None and (n == root or n.startswith(root.rstrip("/") + "/"))}
        assert {x["p"] for x in df.filter(T.under(F.col("p"), scope)).collect()} == inside, scope


def test_blame_of_long_histories(spark, small_batches):
    r, rows, want = random.Random(7), [], {}
    for path in ("a.py", "b.py", "c.py"):
        edits, now = [], ""
        for k in range(60):
            kind = "write" if k == 0 or r.random() < 0.1 or not now else "edit"
            text = "\n".join(f"line {r.randrange(9)}" for _ in range(12)) if kind == "write" else r.choice(["new", "two\nlines", ""])
            old = r.choice([x for x in now.split("\n") if x] or [None]) if kind == "edit" else None
            edits.append({"type": kind if path != "c.py" or k < 55 else "shell", "content": text, "old": old})
            now = text if kind == "write" else now.replace(old or "", text, 1) if old else ""
        rows += [(path, f"{k:03}", datetime(2024, 1, 1) + timedelta(minutes=k), e["type"], e["content"], e["old"], f"c{k}", "codex", f"prompt {k}\nmore", "m") for k, e in enumerate(edits)]
        lines, by = changes.fold(edits)
        want |= {(path, n + 1): (t, f"c{k}", f"prompt {k}") for n, (t, k) in enumerate(zip(lines or [], by or [], strict=True))}
    df = spark.createDataFrame(rows, "file_path string, id string, ts timestamp_ntz, type string, content string, old string, conv string, source string, prompt string, message_id string").repartition(5)
    got = {(x["file_path"], x["line"]): (x["text"], x["conv"], x["prompt"]) for x in changes.blame(df).collect()}
    assert got == want and {k[0] for k in want} <= {"a.py", "b.py"} and want
