"""The ledger's log: versions, checks, history and what is forgotten."""

import hashlib
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import ledger, memory, projection

DAY = [datetime(2024, 1, d) for d in range(1, 9)]
SOURCES, LINKS, CANONICALS = "id string, provider string, scope string, locator string, content string, hash string, active boolean", "source string, canonical string, applied_hash string", "id string, scope string, hash string, content string"
ACTIONS = "source string, action string, canonical string, hash string, content string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def source(i, text, active=True):
    return (i, "user", "s", f"at/{i}", text, sha(text), active)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_are_replayed(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    assert book.version() == 0 and book.state()["sources"].count() == 0
    first = spark.createDataFrame([source("a", "one"), source("b", "two")], SOURCES)
    assert book.commit({"sources": first}, DAY[0]) == 1
    actions = spark.createDataFrame([("a", "distinct", "mem_a", None, None), ("b", "unresolved", None, None, None)], ACTIONS)
    token = memory.token(*book.state().values())
    assert book.apply(actions, DAY[1], token) == 2
    assert rows(book.state()["links"]) == [("a", "mem_a", sha("one"))] and rows(book.state(1)["links"]) == []
    with pytest.raises(memory.StalePlan):
        book.apply(spark.createDataFrame([("b", "distinct", "mem_b", None, None)], ACTIONS), DAY[2], token)
    revise = spark.createDataFrame([(None, "revise", "mem_a", sha("one"), "one, better")], ACTIONS)
    assert book.apply(revise, DAY[2]) == 3
    with pytest.raises(ledger.Refused, match="stale revision"):
        book.apply(revise, DAY[3])
    with pytest.raises(ledger.Refused, match="b: canonical exists"):  # all or nothing
        book.apply(spark.createDataFrame([("b", "distinct", "mem_a", None, None), (None, "revise", "mem_a", sha("one, better"), "x")], ACTIONS), DAY[3])
    assert book.version() == 3
    assert [(r["revision"], r["content"], r["at"]) for r in ledger.history(book.log()).filter("id = 'mem_a'").orderBy("revision").collect()] == [(1, "one", DAY[1]), (2, "one, better", DAY[2])]
    assert [r["content"] for r in book.state(2)["canonicals"].collect()] == ["one"]
    # nothing changes: a version without rows
    assert book.commit({}, DAY[3]) == 4 and book.log().filter("version = 4").count() == 0
    # forgotten, and told again: history begins anew, and erase leaves no text from before
    s = book.state()
    book.commit({"canonicals": s["canonicals"].filter("id <> 'mem_a'"), "links": s["links"].limit(0)}, DAY[4])
    again = spark.createDataFrame([("mem_a", "s", sha("later"), "later")], CANONICALS)
    book.commit({"canonicals": again}, DAY[5])
    assert [(r["revision"], r["content"]) for r in ledger.history(book.log()).filter("id = 'mem_a'").collect()] == [(1, "later")]
    before = {k: rows(v) for k, v in book.state().items()}
    book.erase()
    assert {k: rows(v) for k, v in book.state().items()} == before and book.log().filter("content like 'one, b%'").count() == 0
    assert not [p for p in (tmp_path / "ledger").iterdir() if p.name in "123456"]
    assert book.commit({}, DAY[6]) == 8


def test_an_unmarked_version_is_not_there(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    book.commit({"sources": spark.createDataFrame([source("a", "one")], SOURCES)}, DAY[0])
    spark.createDataFrame([], ledger.LOG).write.parquet(str(tmp_path / "ledger" / "2"))  # its writer was lost
    assert book.version() == 1 and book.commit({"sources": spark.createDataFrame([source("a", "two")], SOURCES)}, DAY[1]) == 2
    assert [r["content"] for r in book.state()["sources"].collect()] == ["two"]


def test_refused_knows_revisions(spark):
    pending = spark.createDataFrame([("p", "unlinked", "s")], "source string, kind string, scope string")
    canonicals = spark.createDataFrame([("c", "s", "h", "t"), ("d", "s", "h2", "t")], CANONICALS)
    actions = [(None, "revise", "c", "h", "new"), (None, "revise", "d", "old", "new"), (None, "revise", "gone", "h", "new"), (None, "revise", None, "h", "new"), ("p", "revise", "c", "h", "new"), ("p", "distinct", "e", None, None)]
    got = {(r["source"], r["canonical"]): r["reason"] for r in memory.refused(spark.createDataFrame(actions, ACTIONS), pending, canonicals).collect()}
    assert got == {(None, "d"): "stale revision", (None, "gone"): "no such canonical", (None, None): "revise requires a memory and a text", ("p", "c"): "unknown action", ("p", "e"): "named twice"}


def test_projections_are_written_updated_and_removed(spark, tmp_path):
    shape = "id string, scope string, hash string, content string"
    now = lambda k: datetime(2024, 1, k)
    first = spark.createDataFrame([("b", "/r/a b+c", "h2", "two\n\n"), ("a", "/r/a b+c", "h1", "one"), ("c", "/q", None, None), ("d", None, "h", "x"), ("e", "", "h", "x")], shape)
    p = projection.Projections(spark, str(tmp_path / "p"))
    state = lambda df: {r["scope"]: r["status"] for r in df.collect()}
    assert state(p.status(first)) == {"/r/a b+c": "create", "/q": "create"}
    assert state(p.write(first, now(1), spark.createDataFrame([("/q",)], "scope string"))) == {"/r/a b+c": "create", "/q": "pending"}
    p.write(first, now(2))
    assert state(p.status(first)) == {"/r/a b+c": "unchanged", "/q": "unchanged"}
    file = lambda part: next(x for x in (tmp_path / "p" / "files").rglob("part-*") if part in str(x).replace("%2F", "/") + "/")
    wanted = "<!-- memory projection:v1 -->\n# Synchronized memories\n\n<!-- canonical:a revision:h1 -->\n## a\n\nScope: `/r/a b+c`\n\none\n\n<!-- canonical:b revision:h2 -->\n## b\n\nScope: `/r/a b+c`\n\ntwo\n\n\n"
    assert file("=/r/").read_bytes().decode() == wanted
    assert {r["scope"]: r["bytes"] for r in projection.digests(projection.pieces(first)).collect()}["/r/a b+c"] == len(wanted)
    edited = file("=/q/")
    edited.with_name(f".{edited.name}.crc").unlink()
    edited.write_text("edited")
    later = first.withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit("!")))
    assert state(p.write(later, now(3))) == {"/r/a b+c": "update", "/q": "drift"}
    assert file("=/q/").read_text() == "edited" and "one!" in file("=/r/").read_text()
    with pytest.raises(ValueError, match="drifted"):
        p.remove("/q", now(4))
    assert [p.remove("/r/a b+c", now(k)) for k in (4, 5)] == ["removed", "absent"] and state(p.status(later))["/r/a b+c"] == "create"
    assert projection.digests(projection.pieces(first.limit(0))).count() == 0 and p.status(first.limit(0)).count() == 0


def test_labels_and_audits(spark):
    cases = {"name: 'x y'\n# h": "x y", "name:\n# h\nz": "h", "#\n # no\n": "#", "\r\n  a \nb": "a", "": "memory", " \n\t": "memory", "\n" * 12 + "name: late": "name: late", "w" * 200: "w" * 96}
    got = spark.createDataFrame([(c,) for c in cases] + [(None,)], "c string").select("c", text.label(F.col("c"))).collect()
    assert {r[0]: r[1] for r in got} == cases | {None: "memory"}
    evidence = spark.createDataFrame([("k", "h", "1", sha("a")), ("k", "g", "2", sha("b")), ("k", "h", "3", sha(""))], "canonical string, hash string, message string, content_hash string")
    canonicals = spark.createDataFrame([("k", "/p", "h")], "id string, scope string, hash string")
    messages = spark.createDataFrame([("1", "a"), ("2", "B")], "id string, content string")
    told = memory.audit(evidence, canonicals, messages)
    assert [tuple(r) for r in memory.audit_summary(told).collect()] == [("/p", 3, 1, 1, 1, 0)]
    assert sorted(r["line"] for r in memory.audit_lines(told).collect()) == ["- [changed] historical `k` @ `/p`: `2`", "- [missing] current `k` @ `/p`: `3`"]
    assert [tuple(r) for r in memory.audit_summary(memory.audit(evidence, canonicals, None)).collect()] == [("/p", 3, 0, 0, 0, 3)]
