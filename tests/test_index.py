"""The living index against the scan, after every change."""

import random

import pytest

from threadloom import schema
from threadloom.archive import Archive
from threadloom.operators import search

WORDS = ["apple", "pear", "plum", "fig", "nut", "the", "of"]


def archive(spark, texts):
    rows = [(i, f"c{int(i[1:]) % 7}", "user", t, None, None, None, "{}", None, None) for i, t in texts.items()]
    convs = [(f"c{k}", "claude", "t", None, None, None, "/r", None, None, "{}") for k in range(7)]
    return Archive(spark, messages=spark.createDataFrame(rows, schema.MESSAGES), conversations=spark.createDataFrame(convs, schema.CONVERSATIONS))


def scan(a, query):
    return {r["id"]: round(r["score"], 6) for r in search.bm25(a.messages, query, "id", "content", "thinking").collect()}


def same(index, a, query, k):
    want = scan(a, query)
    assert {r["id"]: r["score"] for r in index.scores(query).collect()} == want
    last = sorted(want.values(), reverse=True)[:k][-1:] or [0]
    assert {r["id"]: r["score"] for r in index.top(query, k).collect()} == {i: s for i, s in want.items() if s >= last[0]}


def test_index_follows_changes(spark, tmp_path):
    r = random.Random(3)
    make = lambda: " ".join(r.choices(WORDS, weights=[1, 2, 3, 5, 8, 40, 40], k=r.choice([0, 3, 9, 60])))
    texts = {f"m{k}": make() for k in range(160)}
    index = search.Index(archive(spark, texts), str(tmp_path / "index"))
    assert index.stale(1) and index.scores("apple").count() == 0 and index.top("apple", 3).count() == 0
    index.build(1)
    first = index.current()
    same(index, index.archive, "apple the", 5)
    for generation in (2, 3, 4):
        gone, new = r.sample(sorted(texts), 12), [f"m{1000 * generation + k}" for k in range(9)]
        rewritten = r.sample(sorted(set(texts) - set(gone)), 10)
        for i in gone:
            del texts[i]
        texts |= {i: make() for i in new + rewritten}
        index.archive = archive(spark, texts)
        index.update(generation, spark.createDataFrame([(i,) for i in gone + new + rewritten + ["never there"]], "id string"))
        assert not index.stale(generation) and index.stale(generation + 1)
        same(index, index.archive, "apple fig nosuch", 4)
    same(index, index.archive, "the of", 3)
    s = index.current()
    assert s.n == len(texts) and len(s.names) < 4 and s.names != first.names
    # search by index and by scan, filtered or not
    for filters in ({}, {"conversation": "c3"}):
        rows = [[tuple(x) for x in search.search(index.archive, "plum nut", limit=3, context=9, index=i, **filters).collect()] for i in (None, index)]
        assert rows[0] == rows[1] and rows[0]
    # a set from before can still be read, until it is swept
    held = index._read(first.names, "docs", "id string").count()
    assert held == 160
    assert index.vacuum() >= 1 and index.vacuum() == 0
    same(index, index.archive, "apple", 2)


def test_top_list_skips_blocks(spark, tmp_path):
    texts = {f"m{k}": "the " * 50 + "fig" for k in range(300)} | {f"m{900 + k}": "fig fig fig" for k in range(6)}
    index = search.Index(archive(spark, texts), str(tmp_path / "index"))
    index.build(1)
    asked = []
    scored = index._scored
    index._scored = lambda s, weights, wanted: asked.append(scored(s, weights, wanted)) or asked[-1]
    assert sorted(r["id"] for r in index.top("fig", 3).collect()) == [f"m{900 + k}" for k in range(6)]
    assert asked[-1].count() == 6  # of 306 documents with the word


def test_a_lost_writer_leaves_the_set(spark, tmp_path, monkeypatch):
    texts = {f"m{k}": "apple" for k in range(5)}
    index = search.Index(archive(spark, texts), str(tmp_path / "index"))
    index.build(1)
    monkeypatch.setattr(index, "_mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    index.archive = archive(spark, {"m9": "apple pear"})
    with pytest.raises(OSError):
        index.update(2, spark.createDataFrame([(f"m{k}",) for k in (*range(5), 9)], "id string"))
    assert index.current().generation == 1 and index.scores("apple").count() == 5
