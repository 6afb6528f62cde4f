import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import exact_dedup, near_dedup
from threadloom.llm.wordhash import Words, lowest

from .conftest import ODD

_WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_exact_groups_of_odd_rows(odd):
    rows = exact_dedup.copies(odd).collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t, *_ in ODD:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    assert len(rows) == len(ODD)
    for key, members in groups.items():
        import hashlib

        own = [r for r in rows if r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()]
        assert len(own) == len(members) and {r["group_size"] for r in own} == {len(members)}
        assert {r["keep_id"] for r in own} == {min(members)[2]} and sum(r["kept"] for r in own) == 1


def test_hot_texts_are_split_and_merged(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 4)
    rows = [(i, "same text" + " " * (i == 17)) for i in range(40)] + [(100 + i, f"text {i}") for i in range(10)]
    out = {r["doc_id"]: r for r in exact_dedup.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["keep_id"] == 17 and out[i]["group_size"] == 40 for i in range(40)) and sum(r["kept"] for r in out.values()) == 11


def test_hot_text_of_one_id_keeps_one_row(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 4)
    rows = [(7, "same text" + " " * (k % 3), k) for k in range(30)] + [(None, "no id", k) for k in range(20)] + [(100 + i, f"text {i}", i) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha int").selectExpr("*", "_sha AS _nth", "_sha AS _cp", "_sha AS _row").repartition(6)
    out = exact_dedup.copies(df).collect()
    for i in (7, None):
        own = [r for r in out if r["doc_id"] == i]
        assert sum(r["kept"] for r in own) == 1 and {r["group_size"] for r in own} == {len(own)} and {r["keep_id"] for r in own} == {i}
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    found = left.collect()
    assert len(found) == 12 and all(r["_sha"] == r["_nth"] == r["_cp"] == r["_row"] for r in found) and [r["text"] for r in found if r["doc_id"] == 7] == ["same text  "]


def test_drop_copies_keeps_columns_and_one_row(odd, none):
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 2, 3 + 2, 7, 8, 8, 9, 10, 11, 12]
    assert exact_dedup.copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_near_components_of_odd_rows(odd, none):
    out = near_dedup.near_copies(odd).collect()
    assert len(out) == len(ODD)
    sets = [(i, shingles(t)) for i, t, *_ in ODD]
    name = {n: n for n in range(len(sets))}
    for a, b in itertools.combinations(range(len(sets)), 2):
        (i, x), (j, y) = sets[a], sets[b]
        if None not in (i, j) and x and y and 100 * len(x & y) >= 75 * len(x | y):
            old, new = name[b], name[a]
            name = {k: new if v == old else v for k, v in name.items()}
    want = sorted((i is None, i or 0, len(x), min([s[0] for k, s in enumerate(sets) if name[k] == name[n] and s[0] is not None], default=-1) if i is not None else -1) for n, (i, x) in enumerate(sets))
    assert want == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in out)
    assert near_dedup.near_copies(none).count() == 0
    assert near_dedup.drop_near_copies(odd).columns == odd.columns


def test_components_of_long_chains(spark):
    """Chains of versions in order, in random order and in zigzag, a star, a ring and a pair."""
    r, n = random.Random(5), 1500
    mixed, zigzag = r.sample(range(n), n), [x for k in range(n // 2) for x in (k, n - 1 - k)]
    parts = [("o", list(itertools.pairwise(range(n)))), ("m", list(itertools.pairwise(mixed))), ("z", list(itertools.pairwise(zigzag))), ("s", [(700, k) for k in range(n) if k != 700]), ("r", [(k, (k + 1) % 300) for k in range(300)]), ("p", [(1, 0), (0, 0)])]
    rows = [(f"{p}{a:05}".encode(), f"{p}{b:05}".encode()) for p, pairs in parts for a, b in pairs]
    scratch = near_dedup.Scratch(spark, "test-components")
    out = [tuple(x) for x in near_dedup.components(spark.createDataFrame(rows, "a binary, b binary"), scratch, "names").collect()]
    assert sorted(bytes(x) for x, _ in out) == sorted({x for pair in rows for x in pair})
    assert all(len({bytes(c) for x, c in out if bytes(x)[:1] == p.encode()}) == 1 for p, _ in parts) and len({bytes(c) for _, c in out}) == len(parts)
    assert {bytes(c) for _, c in out} <= {bytes(x) for x, _ in out}
    assert near_dedup.components(spark.createDataFrame([], "a binary, b binary"), scratch, "none").collect() == []


@pytest.mark.parametrize(("seed", "small"), [(1, 32), (2, 3)])
def test_near_links_at_the_threshold(spark, monkeypatch, seed, small):
    """Random edits of a few texts, so that many pairs are near 0.75; brute force over all pairs; in small buckets and in large ones."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    r = random.Random(seed)
    docs = []
    for _ in range(6):
        base = [f"w{r.randrange(10**6)}" for _ in range(100)]
        docs.append(base)
        for _ in range(14):
            x = list(r.choice(docs[-6:]))
            for _ in range(r.randrange(1, 6)):
                x[r.randrange(len(x))] = f"w{r.randrange(10**6)}"
            docs.append(x)
    texts = [" ".join(d) for d in docs]
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    out = near_dedup.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in out} == {i: root(i) for i in range(len(sets))}


def test_bayes_bound_rarely_drops_a_link():
    for n, m in near_dedup.least_matches():
        from math import comb

        miss = sum(comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(m))
        assert miss < 1e-5


def test_words_and_windows():
    texts = ["a  b\tc\nd e", "", None, "x", "a b c d e f"]
    w = Words(pa.array(texts))
    assert [w.text(i) for i in range(5)] == [[b"a", b"b", b"c", b"d", b"e"], [], [], [b"x"], [b"a", b"b", b"c", b"d", b"e", b"f"]]
    grams, whole = w.windows(5), w.whole(5)
    assert np.flatnonzero(whole).tolist() == [0, 6, 7] and grams[0] == grams[6] != grams[7]
    assert lowest(np.array([5, 3, 9, 4, 8, 7]), 3).tolist() == [3, 3, 4, 4]
