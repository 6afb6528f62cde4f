import hashlib
import random
import re

from threadloom.llm import substring_dedup

from .conftest import ODD, PHRASE

_WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, k=13):
    first = {}
    words = [(i, _WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[p : p + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        cut = [False] * len(w)
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                cut[p : p + k] = [True] * k
        kept = [x for x, c in zip(w, cut, strict=True) if not c]
        out.append((i if i is not None else -1, len(w), sum(cut), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def told(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.summary(df).collect())


def test_odd_rows(odd, none):
    assert told(odd) == brute([(i, t) for i, t, *_ in ODD])
    assert substring_dedup.summary(none).count() == 0


def test_random_passages_with_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 5)
    r = random.Random(3)
    passages = [[r.choice("abcdefghij") for _ in range(r.randrange(10, 30))] for _ in range(8)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(r.randrange(1, 5)):
            words += [r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(r.randrange(0, 12))] + r.choice(passages[: 1 + i % 8])
        rows.append((r.randrange(0, 150), " ".join(words)))
    assert told(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_cut_leaves_the_rest_as_it_was(spark):
    rows = [(1, f"intro\n{PHRASE}\nend", 5), (2, f"Start  here,\n{PHRASE}\n\tlast line.", 5), (3, None, 5)]
    out = {r["doc_id"]: r for r in substring_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, places int")).collect()}
    assert out[1]["text"] == rows[0][1] and out[1]["removed"] == 0
    assert out[2]["text"] == "Start  here,\nlast line." and out[2]["removed"] == 15 and out[2]["places"] == 5
    assert out[3]["text"] is None
