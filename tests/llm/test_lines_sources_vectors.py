import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from threadloom.llm import hot, line_dedup, source_audit, vector_codes

SPACE = " \t\n\x0b\f\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def without_lines(rows):
    """(id, text) with the contract's lines gone, by plain loops."""
    docs, keys = collections.defaultdict(set), lambda t: [low(x.strip(SPACE)) for x in (t or "").split("\n")]
    for i, t in rows:
        for k in keys(t):
            if len(k) >= 40:
                docs[k].add(i)
    out = []
    for i, t in rows:
        gone = [len(docs[k]) >= 5 and i != max((x for x in docs[k] if x is not None), default=None) for k in keys(t)]
        lines = (t or "").split("\n")
        out.append((i, len(lines), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(lines, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows():
    r = random.Random(4)
    common = [f"this line number {k} is long enough to count, Ärger inclusive {'x' * 10}" for k in range(6)]
    rows = []
    for i in range(60):
        lines = [f"own words of document {i} that no other document has, line {k}" for k in range(3)] + ["short", "", " \t"]
        for c in r.sample(common, r.randrange(4)):
            lines += [r.choice(["", " ", "\t"]) + r.choice([c, c.upper().replace("Ä", "Ä"), c]) + r.choice(["", "\r", " \x0b"])] * r.randrange(1, 3)
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n"), (73, common[0]), (None, common[0] + "\nx"), (None, common[1]), (3, common[2] + "\nagain"), rows[5], rows[5]]
    rows += [(80 + k, "äöü " * 12 + "\n" + "z" * 39) for k in range(7)] + [(90, "\n".join(f"{k} {common[0]}" for k in range(9000)) + "\n" + common[0])]
    return rows


def told(df):
    return sorted([(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect()], key=repr)


@pytest.mark.parametrize("share", [hot.HOT_SHARE, 4])
def test_lines_equal_plain_loops(spark, monkeypatch, share):
    monkeypatch.setattr(hot, "HOT_SHARE", share)
    rows = line_rows()
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = without_lines(rows)
    assert told(out) == want and sum(w[2] for w in want) > 50


def test_lines_of_odd_tables(spark, odd, none):
    assert line_dedup.drop_lines(none).count() == 0
    out = line_dedup.drop_lines(odd, least_length=1, least_docs=2)
    assert out.select("row.*").columns == odd.columns and out.count() == odd.count()
    clash = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "a", 5, 6, 7)], "doc_id long, text string, _text int, row int, dropped int")
    rows = line_dedup.drop_lines(clash, least_length=1, least_docs=2).collect()
    assert sorted((r["row"]["doc_id"], r["row"]["row"], r["text"], r["n_dropped"]) for r in rows) == [(1, 6, "", 1), (2, 6, "a", 0)]


def audited(rows, least, top):
    """The audit by plain loops over (text, lang, source)."""
    count, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        part = lambda get: {t: 1 + 10**9 * (get(t) + 2) // (sum(get(u) for u in kept) + 2 * len(kept)) for t in kept}
        p = {s: part(lambda t: count[lang, s, t]) for s in sources}  # noqa: B023
        q = part(lambda t: sum(count[lang, s, t] for s in sources))  # noqa: B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s, t] and p[s][t] > q[t]]
            for name, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, name, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_audit_equals_plain_loops(spark, none):
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("Wort", "mot", "ÄÉ", "x") for b in "abcdefghij"] + ["É", "日本", "😀b", ""]
    rows = []
    for _ in range(150):
        lang = r.choice(["en", "de", None])
        rows.append((r.choice([" ", "1", "-"]).join(r.choices(words, k=r.randrange(30))), lang, r.choice(["s1", "s2", "S3", None, "é"])))
    rows += [(None, "en", "silent"), ("", "en", "silent2"), ("once only", "xx", "a"), ("@[`{ 12", "xx", "b"), (None, None, None)] + [rows[0]] * 3
    df = spark.createDataFrame([(*x, 1) for x in rows], "text string, lang string, source string, term int").repartition(3)
    for least, top in ((10, 10), (1, 3)):
        assert sorted(tuple(x) for x in source_audit.audit(df, least, top).collect()) == audited(rows, least, top)
    assert source_audit.audit(none.withColumn("source", none.lang)).count() == 0


def test_counts_beyond_a_double(spark):
    n, total = 10**15 + 7, 3 * 10**15 + 1
    row = spark.createDataFrame([(n, total, 12345)], "n long, t long, k long").select(source_audit.billionths("n", "t", "k").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * 12345)


def coded(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks by plain loops over (id, vector, label)."""
    good = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda g: (g[0], g[1]))
    size = len(good[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, v, _ in good:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = [(i, "".join(f"{near(cut(v, p), books[p])[1]:02x}" for p in range(parts)), sum(near(cut(v, p), books[p])[0] for p in range(parts)), label) for i, v, label in good]
    sums = collections.Counter()
    for _, _, e, label in out:
        sums[label] += e
    return sorted((i, c, e, sums[label]) for i, c, e, label in out), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vector_rows(n, dim):
    r = random.Random(n)
    rows = [(3 * i % n * 2, [r.gauss(0, 0.2) for _ in range(dim)], r.choice([1, 2, None])) for i in range(n) if math.gcd(3, n) == 1]
    rows += [(1, rows[0][1], 2), (3, rows[0][1], 2), (5, rows[1][1], None)]  # equal vectors: ties
    return rows + [(7, None, 1), (9, [None] * dim, 1), (11, [float("nan")] * dim, 1), (13, [1.0] * (dim - 1) + [float("-inf")], 1), (15, [], 1)]


@pytest.mark.parametrize("n, dim, share", [(200, 16, hot.HOT_SHARE), (10, 8, hot.HOT_SHARE), (80, 24, 2)])
def test_codes_equal_plain_loops(spark, monkeypatch, n, dim, share):
    monkeypatch.setattr(hot, "HOT_SHARE", share)
    rows = vector_rows(n, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", df_lit()).repartition(3)
    out, books = vector_codes.compress(df)
    want, digest = coded(rows)
    assert sorted(tuple(r) for r in out.collect()) == want and vector_codes.digest(books) == digest
    back = out.select("vec_id", "error", vector_codes.decode(out["code"], books).alias("v")).join(df.select("vec_id", "embedding"), "vec_id").collect()
    for r in back:
        assert sum((math.floor(4096 * x) - round(4096 * y)) ** 2 for x, y in zip(r["embedding"], r["v"], strict=True)) == r["error"]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)], [(1, [1.0] * 7, 1)]):
        out, books = vector_codes.compress(spark.createDataFrame(rows, kind))
        assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error"] and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    rows = [(None, [0.5] * 8, 1), (2, [0.25] * 8, 1), (2, [0.25] * 8, 1), (3, [1e30] * 8, 1), (4, [0.0] * 16, 1)]
    out, books = vector_codes.compress(spark.createDataFrame(rows, kind))
    assert sorted((r["vec_id"] or 0, r["code"]) for r in out.collect()) == [(0, "02" * 8), (2, "00" * 8), (2, "00" * 8)]


def test_bounds_hold_and_prune():
    r = np.random.default_rng(3)
    entries, x = r.integers(-900, 900, (16, 8)), r.integers(-2000, 2000, (500, 8))
    cells = vector_codes.Cells.of(entries)
    true = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    lower, upper = cells.bounds(x)
    assert (lower <= true).all() and (true <= upper).all()
    code, distance, exact = cells.nearest(x)
    assert (code == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all() and exact < true.size / 2
    for a, b in itertools.pairwise([1, 2, 4, 6]):  # finer cells leave fewer exact distances
        assert vector_codes.Cells.of(entries, b).nearest(x)[2] < vector_codes.Cells.of(entries, a).nearest(x)[2]
