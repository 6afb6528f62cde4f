"""Each query on a small corpus, and the pipeline against its stages' brute force."""

import corpus_pipeline
from threadloom.llm import queries

from .conftest import ODD


def test_one_query_an_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(i, t, lang, "src", len(t or "")) for i, t, lang, _ in ODD if i is not None] + [(100 + k, "the house is there and nothing else was said about it " * 3, "en", "src", 1) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert not ids & {3, 4, 5, 11} and 100 in ids and not ids & {101, 102}
    # 1, 6, 7 and 12 are copies, and 2 is near them
    assert 10 in ids and ids & {1, 2, 6, 7, 12} == {2}


def test_stages_and_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "passages", "packing"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Copies, near copies and shared passages; each stage told over by plain loops."""
    import random
    import re
    import zlib

    from threadloom.llm import bpe

    from .test_exact_and_near import shingles

    r, word = random.Random(9), re.compile("[^\x20\x09-\x0d]+")
    make = lambda n: [r.choice(["the", "and", "of", "is", "house"]) if r.random() < 0.2 else "w" + "".join(r.choice("abcdeou") for _ in range(5)) for _ in range(n)]
    shared, docs = [make(20) for _ in range(3)], []
    for k in range(60):
        if docs and k % 5 == 0:
            text = r.choice(docs)[1].replace(" ", "  ", r.randrange(3))
        elif docs and k % 5 == 1:
            text = r.choice(docs)[1] + " " + " ".join(make(2))
        else:
            text = " ".join(make(30) + (r.choice(shared) if k % 2 else []) + make(10))
        docs.append((k, text))
    r.shuffle(docs)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs] + [(900, "12 34", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"\s", "", t), []).append((-len(t), i, t))
    left = sorted((min(g)[1], min(g)[2]) for g in groups.values())
    sets, name = [shingles(t) for _, t in left], list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = [new if n == old else n for n in name]
    left = [d for k, d in enumerate(left) if name[k] == k]
    seen, want = set(), set()
    for i, t in left:
        spans = [m.span() for m in word.finditer(t)]
        words = [t[a:b] for a, b in spans]
        cut = [False] * len(words)
        for p in range(len(words) - 12):
            if tuple(words[p : p + 13]) in seen:
                cut[p : p + 13] = [True] * 13
        seen |= {tuple(words[p : p + 13]) for p in range(len(words) - 12)}
        kept = [w for w, c in zip(words, cut, strict=True) if not c]
        if kept:
            ids = bpe.WordBpe(bpe.tokenizer_path()).encode([" ".join(kept)])[0] + b"\x01\x00\x00\x00"
            want.add((i, len(ids) // 4, zlib.crc32(ids)))
    got = {(x["doc_id"], x["length"], x["ids_crc32"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 5 < len(want) < 60


def write_documents(spark, path, rows):
    spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")


def test_op6_and_op10_equal_the_plain_formats(spark, tmp_path):
    import hashlib
    import zlib

    import tokenizers

    from threadloom.llm import bpe, matroska

    texts = [None, "", "short", "Ünï 日本 😀 words " * 50, "x" * 64, "y" * 65, "short"]
    write_documents(spark, tmp_path, [(i, t, "en") for i, t in enumerate(texts)])
    media = {r["doc_id"]: r for r in queries.QUERIES["op6_matroska"](spark, str(tmp_path)).collect()}
    ids = {r["doc_id"]: r for r in queries.QUERIES["op10_speculative_bpe"](spark, str(tmp_path)).collect()}
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        m, stored = media[i], matroska.write(payload)
        assert (m["n_bytes"], m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (m["media_bytes"], m["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        want = library.encode(t or "", add_special_tokens=False).ids
        raw_ids = b"".join(x.to_bytes(4, "little") for x in want)
        assert (ids[i]["n_tokens"], ids[i]["ids_sha256"]) == (len(want), hashlib.sha256(raw_ids).hexdigest())
        assert ids[i]["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert media[2]["feature"] == media[6]["feature"]


def test_op8_judges_every_url(spark, tmp_path):
    urls = ["http://example.com/en/7x", "https://A.Example.COM/en/1?q", "http://example.net/de/8/z", "http://net/de/", "http://www.org/es/1", "http://other.org/fr/2", None, "no scheme", "http://example.comx/en/7"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.QUERIES["op8_letter_ratio"](spark, str(tmp_path)).collect()}
    assert [(got[k]["rule"], got[k]["verdict"]) for k in range(5)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert all(got[k]["rule"] is None and got[k]["verdict"] in ("allow", "block") for k in range(5, 9)) and (got[1]["host"], got[1]["path"]) == ("a.example.com", "/en/1") and got[6]["host"] == got[7]["path"] == ""


def test_op9_on_held_out_documents(spark, tmp_path):
    """Held-out accuracy on four small made-up languages, some texts with words of two."""
    import random

    r = random.Random(12)
    base = {"en": "the and of with this house there thing which would", "de": "der und nicht schön auch haus werden für eine oder", "fr": "le et une être maison avec vous où dans pour", "es": "el y una ser casa con usted donde porque para"}
    words = {lang: t.split() + [w + s for w in t.split() for s in ("a", "er")] for lang, t in base.items()}
    rows = [(i, " ".join(r.choice(words[lang if r.random() < 0.9 else r.choice(list(base))]) for _ in range(r.randrange(8, 60))), lang) for i, lang in enumerate(list(base) * 60)]
    write_documents(spark, tmp_path, [*rows, (900, None, None), (901, "12 !", "en")])
    got = {x["doc_id"]: x for x in queries.QUERIES["op9_crf"](spark, str(tmp_path)).collect()}
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got) and len(got) == 242
    held = [(i, lang) for i, _, lang in rows if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held) and len(held) > 30
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and all(0 <= x["score"] <= 1 for x in got.values())
