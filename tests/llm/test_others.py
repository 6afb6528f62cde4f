import math
import os
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import chat, language_id, matroska, sharding, url_filter

from .conftest import ODD


def jump_brute(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump(keys, n).tolist() == [jump_brute(int(k) % 2**64, n) for k in keys]
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(b[a != b]) == {8} and 0.08 < (a != b).mean() < 0.15


def test_shards_of_odd_rows(odd, none):
    rows = sharding.assign(odd, 8).collect()
    assert len(rows) == len(ODD) and len({r["shard"] for r in rows if r["doc_id"] == 6}) == 1
    assert sharding.assign(none, 8).count() == 0


def test_slots_are_gapless(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op5_jump_hash(spark, str(tmp_path)).collect()
    for s in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows) and {r["size"] for r in rows} == {1, 5}


def test_matroska_round_trip():
    for n in (0, 1, 64, 511, 512, 513, 4096, 4097, 131_073, 300_000):
        data = os.urandom(n)
        media = matroska.write(data)
        back, found = matroska.samples(media)
        assert back == data and found["error"] is None
        assert all(media[p : p + 4] == matroska.CLUSTER.to_bytes(4, "big") for _, _, p in found["cues"])


def test_matroska_lacing_and_unknown_sizes():
    parts = [b"a" * 300, b"b" * 5, b"c" * 700, b"d"]
    for nth in (0, 1):
        block = matroska._block(parts, 7, nth)
        cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska._number(matroska.TIMESTAMP, 100) + block
        data = matroska._element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
        found = matroska.parse(data)
        assert found["error"] is None and [data[a:b] for _, _, a, b, _, _ in found["packets"]] == parts * 2
        assert {p[4] for p in found["packets"]} == {0, 1} and {p[1] for p in found["packets"]} == {107}


def test_times_of_laced_frames_count_channels():
    frames = [b"a" * 800] * 3
    for channels, step in ((1, 100), (2, 50)):
        sound = matroska._element(matroska.RATE, struct.pack(">d", 8000)) + matroska._number(matroska.CHANNELS, channels) + matroska._number(matroska.DEPTH, 8)
        track = matroska._element(matroska.TRACKS, matroska._element(matroska.TRACK, matroska._number(matroska.NUMBER, 1) + matroska._element(matroska.AUDIO, sound)))
        cluster = matroska._element(matroska.CLUSTER, matroska._number(matroska.TIMESTAMP, 1000) + matroska._block(frames, 0, 0))
        found = matroska.parse(matroska._element(matroska.EBML, b"") + matroska._element(matroska.SEGMENT, track + cluster))
        assert found["error"] is None and [p[1] for p in found["packets"]] == [1000, 1000 + step, 1000 + 2 * step]


def test_broken_matroska_never_raises():
    r, good = random.Random(1), matroska.write(b"ab" * 900)
    for _ in range(500):
        bad = bytearray(good)
        bad[r.randrange(300)] = r.randrange(256)
        matroska.parse(bytes(bad[: r.randrange(len(bad))]))


def test_packet_table(spark, odd, none):
    rows = matroska.stored(odd).collect()
    assert len(rows) == len(ODD) and all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= max(64, r["n_bytes"]) for r in rows)
    media = spark.createDataFrame([(1, bytearray(matroska.write(b"x" * 1100))), (2, bytearray(b"no media at all")), (3, None)], "doc_id long, media binary")
    out = matroska.packets(media, "doc_id", "media").collect()
    assert [(r["length"], r["cluster"]) for r in out if r["doc_id"] == 1] == [(512, 0), (512, 0), (76, 0)]
    assert all(r["error"] for r in out if r["doc_id"] == 2) and not [r for r in out if r["doc_id"] == 3]
    assert matroska.stored(none).count() == 0


def test_language_words_and_edges(spark, odd, none):
    base = {"en": ["the", "and", "of", "with", "this", "house", "there", "thing"], "de": ["der", "und", "nicht", "schön", "auch", "Haus", "werden", "für"], "fr": ["le", "et", "une", "être", "maison", "avec", "vous", "où"]}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(base[lang]) for _ in range(40)), lang) for i, lang in enumerate(list(base) * 30)]
    crf = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    reader = language_id.Reader(crf)
    words = reader.words("the house and this thing der Haus und nicht auch le maison et une")
    want = ["en"] * 5 + ["de"] * 5 + ["fr"] * 4
    assert sum(a[1] == b for a, b in zip(words, want, strict=True)) >= 12
    out = {r["doc_id"]: r for r in language_id.predict(odd, crf).collect()}
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == out[11]["lang_pred"] == "und" and out[3]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.predict(none, crf).count() == 0 and language_id.predict(odd, language_id.train(none)).filter("lang_pred <> 'und'").count() == 0
    assert language_id.keep_known(odd, crf, 0.0).columns == odd.columns


def test_forward_backward_is_exact():
    crf = language_id.Crf(["a", "b", "c"], language_id.Features([]))
    r = np.random.default_rng(3)
    crf.pairs = r.normal(size=(3, 3))
    sizes = np.array([4, 1, 3])
    e = r.normal(size=(8, 3)).astype(np.float32)
    post, joint = crf.posteriors(e, sizes, True)
    import itertools

    want, pairs, at = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for n in sizes:
        own, two = np.zeros((n, 3)), np.zeros((3, 3))
        total = 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            p = math.exp(sum(float(e[at + k, y]) for k, y in enumerate(path)) + sum(crf.pairs[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for k, y in enumerate(path):
                own[k, y] += p
            for a, b in itertools.pairwise(path):
                two[a, b] += p
        want[at : at + n], pairs, at = own / total, pairs + two / total, at + n
    assert np.allclose(post, want, atol=1e-5) and np.allclose(joint, pairs, atol=1e-5)


def context_brute(rows, order):
    text = lambda u: url_filter.BEFORE * order + u
    grams = lambda u: [text(u)[i : i + order + 1] for i in range(len(u))]
    alphabet = len({c for u, *_ in rows for c in u or ""})

    def ratio(labelled, u):
        def p(good, x):
            out = 1 / alphabet
            for k in range(order + 1):
                seen = {}
                for v, g, _ in labelled:
                    for y in grams(v) if g == good else ():
                        if y[order - k : order] == x[order - k : order]:
                            seen[y[-1]] = seen.get(y[-1], 0) + 1
                if seen:
                    out = (seen.get(x[-1], 0) + len(seen) * out) / (sum(seen.values()) + len(seen))
            return out

        return sum(math.log(p(True, x) / p(False, x)) for x in grams(u)) / len(u)

    known = [r for r in rows if r[0] and r[1] is not None]
    held = [(ratio([r for r in known if r[2] % url_filter.FOLDS], u), g) for u, g, fold in known if fold % url_filter.FOLDS == 0]
    rate = lambda t: sum(s < t for s, g in held if not g) / sum(not g for _, g in held) + sum(s >= t for s, g in held if g) / sum(g for _, g in held)
    cut = max((math.floor(s * url_filter.STEPS) / url_filter.STEPS for s, _ in held), key=lambda t: (round(rate(t), 9), -t))
    return [ratio(known, u) if u else None for u, *_ in rows], cut


def test_url_contexts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PIECE", 5)
    monkeypatch.setattr(url_filter, "HOT", 40)
    rows = [("http://good.net/de/19?a=1", True, 1), ("http://fine.net/de/29", True, 2), ("http://bad.com/en/3&b", False, 3), ("http://Ünï.com/en/日本😀", False, 4), ("http://x.com/en/5", False, 5), ("http://y.net/de/5", True, 10)]
    rows = rows * 3 + [(u, None, None) for u in ("http://a.com/en/1", "http://b.net/de/日本😀x", "", None, "http://b.net/de/本日x", "http://a.com/en/1", "http://a.com/en/2")]
    want, cut = context_brute(rows, 2)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, _good boolean, _fold long")
    out = {r["page_id"]: r for r in url_filter.judge_by_contexts(df).collect()}
    for i, w in enumerate(want):
        assert (out[i]["score"] is None and w is None) or abs(out[i]["score"] - w) < 1e-8
        assert out[i]["verdict"] == ("block" if w is not None and w < cut else "allow")
    # digits and letters of other scripts are told apart
    assert out[18]["score"] != out[24]["score"] and out[19]["score"] != out[22]["score"]
    assert all(r["verdict"] == "allow" and r["score"] is None for r in url_filter.judge_by_contexts(df.withColumn("_good", F.lit(None).cast("boolean"))).collect())
    assert url_filter.judge_by_contexts(df.limit(0)).collect() == []


def test_url_contexts_grow_with_the_labelled_urls(spark, monkeypatch):
    assert [url_filter.order_for(n) for n in (0, 4095, 4096, 65535, 65536, 16**9)] == [2, 2, 3, 3, 4, 9]
    # what tells these apart stands four characters back
    monkeypatch.setattr(url_filter, "GROWTH", 4)
    rows = [(f"http://h.com/{k}/{a}-->{c}", (a == "a") == (c == "x"), k) for k in range(20) for a in "ab" for c in "xy"]
    out = url_filter.judge_by_contexts(spark.createDataFrame([(f"http://h.com/z/{a}-->{c}", None, None) for a in "ab" for c in "xy"] + rows, "url string, _good boolean, _fold long"))
    by = {r["url"][-5:]: r["score"] for r in out.filter("url like '%/z/%'").collect()}
    assert min(by["a-->x"], by["b-->y"]) > 0.01 > -0.01 > max(by["a-->y"], by["b-->x"])


def test_url_parts_and_rules(spark):
    urls = ["https://Sub.Example.COM/en/7x?q#f", "http://example.com/en/8", "ftp://x.net/de/", "http://a.example.net/de/8", "http://org/es/", "net/de/", None, "http://notcom/en/", "http://a.com?x=/en/", "http://fakeexample.com/en/7"]
    host, path = url_filter.host_and_path(F.col("url"))
    rule, says = url_filter.by_rules(F.col("h"), F.col("p"), url_filter.RULES)
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "url string").select(host.alias("h"), path.alias("p")).select("h", "p", rule.alias("r"), says.alias("v")).collect()]
    assert got == [
        ("sub.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("x.net", "/de/", "net/de/", "allow"), ("a.example.net", "/de/8", "example.net/de/8", "block"), ("org", "/es/", "org/es/", "block"),
        ("", "", None, None), ("", "", None, None), ("notcom", "/en/", None, None), ("a.com", "", None, None), ("fakeexample.com", "/en/7", "com/en/", "block"),
    ]


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    monkeypatch.setattr(chat, "CHUNK", 3)
    talk = [("user", f"t{k}") if k % 2 == 0 else ("assistant", f"t{k}") for k in range(7)]
    rows = [(c, k, *talk[k]) for c, n in ((1, 2), (2, 5), (3, 7), (4, 7)) for k in range(n)] + [(5, 0, "user", "t0"), (5, 1, "assistant", "else"), (6, 0, None, None), (6, None, "user", ""), (3, 0, *talk[0]), (None, 0, "user", "null id")]
    out = chat.render(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, id string")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["conv_id"] or 0, r["chunk"])):
        got.setdefault(r["conv_id"], []).append(r["rendered"])
    assert set(got) == {3, 5, 6, None} and len(got[3]) == 3
    assert "".join(got[3]) == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in talk)
    assert chat.render(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_several_texts_of_one_turn_stand_in_their_order(spark):
    # a text that comes late by hash or row order, one that is logged twice, and a conversation that is a prefix only in that order
    tied = [("b" * 40 + x, x) for x in "zaqm"]
    rows = [(1, 0, "user", t) for t, _ in tied] + [(1, 0, "user", tied[0][0]), (1, 1, "user", "more"), (2, 0, "user", tied[1][0]), (2, 0, "user", tied[3][0]), (3, 0, "user", tied[0][0])]
    out = {r["conv_id"]: r["rendered"] for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    piece = lambda t: f"<|im_start|>user\n{t}<|im_end|>\n"
    assert out == {1: "".join(piece(t) for t in [*sorted(t for t, _ in tied), "more"]), 3: piece(tied[0][0])}


def test_url_columns_that_clash(spark):
    rows = [("http://good.net/de/1", True, 1), ("http://bad.com/en/3", False, 3), ("http://a.com/en/9", None, None)]
    names = ["_url", "_row", "good", "bad", "_calibrates", "_held", "_cut", "n", "verdict"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "url string, _good boolean, _fold long, " + ", ".join(f"{n} int" for n in names))
    out = url_filter.judge_by_contexts(df)
    assert out.columns == ["url", *names[:-1], "score", "verdict"]
    assert {tuple(r[n] for n in names[:-1]) for r in out.collect()} == {tuple(range(len(names) - 1))}
