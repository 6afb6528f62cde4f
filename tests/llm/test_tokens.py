import bisect
import collections
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import bpe, packing

from .conftest import ODD

PATH = bpe.tokenizer_path()
BPE = bpe.WordBpe(PATH)


def same(texts):
    for t, ids in zip(texts, BPE.encode(texts), strict=True):
        want = BPE.library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)[:200]
        assert BPE.decode(ids) == BPE.library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same([text])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinorst'é .,1", max_size=80))
def test_word_like_text(text):
    same([text])


def test_special_and_odd_text():
    same([None, "", "\x1ca\x1d b", "Σας ΟΔΟΣ İstanbul ǅ", "<|startoftext|>hi<|ENDOFTEXT|><|endoftext|>x<|", "á é", "½ ² ﬁ", "中文 한국어 😀", "I'VE don't", "a" * 5000, "!" * 3000 + "q" * 3000, "x　y"])


def test_merging_many_pieces_at_once():
    r = random.Random(4)
    pieces = ["".join(r.choice("aaabdeinost") for _ in range(r.randrange(1, 30))) for _ in range(3000)] + ["a" * k for k in range(1, 60)]
    flat, sizes = BPE.merge_all(pieces)
    at = np.cumsum([0, *sizes])
    for k, p in enumerate(pieces):
        assert flat[at[k] : at[k + 1]].tolist() == BPE.merge(BPE.symbols(p + BPE.end)), p


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    r = random.Random(0)
    for _ in range(30):
        same([" ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(40))])


def test_encode_table(odd, none):
    rows = bpe.digests(odd, PATH).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert bpe.digests(none, PATH).count() == 0 and bpe.encode(odd, PATH).columns == ["doc_id", "ids", "decoded"]


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_pack_table(odd, none):
    rows = packing.pack(odd, PATH, capacity=64, groups=4).collect()
    check(rows, 64)
    for i, text in {(r[0], r[1]) for r in ODD}:
        ids = BPE.encode([text])[0] + (1).to_bytes(4, "little")
        own = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert sum(n for _, n in set(own)) >= len(ids) // 4
        assert all(n <= 64 for _, n in own)
    assert packing.pack(none, PATH).count() == 0


def test_plans_are_tight_and_whole():
    r = np.random.default_rng(5)
    for n in (1, 7, 300, 20_000):
        lengths = np.minimum(4096, r.lognormal(6.5, 1.1, n).astype(int) + 1)
        hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = packing.best_plan(hist)
        key, number, per, first, offset = plan.arrays()
        rows = []
        for length, count in hist.items():
            nth = np.arange(count)
            at = np.searchsorted(key, (length << 44) | nth, side="right") - 1
            k = nth - number[at]
            rows += [dict(sequence_id=s, offset=o, length=length) for s, o in zip((first[at] + k // per[at]).tolist(), (offset[at] + k % per[at] * length).tolist(), strict=True)]
        used = check(rows, 4096)
        assert used == plan.sequences <= -(-int(lengths.sum()) // 4096) * 1.03 + 3


def best_fit(lengths, capacity):
    """Sequences that best fit takes, longest first, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - n)
    return len(rooms)


def test_never_more_sequences_than_best_fit():
    r, fewer = random.Random(11), 0
    draws = [lambda: r.randint(1, 4096), lambda: max(1, min(4096, int(r.lognormvariate(6, 1)))), lambda: r.randint(600, 2099)]
    for k in range(45):
        lengths = [draws[k % 3]() for _ in range(r.randint(20, 2000))]
        used, plain = packing.best_plan(collections.Counter(lengths)).sequences, best_fit(lengths, 4096)
        assert -(-sum(lengths) // 4096) <= used <= plain
        fewer += used < plain
    assert fewer > 5


def test_op4_rebuilds_every_document(spark, tmp_path):
    """Every piece's start, length and ids against the library, every sequence without gap or overlap."""
    r = random.Random(2)
    texts = [None, "", " ", *(" ".join("".join(r.choice("abdeino") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 900))) for _ in range(40)), "long word list " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.op4_linear_grouping(spark, str(tmp_path)).collect()
    own = collections.defaultdict(dict)
    for x in rows:
        own[x["doc_id"]][x["piece"]] = x
    assert set(own) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*BPE.library.encode(text or "", add_special_tokens=False).ids, 1]
        assert sorted(own[i]) == list(range(-(-len(ids) // 4096)))
        for k, x in own[i].items():
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (x["start"], x["length"], x["ids_crc32"]) == (4096 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert check(rows, 4096) <= best_fit([x["length"] for x in rows], 4096)
