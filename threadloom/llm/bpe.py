"""BPE encoding by speculation and verification, and decoding.

A greedy longest match proposes the tokens of each new word. A proposal is the BPE result exactly when each token
merges to itself and each adjacent pair is compatible, that is when undoing merges from both sides of the cut never
meets a merge that would have come first. All adjacent pairs of all new words of a block are tested together in
arrays; only words with a failing token or pair are merged step by step. Words are what stands between ASCII white
space; a block's distinct words are looked up in a table of about ``KEPT`` words and a block's, and ids and decoded bytes
are gathered from flat arrays. Words are told apart by their bytes.

Defined results: a null text encodes as an empty one, to no ids, and decodes to ''. Special tokens' strings within a
text become their ids, as the library does by default. A text of any length is one row; a word of any length takes
time in proportion to n log n. Repeated rows and extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.wordhash import Words, WordTable, spread
from threadloom.llm.workers import held, parts
from threadloom.runtime import share_code

#: A Python worker forgets all words before it looks up another block's when it has more than so many.
KEPT = 1_500_000
#: The same for pieces of words.
KEPT_PIECES = 150_000
#: Letters of a piece that is merged by itself.
LONG = 64
#: New words that are encoded together.
NEW = 16_384

#: Fixed values of the word tokenizer's pattern, for ASCII text.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")
#: The same for other text.
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + n))
        n += b not in plain
    return out


class WordBpe:
    """The encoder of one tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = [""] * (1 + max(*self.vocab.values(), *added.values()))
        for t, i in [*self.vocab.items(), *added.items()]:
            self.tokens[i] = t
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.mark = min(added, default="<|")[:2]
        ids = self.vocab
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        # the order of merges by id: what the array test below relies on
        if not (np.all(np.diff(made) > 0) and np.all(np.maximum(left, right) < made)):
            raise ValueError("merges must make ascending ids")
        n = len(self.tokens)
        self.split_left, self.split_right = np.arange(n), np.arange(n)
        self.split_left[made], self.split_right[made] = left, right
        key = left * n + right
        by = np.argsort(key)
        self.keys, self.made = key[by], made[by]
        self.rank = {(a, b): m for a, b, m in zip(left.tolist(), right.tolist(), made.tolist(), strict=True)}
        self.whole = np.full(n, -1, np.int8)  # whether a token merges to itself: unknown, no, yes
        # the longest token of those that start with these five letters, or of up to four letters with these three
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            if not (self.end and t.endswith(self.end)):
                for head in {t[:5]} if len(t) > 4 else {t[:3]}:
                    self.reach[head] = max(len(t), self.reach.get(head, 0))
        self.finals = {t.removesuffix(self.end): i for t, i in self.vocab.items() if t.endswith(self.end)} if self.end else self.vocab
        self.longest = max(map(len, self.vocab))
        # all tokens' bytes, each with a space after it, for decoding
        said = [(t + " ").encode() for t in self.tokens]
        self.token_bytes, self.token_ends = np.frombuffer(b"".join(said), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in said])])
        # ids of single letters, by code point; byte letters are below 512
        self.letter_ids, self.final_ids = (np.array([self.vocab.get(chr(c) + e, 0) for c in range(512)]) for e in ("", self.end))
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.forget()

    # -- verification ------------------------------------------------------------------------------------------

    def merge(self, symbols: list[int]) -> list[int]:
        """The exact merging: lowest rank first, leftmost of equals."""
        n, get, never = len(symbols), self.rank.get, len(self.tokens)
        if n <= 40:
            ranks = [get(p, never) for p in zip(symbols, symbols[1:])]  # noqa: B905
            while ranks and (m := min(ranks)) < never:
                i = ranks.index(m)
                symbols[i : i + 2] = [m]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = get((m, symbols[i + 1]), never)
                if i:
                    ranks[i - 1] = get((symbols[i - 1], m), never)
            return symbols
        at, following, previous = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := self.rank.get((at[i], at[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = following[i] if at[i] >= 0 else n
            if j >= n or self.rank.get((at[i], at[j])) != m:
                continue
            at[i], at[j], following[i] = m, -1, following[j]
            if following[j] < n:
                previous[following[j]] = i
                if (r := self.rank.get((m, at[following[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := previous[i]) >= 0 and (r := self.rank.get((at[p], m))) is not None:
                heapq.heappush(heap, (r, p))
        return [x for x in at if x >= 0]

    def merge_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The exact merging of many pieces at once: their ids one after the other, and the number of each.

        A round merges the lowest pair of each piece, wherever it stands in it. What a merge makes comes after it in
        order, so no other merge could have come between these places.
        """
        n, never = len(self.tokens), len(self.tokens)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        code = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        at = self.letter_ids[code].astype(np.int64)
        last = np.cumsum(size) - 1
        if self.end:
            at[last] = self.final_ids[code[last]]
        owner = np.repeat(np.arange(len(pieces)), size)
        done_at, done_owner = [], []

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a * n + b
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[k] == key, self.made[k], never)

        rank = np.full(len(at), never)  # of each letter with the next one
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = ranks(at[inner], at[inner + 1])
        while len(at):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            per = np.diff([*begin, len(at)])
            of = np.repeat(least, per)
            over = of == never
            if over.any():
                done_at.append(at[over])
                done_owner.append(owner[over])
                at, owner, rank, of = at[~over], owner[~over], rank[~over], of[~over]
                if not len(at):
                    break
            hit = rank == of
            if (hit[1:] & hit[:-1]).any():  # of aaa the left two merge
                where = np.flatnonzero(hit)
                run = np.concatenate([[True], np.diff(where) > 1])
                first = np.flatnonzero(run)
                hit[where[(np.arange(len(where)) - np.repeat(first, np.diff([*first, len(where)]))) % 2 == 1]] = False
            where = np.flatnonzero(hit)
            at[where] = of[where]
            keep = np.ones(len(at), bool)
            keep[where + 1] = False
            rank[where] = rank[where + 1]
            at, owner, rank = at[keep], owner[keep], rank[keep]
            new = where - np.arange(len(where))  # where the merged stand now
            new = np.unique(np.concatenate([new, new[new > 0] - 1]))
            new = new[new < len(at) - 1]
            new = new[owner[new] == owner[new + 1]]
            rank[new] = ranks(at[new], at[new + 1])
            ends = np.flatnonzero(owner[1:] != owner[:-1])
            rank[ends], rank[-1] = never, never
        flat, by = np.concatenate(done_at), np.concatenate(done_owner)
        order = np.argsort(by, kind="stable")
        return flat[order], np.bincount(by, minlength=len(pieces))

    def symbols(self, token: str) -> list[int]:
        body, end = (token[: -len(self.end)], True) if self.end and token.endswith(self.end) else (token, False)
        return [self.vocab[c + self.end * (end and i == len(body) - 1)] for i, c in enumerate(body)]

    def stand(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token merges to itself."""
        for t in np.unique(tokens[self.whole[tokens] < 0]).tolist():
            self.whole[t] = self.merge(self.symbols(self.tokens[t])) == [t]
        return self.whole[tokens] == 1

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would keep the cut between each ``a`` and ``b``."""
        n = len(self.tokens)
        pairs, back = np.unique(a * n + b, return_inverse=True)
        one, two = pairs // n, pairs % n
        limit, good, live = np.full(len(pairs), n + 1), np.ones(len(pairs), bool), np.arange(len(pairs))
        while len(live):
            x, y, lim = one[live], two[live], limit[live]
            at = np.minimum(np.searchsorted(self.keys, x * n + y), len(self.keys) - 1)
            meets = (self.keys[at] == x * n + y) & (self.made[at] < lim)
            good[live[meets]] = False
            # undo the later of the two merges; where it is a single letter, the other
            undo_x = x > y
            nx, ny = np.where(undo_x, self.split_right[x], x), np.where(undo_x, y, self.split_left[y])
            lim = np.where(undo_x, x, y + 1)
            stuck_x, stuck_y = undo_x & (nx == x), ~undo_x & (ny == y)
            lim, ny = np.where(stuck_x, y + 1, lim), np.where(stuck_x, self.split_left[y], ny)
            lim, nx = np.where(stuck_y, x, lim), np.where(stuck_y, self.split_right[x], nx)
            over = (stuck_x & (ny == y)) | (stuck_y & (nx == x))
            one[live], two[live], limit[live] = nx, ny, lim
            live = live[~meets & ~over]
        return good[back]

    def propose(self, piece: str) -> list[int]:
        """Greedy longest match; the last token carries the word end."""
        get, reach, last, n, p, out = self.vocab.get, self.reach.get, self.finals.get, len(piece), 0, []
        while True:
            if n - p <= self.longest and (t := last(piece[p:])) is not None:
                out.append(t)
                return out
            q = p + (reach(piece[p : p + 5]) or reach(piece[p : p + 3], 2))
            if q >= n:
                q = n - 1
            while (t := get(piece[p:q])) is None:
                q -= 1
            out.append(t)
            p = q

    def settle(self, pieces: list[str]) -> None:
        """Fills ``self.pieces`` for new pieces, in byte letters."""
        proposed = [self.propose(p) for p in pieces]
        if not proposed:
            return
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for x in proposed for t in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(proposed)), sizes)
        wrong = np.zeros(len(proposed), bool)
        wrong[owner[~self.stand(flat)]] = True
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            wrong[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        raw, ends = flat.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        start = 0
        for p, end in zip(pieces, ends, strict=True):
            self.pieces[p] = raw[start:end]
            start = end
        failing = [pieces[k] for k in np.flatnonzero(wrong).tolist()]
        # long pieces one by one: their many rounds would go over all others' arrays
        for p in [p for p in failing if len(p) > LONG]:
            self.pieces[p] = np.array(self.merge(self.symbols(p + self.end)), "<u4").tobytes()
        if failing := [p for p in failing if len(p) <= LONG]:
            flat, sizes = self.merge_all(failing)
            raw, ends, start = flat.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist(), 0
            for p, end in zip(failing, ends, strict=True):
                self.pieces[p] = raw[start:end]
                start = end

    # -- texts -------------------------------------------------------------------------------------------------

    def mapped(self, piece: str) -> str:
        """A piece in byte letters."""
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)

    def cut(self, word: str) -> list[str | int]:
        """A word's pieces in byte letters; special tokens as their ids."""
        if word.isalpha() and (word.isascii() or (max(word) < "\u0370" and unicodedata.is_normalized("NFC", word))):
            if (low := word.lower()).isalpha():
                return [self.mapped(low)]
        if word.isascii() and self.mark not in word:
            found = _ASCII.findall(word.lower())
            return found if word.isprintable() else [self.mapped(x) for x in found]
        if self.mark not in word and max(word) < "\u0370" and unicodedata.is_normalized("NFC", word):
            # below this letter Python's lower case and the tokenizer's agree
            return [self.mapped(x) for x in _LATIN.findall(word.lower())]
        out: list[str | int] = []
        for part in self.special.split(word) if self.special else [word]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def forget(self) -> None:
        """Lets all words go."""
        self.table, self.pieces = WordTable(), {}
        # two bytes an id where they suffice
        self.ids, self.ends = np.zeros(0, np.uint16 if len(self.tokens) <= 1 << 16 else np.uint32), np.zeros(1, np.int64)

    def _add(self, words: list[bytes]) -> None:
        """Appends the ids of new words."""
        found, sizes = [self.ids], []
        for k in range(0, len(words), NEW):
            if len(self.pieces) > KEPT_PIECES:
                self.pieces = {}
            cuts = [self.cut(w.decode()) for w in words[k : k + NEW]]
            self.settle(list({p for c in cuts for p in c if p.__class__ is str}.difference(self.pieces)))
            pieces = self.pieces
            own = [pieces[c[0]] if len(c) == 1 and c[0].__class__ is str else b"".join([pieces[p] if p.__class__ is str else p.to_bytes(4, "little") for p in c]) for c in cuts]
            found.append(np.frombuffer(b"".join(own), "<u4").astype(self.ids.dtype))
            sizes += [len(x) // 4 for x in own]
        self.ids, self.ends = np.concatenate(found), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def flat(self, texts: pa.Array, decoded: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """All texts' ids in one array and where each text's begin, with the end; where asked for, their decoded bytes likewise."""
        if len(self.table) > KEPT:
            self.forget()
        w = Words(texts)
        entry, new = self.table.look_up(w)
        if new:
            collects = gc.isenabled()
            gc.disable()  # nothing here is cyclic, and what is kept is long to walk
            try:
                self._add(new)
            finally:
                if collects:
                    gc.enable()
        ids, at = gathered(self.ids, self.ends, entry, w.first)
        ids = ids.astype(np.uint32, copy=False)
        return ids, at, *(gathered(self.token_bytes, self.token_ends, ids, at) if decoded else (None, None))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, at, _, _ = self.flat(pa.array(texts, pa.large_string()))
        return [ids[a:b].astype("<u4", copy=False).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        """The tokens joined by one space, as the library does where the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def gathered(values: np.ndarray, ends: np.ndarray, entry: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all entries, one after the other, and where each text's begin; ``first`` numbers texts' first entries."""
    size = ends[entry + 1] - ends[entry]
    to = np.zeros(len(entry) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    out, step = np.empty(int(to[-1]), values.dtype), 1 << 17
    for a in range(0, len(entry), step):  # places of a part at a time
        b = min(len(entry), a + step)
        out[to[a] : to[b]] = values[spread(ends[entry[a:b]], size[a:b])]
    return out, to[first]


def encoder(path: str) -> WordBpe:
    """The worker's encoder of ``path``."""
    return held(("bpe", path), lambda: WordBpe(path))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of each row."""
    share_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in parts(batches):
            ids, at, said, to = bpe.flat(part.column(1), True)
            spans = zip(at[:-1].tolist(), at[1:].tolist(), to[:-1].tolist(), to[1:].tolist(), strict=True)
            rows = [(ids[a:b].astype("<u4", copy=False).tobytes(), said[c : max(c, d - 1)].tobytes().decode()) for a, b, c, d in spans]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with only the number of ids and the digests of ids and decoded text."""
    share_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(path), hashlib.sha256
        for part in parts(batches):
            ids, at, said, to = bpe.flat(part.column(1), True)
            own = [sha(ids[a:b].astype("<u4", copy=False)).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            texts = [sha(said[c : max(c, d - 1)]).hexdigest() for c, d in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]  # without the last space
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(own, pa.string()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, which is at the same place on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_speculative_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode ``documents``."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
