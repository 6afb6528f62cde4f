"""Words, and hashes of word windows, over whole Arrow text columns at once.

Hashes are made ``CHUNK`` bytes at a time with sums carried from chunk to chunk, so working memory beyond the text itself
is about 20 bytes a word, however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time.
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MASK = (1 << 64) - 1
# odd multipliers
_B, _C, _D = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, for one chunk."""
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_B), _powers(pow(_B, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each word; words don't overlap and stand in order."""
    low, high, scale = (np.empty(len(start), np.uint64) for _ in range(3))
    carry, up, down = 0, 1, 1
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=sums[1:])
        sums *= np.uint64(up)
        sums += np.uint64(carry)
        i, j = np.searchsorted(start, [a, a + len(part)])
        low[i:j], scale[i:j] = sums[start[i:j] - a], _DOWN[start[i:j] - a] * np.uint64(down)
        i, j = np.searchsorted(end, [a, a + len(part)], side="right")
        high[i:j] = sums[end[i:j] - a]
        carry, up, down = int(sums[-1]), up * int(_UP[CHUNK]) & _MASK, down * int(_DOWN[CHUNK]) & _MASK
    high -= low
    high *= scale
    return mix(high)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a text column: where they stand in its bytes, their hashes, and each text's share."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        base = int(at[0])
        raw = np.frombuffer(data, np.uint8)[base : int(at[-1])] if data is not None and len(texts) else np.zeros(0, np.uint8)
        at = at - base
        kind = np.int32 if len(raw) < 2**31 else np.int64
        self.data = _LOWER[raw] if lower else raw
        space = np.ones(len(raw) + 1, bool)
        space[:-1] = _SPACE[raw]
        edge = space.copy()
        edge[1:] |= space[:-1]
        edge[0] = edge[at] = True
        # a word begins at an edge that is no space, and ends where an edge follows a letter
        self.start = np.flatnonzero(edge & ~space).astype(kind)
        edge = space
        edge[at] = True
        after = np.zeros(len(raw) + 1, bool)
        after[1:] = ~_SPACE[raw]
        self.end = np.flatnonzero(edge & after).astype(kind)
        del space, edge, after
        self.first = np.searchsorted(self.start, at)  # of each text, the number of its first word
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        self.hash = _hashes(self.data, self.start, self.end)

    def windows(self, k: int, which: int = 0) -> np.ndarray:
        """A hash of the k words from each word on, one of two; at a text's last k - 1 words it means nothing."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.hash[:n].copy()
        for j in range(1, k):
            out *= np.uint64((_C, _D)[which])
            out += self.hash[j : n + j]
        return mix(out)

    def whole(self, k: int) -> np.ndarray:
        """Which of ``windows(k)`` lie within one text."""
        return self.owner[k - 1 :] == self.owner[: max(0, len(self.owner) - k + 1)]

    def word(self, k: int) -> bytes:
        """One word."""
        return self.data[self.start[k] : self.end[k]].tobytes()

    def text(self, row: int) -> list[bytes]:
        """The words of one text."""
        a, b = self.first[row], self.first[row + 1]
        raw = self.data[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""
        return raw.split()

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number among the distinct ones, and where each of these stands first. Words are told apart by their bytes, not by hashes."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = pa.array(self.hash).dictionary_encode()
        codes, kinds = coded.indices.to_numpy(), len(coded.dictionary)
        first = _firsts(codes, kinds)
        if self._differ(first[codes]):  # some hash stands for two words
            own: dict[bytes, int] = {}
            codes = np.array([own.setdefault(self.word(k), len(own)) for k in range(len(codes))], np.int64)
            first = _firsts(codes, len(own))
        return codes, first

    def _differ(self, other: np.ndarray) -> bool:
        """Whether any word is not the word that ``other`` gives for it."""
        size, step = self.end - self.start, 1 << 17
        if not np.array_equal(size, size[other]):
            return True
        for a in range(0, len(size), step):
            n = size[a : a + step]
            mine, theirs = spread(self.start[a : a + step], n), spread(self.start[other[a : a + step]], n)
            if not np.array_equal(self.data[mine], self.data[theirs]):
                return True
        return False


def _firsts(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes stands first."""
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    before = np.cumsum(size, dtype=np.int64) - size
    out = np.arange(int(size.sum(dtype=np.int64)))
    out += np.repeat(start - before, size)
    return out


class WordTable:
    """Words seen so far, numbered as they came; about 30 bytes each, without an object a word."""

    def __init__(self):
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.data, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def look_up(self, w: Words) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word of ``w``, and those that are new, in order of their numbers."""
        codes, first = w.distinct()
        h = w.hash[first]
        at = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        meets = np.flatnonzero(self.hash[at] == h) if len(self.hash) else np.zeros(0, np.int64)
        mine, theirs = first[meets], self.number[at[meets]] if len(meets) else np.zeros(0, np.int32)
        size = (w.end[mine] - w.start[mine]).astype(np.int64)
        same = self.ends[theirs + 1] - self.ends[theirs] == size
        mine, theirs, meets, size = mine[same], theirs[same], meets[same], size[same]
        if len(meets):  # a hash that meets isn't enough: all bytes must
            wrong = w.data[spread(w.start[mine], size)] != self.data[spread(self.ends[theirs], size)]
            good = ~np.logical_or.reduceat(wrong, np.cumsum(size) - size)
            meets, theirs = meets[good], theirs[good]
        number = np.full(len(first), -1, np.int64)
        number[meets] = theirs
        new = np.flatnonzero(number < 0)
        number[new] = np.arange(len(self), len(self) + len(new))
        words = [w.word(k) for k in first[new].tolist()]
        if words:
            self.data = np.concatenate([self.data, np.frombuffer(b"".join(words), np.uint8)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in words])])
            # one of two words with one hash is found by it; the other is new each time
            hashes, one = np.unique(h[new], return_index=True)
            fresh = ~np.isin(hashes, self.hash[at]) if len(self.hash) else np.ones(len(hashes), bool)
            place = np.searchsorted(self.hash, hashes[fresh])
            self.hash = np.insert(self.hash, place, hashes[fresh])
            self.number = np.insert(self.number, place, number[new][one[fresh]].astype(np.int32))
        return number[codes], words


def lowest(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
