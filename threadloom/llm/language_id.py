"""Language identification by a linear-chain conditional random field over words.

Each word's features are its affixes of one to three letters, its letter n-grams of one to three, and its place in a
lexicon of the training words seen in several documents. Weights and transitions are learned together by gradient
ascent on the likelihood of sequences that switch languages: runs of words from documents of different languages, put
one after the other. Forward-backward then gives each word's posterior, so code-switched text is labelled word by word;
a document's language is the one with the largest mean posterior over all of its words, and its score that mean.

A sequence is up to ``SPAN`` consecutive words; a longer text is several. The classifier is fitted on a bounded sample of
labelled rows: ``DOCS`` documents of each language, chosen by a hash of the id over all of them, fewer where there are
so many languages that they would be more than ``ALL_DOCS``; of these the whole texts, in runs of ``RUN_WORDS`` words.
Prediction reads every whole text. Words are what stands between ASCII white space; of a word only letters count.

Defined results: null text, or text without a letter, is ``und`` with score 0. With no labelled row everything is
``und``. A null label is never learned. Ties go to the first language in order. Repeated rows are predicted alike; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.wordhash import Words, WordTable
from threadloom.llm.workers import held, parts
from threadloom.runtime import share_code

DOCS, ALL_DOCS, RUN_WORDS = 150, 4096, 14
SPAN = 128
BITS = 17
LEXICON = 20_000
#: A Python worker forgets all words before another block when it has more than so many.
KEPT = 1_000_000
#: New words that are scored together.
NEW = 16_384
EPOCHS, RATE, L2 = 3, 0.3, 1e-6
UNKNOWN = "und"

_WORD = regex.compile("[^\x20\x09-\x0d]+")
_LETTERS = regex.compile(r"\p{L}+")


def core(chunk: str) -> str:
    """The letters of what stands between white space, in lower case; '' if it has none."""
    if chunk.isalpha():
        return chunk.lower()
    return "".join(_LETTERS.findall(chunk)).lower()


class Features:
    """Hashed affixes and n-grams, and the lexicon's own rows after them."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = {w: (1 << BITS) + i for i, w in enumerate(lexicon)}
        self.rows = (1 << BITS) + len(lexicon)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' features in one array, and where each word's start; no word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), sizes)
        first = np.cumsum(sizes) - sizes
        place, size = np.arange(len(code)) - first[owner], sizes[owner]
        after = np.concatenate([code[1:], [0]]).astype(np.uint64), np.concatenate([code[2:], [0, 0]]).astype(np.uint64)
        one, two = code + np.uint64(1), (code + np.uint64(1)) * np.uint64(0x1F123BB5) + after[0]
        three = two * np.uint64(0x5851F42D) + after[1]
        found, by = [], []
        for n, gram in ((1, one), (2, two), (3, three)):
            fits = place + n <= size
            for kind, where in ((0, fits), (1, fits & (place == 0)), (2, fits & (place + n == size))):
                found.append((gram[where] * np.uint64(8) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
                by.append(owner[where])
        hashed = (np.concatenate(found) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)
        known = [(i, r) for i, w in enumerate(words) if (r := self.lexicon.get(w)) is not None]
        by.append(np.array([i for i, _ in known], np.int64))
        hashed = np.concatenate([hashed, np.array([r for _, r in known], np.int64)])
        by_all = np.concatenate(by)
        order = np.argsort(by_all, kind="stable")
        return hashed[order], np.searchsorted(by_all[order], np.arange(len(words)))


class Crf:
    """Weights of features by label, and of label pairs."""

    def __init__(self, labels: list[str], features: Features):
        n = len(labels)
        self.labels, self.features = labels, features
        self.weights, self.pairs = np.zeros((features.rows, n), np.float32), np.zeros((n, n))

    def emissions(self, words: list[str]) -> np.ndarray:
        """The score of each word under each label."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        rows, starts = self.features.of(words)
        return np.add.reduceat(self.weights[rows], starts, axis=0) / np.sqrt(np.diff([*starts, len(rows)]))[:, None].astype(np.float32)

    def posteriors(self, emissions: np.ndarray, sizes: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward for sequences that stand one after the other; sequences of a like length go together.

        Gives each word's posterior and, where asked for, the expected label pairs.
        """
        n = len(self.labels)
        heat, move = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float64), np.exp(self.pairs)
        first = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        first, size = first[order], sizes[order]
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
        ahead, back = np.zeros_like(heat), np.ones_like(heat)
        for t in range(steps):
            at = first[: live[t]] + t
            a = heat[at] if not t else heat[at] * (ahead[at - 1] @ move)
            ahead[at] = a / a.sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            at = first[: live[t + 1]] + t
            b = (heat[at + 1] * back[at + 1]) @ move.T
            back[at] = b / b.sum(1, keepdims=True)
        post = ahead * back
        post /= post.sum(1, keepdims=True)
        if not pairs:
            return post, move
        inner = np.ones(len(heat), bool)
        inner[np.cumsum(sizes) - 1] = False
        i = np.flatnonzero(inner)
        joint = ahead[i][:, :, None] * move[None] * (heat[i + 1] * back[i + 1])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        return post, joint.sum(0).reshape(n, n)

    def fit(self, words: list[str], truth: np.ndarray, sizes: np.ndarray, batch: int = 256) -> None:
        """Gradient ascent on the likelihood, with steps scaled by what each weight has moved so far."""
        n, starts = len(self.labels), np.cumsum(sizes) - sizes
        past, past_pairs = np.full(self.weights.shape, 1e-4, np.float32), np.full((n, n), 1e-4)
        rng = np.random.default_rng(7)
        for _ in range(EPOCHS):
            deal = rng.permutation(len(sizes))
            for k in range(0, len(deal), batch):
                own = deal[k : k + batch]
                index = np.concatenate([np.arange(starts[s], starts[s] + sizes[s]) for s in own])
                rows, at = self.features.of([words[i] for i in index])
                per = np.diff([*at, len(rows)])
                scale = (1 / np.sqrt(per)).astype(np.float32)
                e = np.add.reduceat(self.weights[rows], at, axis=0) * scale[:, None]
                post, joint = self.posteriors(e, sizes[own], True)
                gap = -post
                gap[np.arange(len(index)), truth[index]] += 1
                t = truth[index]
                inner = np.ones(len(index), bool)
                inner[np.cumsum(sizes[own]) - 1] = False
                i = np.flatnonzero(inner)
                seen = np.zeros((n, n))
                np.add.at(seen, (t[i], t[i + 1]), 1)
                used, back = np.unique(rows, return_inverse=True)
                spread = np.repeat(gap * scale[:, None], per, axis=0)
                grad = np.column_stack([np.bincount(back, spread[:, y], len(used)) for y in range(n)]).astype(np.float32) - L2 * self.weights[used]
                past[used] += grad * grad
                self.weights[used] += RATE * grad / np.sqrt(past[used])
                g = (seen - joint) / len(own)
                past_pairs += g * g
                self.pairs += RATE * g / np.sqrt(past_pairs)


def training_runs(df: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, str, str]]:
    """Label, id and words of each run: a bounded sample, chosen over all rows."""
    labelled = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    labels = labelled.select(label_col).distinct().count()
    most = max(1, min(DOCS, ALL_DOCS // max(1, labels)))
    pick = Window.partitionBy("label").orderBy("h", "id")
    ids = labelled.select(F.col(label_col).alias("label"), F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h")).withColumn("n", F.row_number().over(pick)).filter(F.col("n") <= most).select("label", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, label in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = [w for c in _WORD.findall(text) if (w := core(c))]
                rows += [(label, str(i), " ".join(words[p : p + RUN_WORDS])) for p in range(0, len(words), RUN_WORDS)]
            yield pa.RecordBatch.from_pydict({k: pa.array([r[c] for r in rows], pa.string()) for c, k in enumerate(("label", "id", "run"))})

    # at most ALL_DOCS rows, or one a language
    texts = labelled.join(F.broadcast(ids.withColumnRenamed("label", "_label")), (F.col(id_col) == F.col("id")) & (F.col(label_col) == F.col("_label")), "left_semi")
    found = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).mapInArrow(cut, "label string, id string, run string").collect()
    return sorted(tuple(r) for r in found)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Crf | None:
    """A field fitted on the labelled rows of ``df``; None without any."""
    share_code(df.sparkSession)
    runs = [(label, i, r.split(" ")) for label, i, r in training_runs(df, id_col, text_col, label_col)]
    if not runs:
        return None
    labels = sorted({r[0] for r in runs})
    docs: dict[str, set[str]] = {}
    for _, i, words in runs:
        for w in words:
            docs.setdefault(w, set()).add(i)
    often = Counter({w: len(d) for w, d in docs.items() if len(d) > 2})
    crf = Crf(labels, Features([w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]]))
    rng = np.random.default_rng(11)
    words, truth, sizes = [], [], []
    at, order = 0, rng.permutation(len(runs))
    while at < len(order):  # one to four runs make a sequence
        n = int(rng.integers(1, 5))
        own = order[at : at + n]
        at += n
        before = len(words)
        for k in own:
            words += runs[k][2]
            truth += [labels.index(runs[k][0])] * len(runs[k][2])
        sizes.append(len(words) - before)
    crf.fit(words, np.array(truth), np.array(sizes))
    return crf


class Reader:
    """A field with the words whose scores it keeps, for one worker."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.forget()

    def forget(self) -> None:
        """Lets all words go."""
        self.table, self.scores, self.lettered = WordTable(), np.zeros((0, len(self.crf.labels)), np.float32), np.zeros(0, bool)

    def _add(self, words: list[bytes]) -> None:
        scores, lettered = [self.scores], [self.lettered]
        for k in range(0, len(words), NEW):
            place: dict[str, int] = {}
            at = np.array([place.setdefault(c, len(place)) if (c := core(w.decode())) else -1 for w in words[k : k + NEW]], np.int64)
            # the last row is of words without letters
            made = np.concatenate([self.crf.emissions(list(place)), np.zeros((1, len(self.crf.labels)), np.float32)])
            scores.append(made[at])
            lettered.append(at >= 0)
        self.scores, self.lettered = np.concatenate(scores), np.concatenate(lettered)

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean posterior of each label, and its number of words with letters."""
        if len(self.table) > KEPT:
            self.forget()
        w = Words(texts)
        entry, new = self.table.look_up(w)
        if new:
            self._add(new)
        fits = self.lettered[entry] if len(entry) else np.zeros(0, bool)
        owner, index = w.owner[fits], entry[fits]
        counts = np.bincount(owner, minlength=len(texts))
        if not len(index):
            return np.zeros((len(texts), len(self.crf.labels))), counts
        nth = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        cuts = np.flatnonzero(nth % SPAN == 0)
        post, _ = self.crf.posteriors(self.scores[index], np.diff([*cuts, len(index)]))
        return np.column_stack([np.bincount(owner, post[:, y], len(texts)) for y in range(post.shape[1])]) / np.maximum(counts, 1)[:, None], counts

    def texts(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Each text's language and score."""
        mean, counts = self.means(texts)
        best, score = mean.argmax(1), np.minimum(1.0, mean.max(1).round(6))
        return [self.crf.labels[b] if c else UNKNOWN for b, c in zip(best.tolist(), counts.tolist(), strict=True)], np.where(counts > 0, score, 0.0)

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a text with its language and posterior: the field's own output on code-switched text."""
        words = [w for c in _WORD.findall(text) if (w := core(c))]
        if not words:
            return []
        post, _ = self.crf.posteriors(self.crf.emissions(words), np.diff([*range(0, len(words), SPAN), len(words)]))
        return [(w, self.crf.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, post, strict=True)]


def _reader(sent, key: int) -> Reader:
    return held(("crf", key), lambda: Reader(sent.value))


def _send(spark, crf: Crf) -> tuple:
    """The field for all workers, of fixed size: 2**BITS hashed rows and the lexicon, a number for each label; and what tells it from others."""
    return spark.sparkContext.broadcast(crf), zlib.crc32(crf.weights.tobytes() + repr(crf.labels).encode())


def predict(df: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``lang_pred`` and ``score`` of every row."""
    spark = df.sparkSession
    share_code(spark)
    if crf is None:
        return df.select(F.col(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent, key = _send(spark, crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(sent, key)
        for part in parts(batches):
            lang, score = reader.texts(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, crf: Crf | None, least: float, text_col: str = "text") -> DataFrame:
    """``df`` without the rows that are ``und`` or whose score is too near to chance; rows and columns are unchanged.

    With k languages the score of a text that fits none is about 1/k; ``least`` is the part of the way from there to 1
    that a score must have gone. So text in a script that the field never saw goes, and with one language only
    letterless text does. Without a field nothing but letterless text goes.
    """
    spark = df.sparkSession
    share_code(spark)
    if crf is None:
        return df.filter(F.col(text_col).rlike(r"\p{L}"))
    sent, key = _send(spark, crf)
    column, bound = df.columns.index(text_col), (1 + least * (len(crf.labels) - 1)) / len(crf.labels) if len(crf.labels) > 1 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(sent, key)
        for part in parts(batches, column):
            mean, counts = reader.means(part.column(column))
            yield part.filter(pa.array((counts > 0) & (mean.max(1) >= bound)))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op9_crf(spark, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crf = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, crf).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
