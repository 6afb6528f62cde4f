"""A living BM25 index: immutable segments, tombstones, merges by size, and top lists that skip what can't be in them.

A change writes one segment: the postings of what is new, the ids that are gone from older segments, and by how much each
term's and the whole's counts change, so that statistics are of live documents always and no older segment is read for
them. Segments that are no larger than ``FANOUT`` times all later ones are merged with these, so there are as many as the
logarithm of the documents. A numbered set names the segments that count; it is marked last, and older sets stay
readable until ``vacuum``.

Postings of a term stand in blocks of like impact: by frequency, and by the logarithm of the length. There are some
hundreds of blocks a term at most, whatever its documents, so their bounds come to the driver; a top list reads the best
blocks first, and after them only those whose bound, with the other words' best, reaches the worst of what it has.

Defined results: a document without words counts in the statistics and is never found. Equal scores, at six places, are
all in a top list. An empty index gives no rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.archive import Archive
from threadloom.functions import text as T
from threadloom.runtime import delete, exists

# Okapi BM25's parameters.
K1, B = 1.2, 0.75
#: A segment is merged with later ones unless it is so many times larger than these together.
FANOUT = 2
#: Frequencies from here on are in one block.
MOST = 15
_DOCS = "seg string, id string, n int, words array<struct<term: string, f: int>>"
_POSTINGS = "seg string, term string, block int, id string, n int, f int"
_BLOCKS = "seg string, term string, block int, docs long, f int, n int"
_TERMS, _GONE = "seg string, term string, df long", "seg string, id string"
_SETS = "number long, at int, seg string, docs long"
_MARKS = "number long, generation long, n long, tokens long"


@dataclass(frozen=True)
class Segments:
    """A set: its segments, oldest first, with their documents; and the statistics of what is live."""

    number: int
    generation: int
    n: int
    tokens: int
    names: tuple[str, ...]
    docs: tuple[int, ...]


def words_of(query: str) -> list[str]:
    """A query's words, each once."""
    return sorted(set("".join(c if "a" <= c <= "z" else " " for c in query.lower()).split()))


def term_weight(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


def _part(f, n, mean: float):
    return f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean))


class Index:
    """An index of an archive's messages in a folder."""

    def __init__(self, archive: Archive, path: str):
        self.archive, self.path, self.spark = archive, path.rstrip("/"), archive.spark

    # -- sets and segments

    def current(self) -> Segments | None:
        """The latest set; it is the same until the next mark, whatever is written beside it."""
        if not exists(self.spark, f"{self.path}/marks"):
            return None
        mark = self.spark.read.schema(_MARKS).parquet(f"{self.path}/marks").orderBy(F.col("number").desc()).first()
        if mark is None:
            return None
        rows = self.spark.read.schema(_SETS).parquet(f"{self.path}/sets/{mark['number']}").orderBy("at").collect()
        return Segments(mark["number"], mark["generation"], mark["n"], mark["tokens"], tuple(r["seg"] for r in rows), tuple(r["docs"] for r in rows))

    def stale(self, generation: int) -> bool:
        """Whether the archive has moved on since the index did."""
        s = self.current()
        return s is None or s.generation < generation

    def _read(self, names: tuple[str, ...], table: str, shape: str) -> DataFrame:
        return self.spark.read.schema(shape).parquet(*[f"{self.path}/segments/{x}/{table}" for x in names]) if names else self.spark.createDataFrame([], shape)

    def _live(self, rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
        """``rows`` (seg, id) without those that a later segment declares gone."""
        if len(names) < 2:
            return rows
        place = F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name), F.lit(k))])
        gone = self._read(names[1:], "gone", _GONE).groupBy("id").agg(F.max(place[F.col("seg")]).alias("_gone"))
        return rows.join(gone, "id", "left").filter(F.col("_gone").isNull() | (F.col("_gone") <= place[F.col("seg")])).drop("_gone")

    def _write(self, docs: DataFrame, gone: DataFrame, terms: DataFrame) -> tuple[str, int, int]:
        """A segment of ``docs`` (id, n, words); its name, documents and words."""
        name = uuid.uuid4().hex[:16]
        at = f"{self.path}/segments/{name}"
        seg = F.lit(name).alias("seg")
        docs.select(seg, "id", "n", "words").write.parquet(f"{at}/docs")
        own = self._read((name,), "docs", _DOCS)
        block = (F.least("f", F.lit(MOST)) * 64 + F.floor(F.log2(F.col("n") + 1))).cast("int")
        each = own.select("seg", "id", "n", F.inline("words")).select("seg", "term", block.alias("block"), "id", "n", "f")
        each.repartitionByRange("term", "block", "id").sortWithinPartitions("term", "block", "id").write.parquet(f"{at}/postings")
        self._read((name,), "postings", _POSTINGS).groupBy("seg", "term", "block").agg(F.count(F.lit(1)).alias("docs"), F.max("f").alias("f"), F.min("n").alias("n")).sortWithinPartitions("term").write.parquet(f"{at}/blocks")
        terms.select(seg, "term", "df").write.parquet(f"{at}/terms")
        gone.select(seg, "id").write.parquet(f"{at}/gone")
        sums = own.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")).first()
        return name, sums["docs"], sums["tokens"] or 0

    def _mark(self, before: Segments | None, generation: int, n: int, tokens: int, segments: list[tuple[str, int]]) -> None:
        number = before.number + 1 if before else 1
        rows = [(number, k, name, docs) for k, (name, docs) in enumerate(segments)]
        self.spark.createDataFrame(rows, _SETS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sets/{number}")
        self.spark.createDataFrame([(number, generation, n, tokens)], _MARKS).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")

    # -- changes

    def _documents(self, messages: DataFrame) -> DataFrame:
        """``id``, ``n`` and ``words``, each word of a message with its frequency."""
        told = messages.select("id", T.tokens(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("thinking", F.lit("")))).alias("w"))
        counts = told.select("id", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).cast("int").alias("f")).groupBy("id").agg(F.collect_list(F.struct("term", "f")).alias("words"))
        return told.select("id", F.size("w").alias("n")).join(counts, "id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<term: string, f: int>>")))

    def build(self, generation: int) -> None:
        """All messages in one segment; sets from before stay readable."""
        docs = self._documents(self.archive.messages)
        terms = docs.select(F.inline("words")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        name, n, tokens = self._write(docs, self.spark.createDataFrame([], "id string"), terms)
        self._mark(self.current(), generation, n, tokens, [(name, n)])

    def update(self, generation: int, changed: DataFrame) -> None:
        """Takes over what the archive has, or no longer has, of the ids ``changed``, and merges segments that are due."""
        s = self.current()
        if s is None:
            self.build(generation)
            return
        ids = changed.select("id").distinct()
        new = self._documents(self.archive.messages.join(ids, "id", "left_semi"))
        dead = self._live(self._read(s.names, "docs", _DOCS), s.names).join(ids, "id", "left_semi")
        delta = new.select(F.inline("words"), F.lit(1).alias("by")).unionByName(dead.select(F.inline("words"), F.lit(-1).alias("by")))
        name, docs, tokens = self._write(new, dead.select("id"), delta.groupBy("term").agg(F.sum("by").alias("df")).filter("df <> 0"))
        less = dead.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("tokens")).first()
        segments = [*zip(s.names, s.docs, strict=True), (name, docs)]
        self._mark(s, generation, s.n + docs - less["n"], s.tokens + tokens - (less["tokens"] or 0), segments)
        self.merge()

    def merge(self) -> bool:
        """Merges the latest segments, as long as the one before isn't ``FANOUT`` times as large; whether there was anything to do."""
        s = self.current()
        if s is None:
            return False
        first, total = len(s.names) - 1, s.docs[-1]
        while first and s.docs[first - 1] <= FANOUT * total:
            first -= 1
            total += s.docs[first]
        if first == len(s.names) - 1:
            return False
        due = s.names[first:]
        docs = self._live(self._read(due, "docs", _DOCS), due).select("id", "n", "words")
        # what older segments have and is gone stays told; without older ones nothing is
        gone = self._read(due if first else (), "gone", _GONE).select("id").distinct()
        terms = self._read(due, "terms", _TERMS).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        name, n, _ = self._write(docs, gone, terms)
        self._mark(s, s.generation, s.n, s.tokens, [*zip(s.names[:first], s.docs[:first], strict=True), (name, n)])
        return True

    def vacuum(self) -> int:
        """Deletes segments of older sets only, once nobody reads these; how many."""
        s = self.current()
        if s is None:
            return 0
        older = [f"{self.path}/sets/{k}" for k in range(1, s.number) if exists(self.spark, f"{self.path}/sets/{k}")]
        names = {r["seg"] for p in older for r in self.spark.read.schema(_SETS).parquet(p).select("seg").collect()} - set(s.names)
        for path in [*(f"{self.path}/segments/{x}" for x in names), *older]:
            delete(self.spark, path)
        return len(names)

    # -- queries

    def _weights(self, s: Segments, words: list[str]) -> dict[str, float]:
        """Of the words that live documents have; a row a word and segment comes to the driver."""
        rows = self._read(s.names, "terms", _TERMS).filter(F.col("term").isin(words)).groupBy("term").agg(F.sum("df").alias("df")).collect()
        return {r["term"]: term_weight(s.n, r["df"]) for r in rows if r["df"] > 0}

    def _scored(self, s: Segments, weights: dict[str, float], wanted: Column) -> DataFrame:
        own = self._live(self._read(s.names, "postings", _POSTINGS).filter(wanted), s.names)
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("term")]
        return own.groupBy("id").agg(F.sum(weight * _part(F.col("f"), F.col("n"), s.tokens / s.n)).alias("score"))

    def scores(self, query: str) -> DataFrame:
        """``id`` and ``score`` of all messages that have any of the words."""
        s, words = self.current(), words_of(query)
        weights = self._weights(s, words) if s and words and s.n else {}
        if not weights:
            return self.spark.createDataFrame([], "id string, score double")
        return self._scored(s, weights, F.col("term").isin(list(weights))).select("id", F.round("score", 6).alias("score"))

    def top(self, query: str, k: int) -> DataFrame:
        """``id`` and ``score`` of the ``k`` best, and of all that are as good as the last of them."""
        s, words = self.current(), words_of(query)
        weights = self._weights(s, words) if s and words and s.n else {}
        if not weights or k < 1:
            return self.spark.createDataFrame([], "id string, score double")
        # at most some hundred rows a word and segment
        blocks = self._read(s.names, "blocks", _BLOCKS).filter(F.col("term").isin(list(weights))).groupBy("term", "block").agg(F.sum("docs").alias("docs"), F.max("f").alias("f"), F.min("n").alias("n")).collect()
        bound = {(r["term"], r["block"]): weights[r["term"]] * _part(r["f"], r["n"], s.tokens / s.n) for r in blocks}
        docs = {(r["term"], r["block"]): r["docs"] for r in blocks}
        best: dict[str, float] = {}
        for (term, _), b in bound.items():
            best[term] = max(best.get(term, 0.0), b)
        first, total = [], 0
        for key in sorted(bound, key=lambda x: -bound[x]):
            if total >= 2 * k:  # twice as many, as some may be gone
                break
            first.append(key)
            total += docs[key]
        worst = 0.0
        if len(first) < len(bound):
            floor = self._scored(s, weights, _any_of(first)).orderBy(F.col("score").desc()).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).first()
            worst = floor["worst"] if floor["n"] == k else 0.0
        # a document as good as the worst has each of its words in a block that may hold such a one
        reach = [key for key, b in bound.items() if b + sum(x for t, x in best.items() if t != key[0]) >= worst - 1e-6]
        found = self._scored(s, weights, _any_of(reach)).select("id", F.round("score", 6).alias("score"))
        last = found.orderBy(F.col("score").desc()).limit(k).agg(F.min("score")).first()[0]
        return found.filter(F.col("score") >= F.lit(last))


def _any_of(keys: list[tuple[str, int]]) -> Column:
    """Whether a posting is in one of these blocks."""
    by: dict[str, list[int]] = {}
    for term, block in keys:
        by.setdefault(term, []).append(block)
    return reduce(lambda a, b: a | b, [(F.col("term") == t) & F.col("block").isin(sorted(x)) for t, x in by.items()])
