"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words. Each window has an anchor, the least hash of the ``SEED``-word phrases in it,
so equal windows have equal anchors and neighbouring windows mostly share one. Anchors that two texts have name the
places where a passage may recur; runs of windows of one such anchor are the stretches of a document that are streamed.

Passages are confirmed first, once: distinct stretches' windows are counted by 128-bit hashes, and those of two documents
make the passage table, with their words and the least id that has them. It is dealt to shards by anchor. Each shard
compiles an Aho-Corasick automaton of its passages' windows, as sequences of overlapping phrases, and streams the stretches
of all documents that have one of its anchors through it, place by place; places come from the automaton alone. A shard of many stretches is dealt to
several tasks, each with the shard's passages. Words covered by a window whose sequence also starts in a document with a
smaller id are then removed.

Stretches are streamed once for each distinct text, with the least and the largest id that has it, so a passage that a
third of all documents share is one row; what the automaton found in it is joined back to the documents by key. Anchors
of very many documents are found in a sample of ``SAMPLE`` documents; as they recur in it they are known to recur, so they
need no comparison, and their rows are dealt out by document.

Of equal texts only the one with the smallest id takes part; the others' windows all start in it.

Defined results: null or empty text has no words. A row with a null id has no smaller or larger one, so it loses
nothing and takes nothing. Rows that repeat an id count as one document, so none makes another lose words. Windows are
judged on the input. An empty table gives an empty result. Extra columns are carried by ``cut_repeats``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from threadloom.llm.wordhash import Words, lowest
from threadloom.llm.workers import blocks, parts
from threadloom.runtime import Scratch, share_code

WINDOW, SEED = 13, 4
#: Words of a letter that automata read: each place of a text begins one, and two make a window.
PHRASE = 10
#: Documents whose anchors tell the hot ones, and in how many of these an anchor is hot.
SAMPLE, HOT = 20_000, 16
#: Anchors that are taken as hot, at most: those in most documents of the sample.
HOT_ANCHORS = 65_536
#: Windows of a shard's passages on average, and stretches that one task streams.
PASSAGES, STRETCHES = 50_000, 8_000

_WORD = re.compile("[^\x20\x09-\x0d]+")


def window_anchors(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and which windows lie within one text."""
    grams = words.windows(seed)
    anchor = lowest(grams, window - seed + 1)
    return anchor.astype(np.int64), words.whole(window)


def anchors(df: DataFrame, window: int, seed: int) -> DataFrame:
    """Rows (anchor, id): each change of anchor along each text of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = Words(part.column(1))
                a, whole = window_anchors(w, window, seed)
                owner = w.owner[: len(a)]
                new = whole.copy()
                new[1:] &= (a[1:] != a[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(a[at]), part.column(0).take(pa.array(owner[at]))], ["anchor", "id"])

    return df.select("id", "text").mapInArrow(run, f"anchor long, id {df.schema['id'].dataType.simpleString()}")


def recurring(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Rows (version, anchors): of each text, the anchors that another text has too."""
    n = docs.count()
    texts = docs.select(F.col("version").alias("id"), "text")
    sample = texts.filter(F.pmod(F.xxhash64("id", F.lit("hot")), F.lit(1 << 62)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 62)))
    counts = anchors(sample, window, seed).distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT)
    # at most HOT_ANCHORS rows of 8 bytes; any other anchor is compared by a window, however many documents have it
    hot = counts.orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS).select("anchor", F.lit(True).alias("hot"))
    rows = anchors(texts, window, seed).withColumnRenamed("id", "version").join(F.broadcast(hot), "anchor", "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("version"), F.lit(1 << 16))).otherwise(F.lit(-1)))
    same = Window.partitionBy("anchor", "salt")
    met = rows.withColumn("least", F.min("version").over(same)).withColumn("most", F.max("version").over(same)).filter(F.col("hot") | (F.col("least") < F.col("most")))
    return met.groupBy("version").agg(F.collect_set("anchor").alias("anchors"))


def segments(docs: DataFrame, lists: DataFrame, window: int, seed: int) -> DataFrame:
    """Of (id, version, text): the runs of windows of one recurring anchor, with their words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                w = Words(part.column(2))
                a, _ = window_anchors(w, window, seed)
                rows, anchor, start, body = [], [], [], []
                for row in range(part.num_rows):
                    first, n = int(w.first[row]), int(w.counts[row])
                    if n < window:
                        continue
                    own = a[first : first + n - window + 1]
                    at = np.flatnonzero(np.isin(own, part.column(3)[row].values.to_numpy()))
                    if not len(at):
                        continue
                    words = w.text(row)
                    edges = np.flatnonzero((np.diff(at) > 1) | (own[at[1:]] != own[at[:-1]]))
                    begin, end = at[np.concatenate([[0], edges + 1])], at[np.concatenate([edges, [len(at) - 1]])] + window
                    rows += [row] * len(begin)
                    anchor.append(own[begin])
                    start.append(begin)
                    body += [b" ".join(words[i:j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                if rows:
                    index = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(np.concatenate(anchor)), pa.array(np.concatenate(start).astype(np.int32)), pa.array(body, pa.binary())], ["id", "version", "anchor", "start", "body"])

    joined = docs.join(lists.hint("shuffle_hash"), "id").select("id", "version", "text", "anchors")
    return joined.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, version long, anchor long, start int, body binary")


def window_hashes(stretches: DataFrame, window: int, id_type: str) -> DataFrame:
    """Of (anchor, key, body, least, most): a row for each window, with two hashes of its words and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2):
            w = Words(part.column(2).cast(pa.string()))
            at = np.flatnonzero(w.whole(window))
            row = w.owner[at]
            index = pa.array(row)
            hashes = [pa.array(h[at].view(np.int64)) for h in (w.windows(window), w.windows(window, 1))]
            yield pa.RecordBatch.from_arrays([*hashes, *(part.column(c).take(index) for c in (0, 1, 3, 4)), pa.array((at - w.first[row]).astype(np.int32))], ["h1", "h2", "anchor", "key", "least", "most", "at"])

    return stretches.select("anchor", "key", "body", "least", "most").mapInArrow(run, f"h1 long, h2 long, anchor long, key long, least {id_type}, most {id_type}, at int")


def confirmed(stretches: DataFrame, window: int, id_type: str) -> DataFrame:
    """(anchor, key, ats, firsts): the windows that two documents have, each where it stands in one stretch, with the least id that has it."""
    rows = window_hashes(stretches, window, id_type)
    counted = rows.groupBy("h1", "h2").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min(F.struct("anchor", "key", "at")).alias("one")).filter("least < most")
    # an array for each stretch, so no longer than its text
    return counted.groupBy(F.col("one.anchor").alias("anchor"), F.col("one.key").alias("key")).agg(F.collect_list("one.at").alias("ats"), F.collect_list("least").alias("firsts"))


def spelled(codes: np.ndarray, digits: int) -> str:
    """Each number as ``digits`` characters, of another 128 at each place, so that no node of a trie has more children; 0 is no letter of a passage."""
    out = np.zeros((len(codes), digits), np.uint32)
    for k in range(digits):
        out[:, k] = np.where(codes > 0, ((codes >> (7 * (digits - 1 - k))) & 127) + 1 + 128 * k, 0)
    return out.tobytes().decode("utf-32-le")


def locate(window: int, id_type: pa.DataType):
    """The work of one task: compile the passages, stream the stretches, and say where passages of smaller ids stand."""

    def run(table: pa.Table) -> pa.Table:
        names, shape = ["anchor", "key", "at", "first"], [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(id_type)]
        table = table.combine_chunks()
        column = lambda c: table.column(c).combine_chunks() if table.num_rows else None
        is_passage = table.column("ats").is_valid().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        if not is_passage.any():
            return pa.table([pa.array([], t) for t in shape], names)
        body, most = column("body").cast(pa.string()), column("most").to_numpy(zero_copy_only=False)
        w = Words(body)
        own = np.flatnonzero(is_passage)
        # a letter is a phrase of more than half a window, told by its hash; phrases of no passage, and what goes over an end, are 0
        size = max(-(-window // 2), min(PHRASE, window))
        step, letters = max(1, window - size), 1 + (window > size)
        phrases, inside = w.windows(size), w.whole(size)
        kinds = np.unique(phrases[inside & is_passage[w.owner[: len(phrases)]]])
        at = np.minimum(np.searchsorted(kinds, phrases), max(0, len(kinds) - 1))
        codes = np.zeros(len(w.hash), np.int64)
        codes[: len(phrases)] = np.where(inside & (kinds[at] == phrases), at + 1, 0)
        # every step-th place of a text follows the one before it, so that a window is two letters; a text's last places are 0
        within = np.arange(len(codes)) - w.first[w.owner]
        order = np.lexsort((within, within % step, w.owner))
        digits = max(1, -(-len(kinds).bit_length() // 7))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        text = spelled(codes[order], digits)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        ats, lists = column("ats").take(pa.array(own)), column("firsts").take(pa.array(own))
        begin = np.repeat(w.first[own], pc.list_value_length(ats).to_numpy(zero_copy_only=False)) + ats.flatten().to_numpy()
        firsts = lists.flatten().to_numpy(zero_copy_only=False)
        for n, a in enumerate((place[begin] * digits).tolist()):
            automaton.add_word(text[a : a + letters * digits], n)
        automaton.make_automaton()
        order = order[~is_passage[w.owner[order]]]
        hits = np.fromiter(chain.from_iterable(automaton.iter(spelled(codes[order], digits))), np.int64).reshape(-1, 2)
        at = order[hits[:, 0] // digits - letters + 1]
        by = np.argsort(at, kind="stable")
        at, first = at[by], firsts[hits[by, 1]]
        row = w.owner[at].astype(np.int64)
        at = at - w.first[row]
        earlier = np.flatnonzero(first < most[row]) if len(row) else np.zeros(0, np.int64)
        row, at, first = row[earlier], at[earlier], first[earlier]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        offsets, index = pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(row[start])
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(at.astype(np.int32)), pa.array(first, id_type))]
        return pa.table([column("anchor").take(index), column("key").take(index), *lists], names)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Of (id, version, text): (id, version, places, whole): where windows start that a document with a smaller id has too; ``whole`` for all of them."""
    spark = docs.sparkSession
    share_code(spark)
    scratch = Scratch(spark, "repeats")
    id_type = docs.schema["id"].dataType.simpleString()
    known = docs.filter(F.col("id").isNotNull())
    # equal texts are told by 128 bits; the one with the smallest id stands for all, the others lose every window
    digest = ["version", "size", "check"]
    slim = known.select("id", "version", F.octet_length("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("check")).filter("version is not null")
    firsts = slim.groupBy(*digest).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copies = slim.join(firsts.filter("first < last"), digest).filter(F.col("id") > F.col("first")).select("id", "version").distinct()
    lists = recurring(known, window, seed).join(firsts.select("version", "first"), "version").select(F.col("first").alias("id"), "anchors")
    found = scratch.keep(segments(known, lists.groupBy("id").agg(F.flatten(F.collect_list("anchors")).alias("anchors")), window, seed), "segments")
    keyed = found.withColumn("key", F.xxhash64("body"))
    # one row for each distinct stretch: copies are counted before they are dealt out
    stretches = scratch.keep(keyed.groupBy("anchor", "key", "body").agg(F.min("id").alias("least"), F.max("id").alias("most")), "stretches")
    kept = scratch.keep(confirmed(stretches, window, id_type), "confirmed")
    parts_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # twice as many shards as full tasks, so that few shards are in several tasks and compiled in each
    shards = max(4 * parts_, (kept.agg(F.sum(F.size("ats"))).first()[0] or 0) // PASSAGES, 2 * stretches.count() // STRETCHES)
    shard = F.pmod("anchor", F.lit(shards)).alias("shard")
    passages = kept.join(stretches.select("anchor", "key", "body"), ["anchor", "key"]).select(shard, "anchor", "key", "body", "ats", "firsts")
    read = stretches.select(shard, "anchor", "key", "body", "most")
    tasks = read.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / STRETCHES).cast("int").alias("tasks")).filter("tasks > 1")
    # a row a crowded shard
    dealt = read.join(tasks, "shard", "left").withColumn("task", F.when(F.col("tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64("key", "body"), F.col("tasks"))).cast("int"))
    copied = passages.join(tasks, "shard", "left").withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = copied.select("shard", "task", "anchor", "key", "body", none("most", id_type), "ats", "firsts").unionByName(dealt.select("shard", "task", "anchor", "key", "body", "most", none("ats", "array<int>"), none("firsts", f"array<{id_type}>")))
    located = both.groupBy("shard", "task").applyInArrow(locate(window, to_arrow_type(docs.schema["id"].dataType)), f"anchor long, key long, at array<int>, first array<{id_type}>")
    own = keyed.select(F.col("anchor").alias("a"), F.col("key").alias("k"), "id", "version", "start")
    hits = own.join(located, (F.col("a") == F.col("anchor")) & (F.col("k") == F.col("key")))
    earlier = F.filter(F.arrays_zip("at", "first"), lambda x: x["first"] < F.col("id"))
    places = hits.select("id", "version", F.transform(earlier, lambda x: x["at"] + F.col("start")).alias("places")).filter(F.size("places") > 0)
    own = places.groupBy("id", "version").agg(F.flatten(F.collect_list("places")).alias("places")).withColumn("whole", F.lit(False))
    whole = copies.select("id", "version", F.array().cast("array<int>").alias("places"), F.lit(True).alias("whole"))
    out = scratch.keep(own.unionByName(whole).groupBy("id", "version").agg(F.flatten(F.collect_list("places")).alias("places"), F.max("whole").alias("whole")), "places")
    for done in ("segments", "stretches", "confirmed"):
        scratch.drop(done)
    return out


def covered(n_words: int, places: np.ndarray, whole: bool, window: int) -> np.ndarray:
    """Which words a repeated window covers."""
    if whole:
        return np.full(n_words, n_words >= window)
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, places, 1)
    np.add.at(change, places + window, -1)
    return np.cumsum(change[:-1]) > 0


def versions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text); the version tells rows of one id apart."""
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))


def summary(df: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_words``, ``n_removed`` and ``kept_sha256`` of each row."""
    docs = versions(df, id_col, text_col)
    found = repeats(docs, window, seed)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            n, gone, sha = [], [], []
            for text, places, whole in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n.append(len(words))
                if places.is_valid:
                    cut = covered(len(words), places.values.to_numpy(), whole, window)
                    words = [x for x, c in zip(words, cut.tolist(), strict=True) if not c]
                gone.append(n[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    joined = docs.join(found.hint("shuffle_hash"), ["id", "version"], "left").select("id", "text", "places", "whole")
    return joined.mapInArrow(run, f"id {id_type}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def cut_repeats(df: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated words cut from its texts and ``removed``, their number; what stands between kept words stays as it was, and a row that loses nothing keeps its text unchanged."""
    found = repeats(versions(df, id_col, text_col), window, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(row.alias("row")).select("row", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"))
    joined = rows.withColumn("version", F.xxhash64("text")).join(found.hint("shuffle_hash"), ["id", "version"], "left")
    column, shape = df.columns.index(text_col), StructType([*df.schema.fields, StructField("removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            texts, gone = [], []
            for t, p, w in zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), strict=True):
                text, n = cut_text(t, p.values.to_numpy(), w, window) if p.is_valid and t is not None else (t, 0)
                texts.append(text)
                gone.append(n)
            own = part.column(0).flatten()
            own[column] = pa.array(texts, own[column].type)
            yield pa.RecordBatch.from_arrays([*own, pa.array(gone, pa.int64())], shape.names)

    return joined.select("row", "text", "places", "whole").mapInArrow(run, shape)


def cut_text(text: str, places: np.ndarray, whole: bool, window: int) -> tuple[str, int]:
    """A text without the words that repeated windows cover, and their number; white space goes with the word before it."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out = covered(len(spans), np.asarray(places, np.int64), bool(whole), window)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
    at, kept = 0, []
    for a, b in edges.reshape(-1, 2).tolist():
        kept.append(text[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(text)
    return "".join([*kept, text[at:]]), int(out.sum())


def op1_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    """Substring dedup of ``documents``."""
    return summary(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS win FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w WHERE len(words) >= 13)
), f AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first_doc FROM p
), r AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM f, (SELECT unnest(generate_series(0, 12)) AS k) WHERE first_doc < doc_id
), x AS (
  SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS pos FROM w)
), k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.pos) FILTER (WHERE r.pos IS NULL) AS kept, count(r.pos) AS gone
  FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.pos = r.pos GROUP BY x.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
