"""MinHash near-dedup with sequential Bayesian verification.

A text's set holds its distinct five-word shingles, in ASCII lower case; with fewer words, the whole sequence. Equal
sets are one node. Nodes of which a band of signature values agrees are candidates. A pair's signatures are compared a
batch at a time, and it is dropped as soon as the posterior probability that its similarity reaches the threshold
falls under ``MISS``; survivors are verified on their full sets. With 40 bands of 4 values, a pair at similarity 0.75
shares no band with probability 3e-7.

Buckets never become all pairs. First each member is compared with the bucket's pivot, the node that meets most others,
and links make components. What is left are pairs of one bucket whose components differ, and one later round settles
them all. Buckets of up to ``SMALL`` members compare these pairs directly. In larger ones all shingles of a set are
ordered by how many of the nodes have them, rarest first. Sets of x and y shingles link only where they share 3/7 (x + y)
and 3/4 of the larger, so the first one that they share is among the first x - ceil(3/4 x) + 1 of each, and what follows it
must suffice in both. Members outside of a bucket's largest component meet others by such a shingle and a class of sizes
that its place leaves. The conditions are exact, so no link that decides a component is lost; and edits of one text that
drifted away from each other have shingles of their own, which stand first, and so meet hardly anything.

Sets are of 64-bit hashes of shingles, and the full sets are compared. A signature keeps 16 bits of each least value.

Defined results: null or empty text has an empty set, of size 0, and is linked with nothing. Equal sets are linked.
A row with a null id has no component (null) and is kept. Repeated rows are equal sets. Ties can't occur: a component
is named by its smallest id. Very long texts are one row of their task. An empty table gives an empty result. Extra
columns are carried by ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.workers import blocks
from threadloom.llm.wordhash import Words
from threadloom.runtime import Scratch, share_code

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, BATCH = 40, 4, 16
#: A pair is dropped when it reaches the threshold with less probability than this, given the values compared so far.
MISS = 1e-6

#: Members up to which a bucket's pairs are compared directly.
SMALL = 32
#: Sizes within a factor of e**STEP are one class.
STEP = 0.04

_HASHES = BANDS * ROWS
_MULTIPLIERS = np.random.default_rng(17).integers(1, 1 << 63, _HASHES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes one after the other, and the size of each set."""
    w = Words(texts, lower=True)
    grams = w.windows(SHINGLE)
    sets = []
    for row, n in enumerate(w.counts.tolist()):
        a = int(w.first[row])
        if n >= SHINGLE:
            sets.append(np.unique(grams[a : a + n - SHINGLE + 1]))
        elif n:
            x = hashlib.blake2b(b" ".join(w.text(row)), digest_size=8).digest()
            sets.append(np.frombuffer(x, "<u8"))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def signatures(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each hash over each set; an empty set's row means nothing."""
    out = np.zeros((len(sizes), _HASHES), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k, m in enumerate(_MULTIPLIERS):
            out[full, k] = np.minimum.reduceat(((flat * m) >> np.uint64(32)).astype(np.uint32), starts).astype(np.uint16)
    return out


def least_matches() -> list[tuple[int, int]]:
    """Values compared so far, and the matches that a pair must have to stay: by the posterior under a uniform prior."""
    out, x = [], PERCENT / 100
    for n in range(BATCH, _HASHES + 1, BATCH):
        # the posterior is Beta(m + 1, n - m + 1); its upper tail at x is a binomial sum
        tail, m = 0.0, 0
        while (tail := tail + comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)) < MISS:
            m += 1
        out.append((n, m))
    return out


def features(docs: DataFrame) -> DataFrame:
    """Of (id, text, version): id, version, n_shingles, node (a digest of the set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                flat, sizes = shingle_sets(part.column(1))
                sig = signatures(flat, sizes)
                ends = np.cumsum(sizes)
                node = [hashlib.blake2b(flat[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes), pa.array(node, pa.binary()), pa.array([x.tobytes() if n else None for x, n in zip(sig, node, strict=True)], pa.binary())], ["id", "version", "n_shingles", "node", "signature"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, version long, n_shingles long, node binary, signature binary")


def checked_sets(texts: DataFrame) -> DataFrame:
    """Of (node, text): the sets of those texts that are the node's, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                flat, sizes = shingle_sets(part.column(1))
                ends = np.cumsum(sizes).tolist()
                sets = [flat[e - n : e].tobytes() for e, n in zip(ends, sizes.tolist(), strict=True)]
                right = [k for k, (s, n) in enumerate(zip(sets, part.column(0).to_pylist(), strict=True)) if hashlib.blake2b(s, digest_size=16).digest() == n]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(right, pa.int64())), pa.array([sets[k] for k in right], pa.binary())], ["node", "members"])

    return texts.mapInArrow(run, "node binary, members binary").groupBy("node").agg(F.first("members").alias("members"))


def likely(pairs: DataFrame) -> DataFrame:
    """Of (a, b, their signatures): the pairs that no batch prunes."""
    steps = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, _HASHES) for c in (2, 3))
            live, got = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for n, need in steps:
                got[live] += (x[live, n - BATCH : n] == y[live, n - BATCH : n]).sum(1)
                live = live[got[live] >= need]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(live)) for c in b.columns[:2]], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def linked(pairs: DataFrame) -> DataFrame:
    """Of (a, b, their sets): the pairs whose similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= PERCENT * max(len(p), len(q)) else 0
                if 100 * both >= PERCENT * (len(p) + len(q) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in b.columns[:2]], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, column of a, column of b)."""
    one = table.select(F.col("node").alias("a"), F.col(column).alias("x"))
    two = table.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) of each node of (a, b); a component is named by one of its nodes.

    Each round every region points at its least neighbour. Only two that point at each other make a cycle, which the
    smaller ends; the others are followed to their ends, twice as far each step. So each region merges with another one,
    half of them at most are left, and rounds and steps are logarithmic, of chains too. It ends when no edge is left.
    """
    ends = edges.filter("a <> b")
    live = scratch.keep(ends.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(ends.select(F.col("b").alias("node"), F.col("a").alias("other"))), f"{label}-edges-0")
    names, k = None, 0
    while names is None or not live.isEmpty():
        least = live.groupBy("node").agg(F.min("other").alias("to"))
        back = least.select(F.col("node").alias("to"), F.col("to").alias("back"))
        mutual = (F.col("back") == F.col("node")) & (F.col("node") < F.col("to"))
        up, step = scratch.keep(least.join(back, "to").select("node", F.when(mutual, F.col("node")).otherwise(F.col("to")).alias("to"), F.lit(True).alias("moved")), f"{label}-up-{k}-0"), 0
        while not up.filter("moved").isEmpty():
            on = up.select(F.col("node").alias("to"), F.col("to").alias("on"))
            up, step = scratch.keep(up.join(on, "to").select("node", F.col("on").alias("to"), (F.col("on") != F.col("to")).alias("moved")), f"{label}-up-{k}-{step + 1}"), step + 1
            scratch.drop(f"{label}-up-{k}-{step - 1}")
        root = lambda c, name: up.select(F.col("node").alias(c), F.col("to").alias(name))  # noqa: B023, E731
        named = root("node", "component") if names is None else names.join(root("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        names = scratch.keep(named, f"{label}-{k}")
        left = live.join(root("node", "a"), "node").join(root("other", "b"), "other").filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other")).distinct()
        live, k = scratch.keep(left, f"{label}-edges-{k + 1}"), k + 1
        scratch.drop(f"{label}-edges-{k - 1}")
        scratch.drop(f"{label}-up-{k - 1}-{step}")
        if k > 1:
            scratch.drop(f"{label}-{k - 2}")
    return names


def shingles(sets: DataFrame) -> DataFrame:
    """Of (node, members, ...): (node, size, shingle), a row for each shingle of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = part.column(1).to_pylist()
                sizes = np.array([len(x) // 8 for x in sets], np.int64)
                index = pa.array(np.repeat(np.arange(len(sets)), sizes))
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), pa.array(sizes).take(index), pa.array(np.frombuffer(b"".join(sets), "<i8"))], ["node", "size", "shingle"])

    return sets.select("node", "members").mapInArrow(run, "node binary, size long, shingle long")


def later_pairs(told: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): of (bucket, node, component), the pairs of one bucket that may link and whose components differ."""
    parts = told.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    # most buckets hold one component; the others' largest is the main one
    mixed = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members")).filter("parts > 1")
    open_ = scratch.keep(told.join(mixed.select("bucket", "main", "members"), "bucket"), "open")
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    few = open_.filter(F.col("members") <= SMALL).select("bucket", "node", "component")
    direct = few.join(few.select("bucket", F.col("node").alias("other"), F.col("component").alias("c")), "bucket").filter("node < other and component <> c").select(*pair("node", "other"))
    many = open_.filter(F.col("members") > SMALL)
    crowd = many.groupBy("node").agg(F.first("component").alias("component"), F.max((F.col("component") != F.col("main")).cast("int")).alias("outside"))
    rows = scratch.keep(shingles(sets.join(crowd.select("node"), "node", "left_semi")), "crowd")
    # shingles of one node only come first of all, and are no rows of these
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    of_node = rows.join(often, "shingle").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    own = F.col("size") - F.size("s")
    prefix = F.greatest(F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1 - own, F.lit(0)).cast("int")
    placed = of_node.select("node", "size", own.alias("own"), F.posexplode(F.slice("s", 1, prefix)).alias("pos", "x"))
    # what a pair can share that meets here first
    by = scratch.keep(placed.join(crowd, "node").select("node", "component", "outside", "size", F.col("x.shingle").alias("shingle"), (F.col("size") - F.col("own") - F.col("pos")).alias("rest")), "told")
    least, most = F.col("size") * PERCENT / 100, F.least(F.col("size") * 100 / PERCENT, F.col("rest") * (100 + PERCENT) / PERCENT - F.col("size"))
    of_size = lambda x: F.floor(F.log(x) / STEP).cast("int")
    ours = by.filter("outside = 1").filter(most >= least).select("shingle", "node", "component", "size", "rest", F.explode(F.sequence(of_size(least) - 1, of_size(most) + 1)).alias("class"))
    theirs = by.select("shingle", of_size(F.col("size")).alias("class"), F.col("node").alias("other"), F.col("component").alias("c"), F.col("size").alias("z"), F.col("rest").alias("r"))
    x, y = F.col("size"), F.col("z")
    may = (F.col("component") != F.col("c")) & (F.lit(PERCENT) * (x + y) <= F.lit(100 + PERCENT) * F.least("rest", "r")) & (F.lit(100) * F.least(x, y) >= F.lit(PERCENT) * F.greatest(x, y))
    met = ours.join(theirs, ["shingle", "class"]).filter(may).select(*pair("node", "other"))
    return direct.unionByName(met).distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: bool = False) -> DataFrame:
    """Id, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``df``; ``version`` where asked for, which tells rows of one id apart."""
    spark = df.sparkSession
    share_code(spark)
    scratch = Scratch(spark, "near-copies")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    known = scratch.keep(features(docs), "features")
    full = known.filter(F.col("node").isNotNull() & F.col("id").isNotNull())
    # one row a node: equal sets have equal signatures
    nodes = scratch.keep(full.groupBy("node").agg(F.min("id").alias("id"), F.first("signature").alias("signature")), "nodes")
    width = 2 * ROWS
    bands = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("signature", k * width + 1, F.lit(width))))).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = scratch.keep(bands.join(shared, "bucket"), "met")
    # the pivot of a bucket is its node that meets most others in all buckets: of copies of one text mostly that text
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    pivots = met.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("p")).select("bucket", F.col("p.node").alias("pivot"))
    members = met.select("bucket", "node")
    first = members.join(pivots, "bucket").filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    # a node's set comes from one row of its smallest id; other rows of that id make other nodes
    own = nodes.join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.join(own.select("id", "node").hint("shuffle_hash"), "id").select("node", "text")
    # from here on only nodes that meet another one are read
    sets = scratch.keep(checked_sets(texts).join(own.select("node", "signature"), "node"), "sets")
    links = scratch.keep(linked(with_both(likely(with_both(first, sets, "signature")), sets, "members")), "links-0")
    names = components(links, scratch, "names-0")
    told = members.join(names, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    pairs = scratch.keep(later_pairs(told, sets, scratch), "pairs")
    for done in ("met", "open", "crowd", "told"):
        scratch.drop(done)
    fresh = scratch.keep(linked(with_both(likely(with_both(pairs, sets, "signature")), sets, "members")), "links-1")
    scratch.drop("sets")
    if not fresh.isEmpty():
        names = components(names.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh), scratch, "names-1")
    named = nodes.select("id", "node").join(names, "node", "left").select("id", "node", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    node_names = named.select("node", "component").join(least, "component").select("node", "component_id")
    out = known.select("id", "version", "n_shingles", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")).join(node_names, "node", "left")
    found = out.select("id", "version", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), *[F.col("version")] * version)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each component: the one with the smallest id."""
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    key = [F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text")]
    told = near_copies(docs.select(*key), "id", "text", True).filter(~F.col("kept")).select("id", "version").distinct()
    left = docs.select("row", key[0], F.xxhash64(key[1]).alias("version")).join(told.hint("shuffle_hash"), ["id", "version"], "left_anti")
    return left.select("row.*")


def op3_bayes_lsh(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of ``documents``."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i+4], ' ')) ELSE [array_to_string(words, ' ')] END) AS sh FROM w WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), r AS (
  WITH RECURSIVE c(doc_id, root) AS (
    SELECT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id
  ) SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, w.doc_id) AS component_id, coalesce(r.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id
"""
