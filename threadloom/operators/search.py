"""BM25 text search, vector search and their fusion."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.archive import Archive
from threadloom.functions import text as T
from threadloom.operators.index import K1, B, Index, words_of

# The fusion's constant and its list length.
RRF, TOP = 60, 50


def _count(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda t: t == F.lit(word)))


def bm25(docs: DataFrame, query: str, id_col: str, *text_cols: str, only: DataFrame | None = None) -> DataFrame:
    """``id_col`` and ``score`` of the rows that have any of the query's words.

    Statistics cover all of ``docs``; ``only`` keeps the rows to be scored. A row's words are counted where it is read:
    the only shuffle is that of one row of statistics a task.
    """
    words = words_of(query)
    body = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    counted = docs.withColumn("_words", T.tokens(body)).select(id_col, F.size("_words").alias("_n"), *[_count("_words", w).alias(f"_f{i}") for i, w in enumerate(words)])
    if not words:
        return counted.select(id_col, F.lit(0.0).alias("score")).limit(0)
    stats = counted.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("len"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(words))]).alias("s"))
    rows = counted if only is None else counted.join(only.select(id_col), id_col, "left_semi")
    told = rows.filter(" + ".join(f"_f{i}" for i in range(len(words))) + " > 0").withColumn("_s", stats.scalar())
    score = F.lit(0.0)
    for i in range(len(words)):
        f, d = F.col(f"_f{i}").cast("double"), F.col(f"_s.d{i}").cast("double")
        idf = F.log((F.col("_s.n") - d + 0.5) / (d + 0.5) + 1)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_s.len")))
    return told.select(id_col, score.alias("score"))


def best_per_conversation(hits: DataFrame, score: str, limit: int) -> DataFrame:
    """The best message of each conversation, best first."""
    own = Window.partitionBy("conversation_id").orderBy(F.col(score).desc(), "message_id")
    return hits.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n").orderBy(F.col(score).desc(), "message_id").limit(limit)


def _indexed(archive: Archive, index: Index, query: str, limit: int, filters: dict) -> DataFrame:
    """Hits that hold the best ``limit`` conversations: top lists of the index, each four times the one before, until they do."""
    base, k = archive.filtered(**filters), 4 * limit
    while True:
        scores = index.top(query, k).persist()
        hits = base.join(scores, "id").withColumnRenamed("id", "message_id")
        if scores.count() < k or hits.select("conversation_id").distinct().limit(limit).count() == limit:
            return hits
        k *= 4


def search(archive: Archive, query: str, limit: int = 20, context: int = 300, index: Index | None = None, **filters) -> DataFrame:
    """Text search: scaffolding and superseded messages take part. With ``index`` the archive's texts aren't read for it."""
    if index is None:
        scores = bm25(archive.messages, query, "id", "content", "thinking").withColumn("score", F.round("score", 6))
        hits = archive.filtered(**filters).join(scores, "id").withColumnRenamed("id", "message_id")
    else:
        hits = _indexed(archive, index, query, limit, filters)
    out = best_per_conversation(hits, "score", limit)
    return out.select("message_id", "role", T.clip(F.col("content"), context).alias("content"), F.when(F.coalesce(F.col("thinking"), F.lit("")) != "", T.clip(F.col("thinking"), context)).alias("thinking"), "created_at", "score", "title", "source", "conversation_id", "cwd")


def ranked(hits: DataFrame, by: str, limit: int = TOP) -> DataFrame:
    """The first ``limit`` rows by ``by``, with their rank ``r``; a top list before the rank, so no sort of all rows in one task."""
    top = hits.orderBy(F.col(by).desc(), "id").limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy(F.col(by).desc(), "id")).alias("r"))


def hybrid(archive: Archive, query: str, vector: list[float], limit: int = 10, index: Index | None = None, **filters) -> DataFrame:
    """Text and vector lists, each of the best 50 of the filtered messages, fused by reciprocal rank; texts by ``index`` where there is one."""
    base = archive.filtered(**filters).filter(T.clean(F.col("content")))
    if index is None:
        texts = bm25(archive.messages, query, "id", "content", "thinking", only=base).withColumn("score", F.round("score", 6))
    else:
        texts = index.scores(query).join(base.select("id"), "id", "left_semi")
    wanted = F.array(*[F.lit(float(x)) for x in vector])
    vectors = archive.messages.filter(F.col("embedding").isNotNull()).join(base.select("id"), "id", "left_semi").select("id", F.round(T.cosine(F.col("embedding"), wanted), 6).alias("score")).filter("score is not null")
    fused = ranked(texts, "score").unionByName(ranked(vectors, "score")).groupBy("id").agg(F.round(F.sum(1.0 / (RRF + F.col("r"))), 9).alias("score"))
    hits = base.join(F.broadcast(fused), "id").withColumnRenamed("id", "message_id")  # at most 100 rows
    return best_per_conversation(hits, "score", limit).select("score", "message_id", "role", "content", "created_at", "title", "source", "conversation_id", "cwd")


def embed_pending(archive: Archive, embed, batch: int = 32) -> DataFrame:
    """``id`` and ``embedding`` of the messages that have text and no vector, by ``embed(list of texts) -> list of vectors``.

    Batches are of like length: rows are sorted by length within each partition.
    """
    pending = archive.messages.filter(F.col("embedding").isNull() & T.has_text(F.col("content")) & T.clean(F.col("content"))).select("id", F.substring("content", 1, 1600).alias("content"))

    def run(frames):
        import pandas as pd

        for x in frames:
            for k in range(0, len(x), batch):
                part = x.iloc[k : k + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": [list(map(float, v)) for v in embed([f"title: none | text: {t}" for t in part["content"]])]})

    return pending.sortWithinPartitions(F.length("content")).mapInPandas(run, "id string, embedding array<float>")


def hash_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, of length 1."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1 if h & 0x10000 else -1
        length = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / length for x in v])
    return out
