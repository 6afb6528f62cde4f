"""Queries of exports read by their elements, fetched listings, claims and event chains, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.plans.catalog import _query
from threadloom.runtime import Scratch, share_code, table
from threadloom.sources import paged, providers, table_transport
from threadloom.streaming import chain, claims


@_query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, props AS detail FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)", archive=False)
def fetched_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a paged service, recorded from ``events``, tells since the frontier of six hours before its last update."""
    share_code(spark)
    spark.dataSource.register(paged.PagedConversations)
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    items = e.select(F.col("event_id").cast("string").alias("id"), F.col("at").alias("update_time"), F.col("event_type").alias("title"), F.to_json(F.struct("props")).alias("detail"))
    replies = Scratch(spark, "replies")
    table_transport.record(table_transport.replies(items), f"{replies.path}/service")
    last = e.agg(F.max("at")).first()[0]
    options = {"transport": "threadloom.sources.table_transport:make", "replies": f"{replies.path}/service", "parallel": "8"}
    if last is not None:
        options["since"] = paged.moment(last - 6 * 3600).isoformat()
    got = spark.read.format("paged_conversations").options(**options).load()
    return got.select("id", "title", F.get_json_object("body", "$.props").alias("detail"))


_CHAIN = """WITH n AS (SELECT event_id, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events),
e AS (SELECT u, s, CAST(event_id AS VARCHAR) AS event, sha256('o' || event_id) AS o, s % 10 = 4 AS bad FROM n WHERE s % 10 <> 8),
j AS (SELECT e.*, b.o AS bo, a.o AS ao, coalesce(a.bad, false) AS abad, NOT e.bad OR b.o IS NULL OR b.o > e.o AS ok1 FROM e LEFT JOIN e b ON b.u = e.u AND b.s = e.s - 1 LEFT JOIN e a ON a.u = e.u AND a.s = e.s + 1),
r AS (SELECT *, ok1 AND NOT (abad AND ao < o) AS ok FROM j),
-- a predecessor that came first was accepted unless it is an event with wrong parents whose own predecessor came before it
x AS (SELECT r.*, coalesce(b.ok, false) AND b.o < r.o AS has_before, coalesce(a.ok, false) AND a.o < r.o AS has_after FROM r LEFT JOIN r b ON b.u = r.u AND b.s = r.s - 1 LEFT JOIN r a ON a.u = r.u AND a.s = r.s + 1),
w AS (SELECT 'u' || u AS author, s AS seq, event, CASE WHEN ok THEN 'accepted' ELSE 'broken' END AS status, ok AND s > 1 AND NOT has_before AS gap, CASE WHEN ok AND has_after THEN s + 1 END AS fills FROM x
  UNION ALL SELECT 'u' || u, s, 'x' || event, 'replay', false, NULL FROM e WHERE s % 10 = 1
  UNION ALL SELECT 'u' || u, s, event, 'repeated', false, NULL FROM e WHERE s % 10 = 6)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in shuffled order: some missing, some with wrong parents, some twice, some numbers with two events."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id").withColumn("seq", F.row_number().over(own)).withColumn("up", F.lag("event_id").over(own).cast("string"))
    e = e.filter("seq % 10 <> 8").select(
        F.lit("w").alias("workspace"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), "seq", F.col("event_id").cast("string").alias("event"),
        F.when(F.col("seq") % 10 == 4, F.array(F.lit("elsewhere"))).when(F.col("seq") > 1, F.array("up")).otherwise(F.array().cast("array<string>")).alias("parents"),
        F.sha2(F.concat(F.lit("o"), F.col("event_id").cast("string")), 256).alias("arrived"),
    )
    late = F.concat(F.lit("z"), "arrived")
    other = e.filter("seq % 10 = 1").withColumn("event", F.concat(F.lit("x"), "event")).withColumn("arrived", late)
    return chain.verified(e.unionByName(other).unionByName(e.filter("seq % 10 = 6").withColumn("arrived", late)))


@_query(_CHAIN + "SELECT * FROM w", archive=False)
def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).drop("workspace")


@_query(_CHAIN + """, g AS (SELECT author, seq FROM w WHERE gap AND NOT EXISTS (SELECT 1 FROM w f WHERE f.author = w.author AND f.fills = w.seq)),
h AS (SELECT 'u' || u AS author, max(s) AS seq, arg_max(event_id, s) AS event FROM n GROUP BY u)
SELECT author, seq, 'gap' AS fault FROM g UNION ALL SELECT author, seq, 'boundary' FROM h WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.author = h.author AND w.seq = h.seq AND status = 'accepted')""", archive=False)
def event_history_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = Scratch(spark, "event-chain").keep(_log(spark, sf_dir), "log")
    last = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).groupBy("user_id").agg(F.max("seq").alias("seq"), F.max_by("event_id", "seq").cast("string").alias("event"))
    heads = last.select(F.lit("w").alias("workspace"), F.lit(1).alias("epoch"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), "seq", "event")
    return chain.history_faults(log, heads, 1).drop("workspace")


@_query("""WITH f AS (SELECT user_id AS u, max(event_id) AS t, 1 + max(event_id) % 7 AS z FROM events GROUP BY user_id)
  SELECT '/s/' || u || '.jsonl' AS path, t AS mtime, z AS size, 1 AS attempt, 'claim' AS action FROM f
  UNION ALL SELECT '/s/' || u || '.jsonl', t, z, 1, 'done' FROM f WHERE u % 3 = 0
  UNION ALL SELECT '/s/' || u || '.jsonl', t + 1, z + 1, 2, 'again' FROM f WHERE u % 3 = 1""", archive=False)
def inbox_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hooks named: every one is claimed once, a third is done, a third changed while it was parsed, a third has no outcome yet."""
    e = table(spark, sf_dir, "events").select(F.lit("codex").alias("source"), F.concat(F.lit("/s/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("path"), "user_id", F.col("event_id").alias("mtime"), (F.col("event_id") % 7 + 1).alias("size"))
    records = e.select("source", "path", "mtime", "size", F.lit(None).cast("long").alias("parsed_mtime"), F.lit(None).cast("long").alias("parsed_size"))
    newest = e.groupBy("source", "path", "user_id").agg(F.max("mtime").alias("t"), F.max_by("size", "mtime").alias("z")).filter("user_id % 3 < 2")
    moved = F.col("user_id") % 3
    outcomes = newest.select("source", "path", (F.col("t") + moved).alias("mtime"), (F.col("z") + moved).alias("size"), F.col("t").alias("parsed_mtime"), F.col("z").alias("parsed_size"))
    return claims.claims(records.unionByName(outcomes)).select("path", "mtime", "size", "attempt", "action")


@_query("""SELECT substr(sha256('claude:' || substr(sha256('claude:' || conv_id), 1, 16) || ':' || turn), 1, 16) AS id, substr(sha256('claude:' || conv_id), 1, 16) AS conversation_id, role, text AS content, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) AS created_at
  FROM conversations WHERE coalesce(text, '') <> ''""", archive=False)
def exported_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of export files, of a list of conversations each, that were written from ``conversations``."""
    share_code(spark)
    at = F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), 0, 0)"), "yyyy-MM-dd'T'HH:mm:ss")
    turn = F.struct("turn", F.col("turn").cast("string").alias("uuid"), F.col("role").alias("sender"), "text", at.alias("created_at"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("chat_messages"))
    lines = c.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("uuid"), "chat_messages")).alias("value"))

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's lines as one list."""
        mark = "["
        for x in frames:
            if len(x):
                yield pd.DataFrame({"value": [m + v for m, v in zip([mark] + [","] * (len(x) - 1), x["value"], strict=True)]})
                mark = ","
        yield pd.DataFrame({"value": ["]" if mark == "," else "[]"]})

    path = f"{Scratch(spark, 'exports').path}/files"
    lines.repartition(8).mapInPandas(listed, "value string").write.text(path)
    return providers.parse_exports(spark, path, "claude", "*.txt")["messages"].select("id", "conversation_id", "role", "content", "created_at")
