"""The archive as a view of the driver's tables, in Spark and, for checks, in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.archive import Archive
from threadloom.runtime import table


def _hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def _message_id(conv: Column, turn: Column) -> Column:
    return _hash(F.lit("msg:"), conv.cast("string"), F.lit(":"), turn.cast("string"))


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    """Conversations and messages from ``conversations``, vectors from ``embeddings``, the rest from ``events``."""
    turns, vectors, events = (table(spark, sf_dir, t) for t in ("conversations", "embeddings", "events"))
    conv, turn = F.col("conv_id"), F.col("turn").cast("long")
    moment = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")
    source = F.element_at(F.array(*map(F.lit, ("chatgpt", "claude", "claude-code", "codex"))), (conv % 4 + 1).cast("int"))
    cwd = F.when(conv % 4 >= 2, F.concat(F.lit("/repo/p"), (conv % 5).cast("string")))
    conversation_id = _hash(F.lit("conv:"), conv.cast("string"))
    stamped = turns.withColumn("at", moment)
    conversations = stamped.groupBy("conv_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at")).select(
        conversation_id.alias("id"), source.alias("source"), F.concat(F.lit("Conversation "), conv.cast("string")).alias("title"), "created_at", "updated_at",
        F.lit(None).cast("string").alias("model"), cwd.alias("cwd"), F.lit(None).cast("string").alias("git_branch"), F.lit(None).cast("string").alias("project_id"), F.lit("{}").alias("metadata"))
    messages = stamped.join(vectors.select("vec_id", "embedding"), conv * 8 + turn == F.col("vec_id"), "left").select(
        _message_id(conv, turn).alias("id"), conversation_id.alias("conversation_id"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("thinking"), F.col("at").alias("created_at"),
        F.lit(None).cast("string").alias("model"), F.when((conv + turn) % 17 == 0, F.lit('{"history_of":"x"}')).otherwise("{}").alias("metadata"), "embedding", F.when(turn > 0, _message_id(conv, turn - 1)).alias("parent_id"))
    event, of_conv, of_turn = F.col("event_id"), F.col("event_id") % 100, F.floor(F.col("event_id") / 100) % 6
    own = _message_id(of_conv, of_turn)
    tool_calls = events.select(_hash(F.lit("tool:"), event.cast("string")).alias("id"), own.alias("message_id"), F.col("event_type").alias("tool_name"), F.col("props").alias("input"), F.lit("{}").alias("output"), F.when(event % 7 == 0, "failed").otherwise("complete").alias("status"), F.floor("value").cast("int").alias("duration_ms"), F.col("ts").alias("created_at"))
    path = F.concat(F.lit("/repo/p"), (of_conv % 5).cast("string"), F.lit("/f"), (F.col("user_id") % 20).cast("string"), F.lit(".py"))
    kind = F.element_at(F.array(*map(F.lit, ("write", "edit", "shell"))), (event % 3 + 1).cast("int"))
    file_edits = events.filter(F.col("event_type").isin("click", "purchase")).select(_hash(F.lit("edit:"), event.cast("string")).alias("id"), own.alias("message_id"), path.alias("file_path"), kind.alias("edit_type"), F.col("props").alias("content"), F.col("ts").alias("created_at"), F.when(event % 3 == 1, F.substring("props", 1, 5)).alias("old_content"))
    attachments = events.filter(event % 10 == 0).select(_hash(F.lit("attach:"), event.cast("string")).alias("id"), own.alias("message_id"), F.concat(F.lit("f"), event.cast("string"), F.lit(".png")).alias("filename"), F.lit("image/png").alias("mime_type"), F.col("user_id").cast("int").alias("size"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("url"), F.col("ts").alias("created_at"))
    return Archive(spark, conversations=conversations, messages=messages, tool_calls=tool_calls, file_edits=file_edits, attachments=attachments)


#: The same view as DuckDB common table expressions; queries' SQL follows after a comma.
SQL = """
WITH st AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS tm FROM conversations),
c AS (SELECT substr(sha256('conv:' || conv_id), 1, 16) AS id, CASE conv_id % 4 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' WHEN 2 THEN 'claude-code' ELSE 'codex' END AS source, 'Conversation ' || conv_id AS title, min(tm) AS created_at, max(tm) AS updated_at,
      CASE WHEN conv_id % 4 >= 2 THEN '/repo/p' || (conv_id % 5) END AS cwd FROM st GROUP BY conv_id),
m AS (SELECT substr(sha256('msg:' || conv_id || ':' || turn), 1, 16) AS id, substr(sha256('conv:' || conv_id), 1, 16) AS conversation_id, role, text AS content, CAST(NULL AS VARCHAR) AS thinking, tm AS created_at,
      CASE WHEN (conv_id + turn) % 17 = 0 THEN '{"history_of":"x"}' ELSE '{}' END AS metadata, embedding, CASE WHEN turn > 0 THEN substr(sha256('msg:' || conv_id || ':' || (turn - 1)), 1, 16) END AS parent_id
      FROM st LEFT JOIN embeddings ON conv_id * 8 + turn = vec_id),
ev AS (SELECT *, substr(sha256('msg:' || (event_id % 100) || ':' || ((event_id // 100) % 6)), 1, 16) AS mid FROM events),
tc AS (SELECT substr(sha256('tool:' || event_id), 1, 16) AS id, mid AS message_id, event_type AS tool_name, props AS input, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'complete' END AS status, CAST(floor(value) AS INTEGER) AS duration_ms, ts AS created_at FROM ev),
fe AS (SELECT substr(sha256('edit:' || event_id), 1, 16) AS id, mid AS message_id, '/repo/p' || (event_id % 100 % 5) || '/f' || (user_id % 20) || '.py' AS file_path, CASE event_id % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'edit' ELSE 'shell' END AS edit_type, props AS content, ts AS created_at,
       CASE WHEN event_id % 3 = 1 THEN substr(props, 1, 5) END AS old_content FROM ev WHERE event_type IN ('click', 'purchase')),
att AS (SELECT substr(sha256('attach:' || event_id), 1, 16) AS id, mid AS message_id, 'f' || event_id || '.png' AS filename FROM ev WHERE event_id % 10 = 0)
"""
