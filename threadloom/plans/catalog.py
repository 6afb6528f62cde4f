"""Every registered query of the archive engine, and its SQL where DuckDB can say the same."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom import sql as gate
from threadloom.archive import Archive
from threadloom.functions import text as T
from threadloom.operators import changes, evaluate, explore, memory, reading, redact, replicate, search, upsert
from threadloom.runtime import Scratch, table
from threadloom.sources import driver_tables
from threadloom.streaming import inbox

QUERIES: dict = {}
ORACLES: dict = {}

WORDS = "hand the thing"
NOW = datetime(2024, 1, 10)
#: Turns of a conversation that are made in one row.
BLOCK = 4096
VECTOR = [((i % 7) - 3) / 3 for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in VECTOR) + "]"
_COS = "(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def _query(sql: str | None = None, archive: bool = True, recursive: bool = False):
    """Registers a query of (archive) or (spark, sf_dir); the SQL may use the archive's views c, m, tc, fe, at, and, if recursive, begins with its own."""

    def wrap(fn):
        if archive:
            QUERIES[fn.__name__] = lambda spark, sf_dir: fn(driver_tables.archive(spark, sf_dir))
        else:
            QUERIES[fn.__name__] = fn
        if sql and recursive:
            ORACLES[fn.__name__] = driver_tables.SQL.rstrip().replace("WITH", "WITH RECURSIVE", 1) + ",\n" + sql
        elif sql:
            ORACLES[fn.__name__] = driver_tables.SQL.rstrip() + ("" if sql.lstrip().startswith(",") else "\n") + sql if archive else sql
        return fn

    return wrap


# -- text and vector retrieval -----------------------------------------------------------------------------------------

_SCORES = """,
tok AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(content, '') || ' ' || coalesce(thinking, '')), '[^a-z]+'), lambda x: x <> '') AS w FROM m),
ct AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'hand')) AS f0, len(list_filter(w, lambda x: x = 'the')) AS f1, len(list_filter(w, lambda x: x = 'thing')) AS f2 FROM tok),
stt AS (SELECT count(*) AS nn, avg(n) AS l, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM ct),
sc AS (SELECT id, round(ln((nn - d0 + 0.5) / (d0 + 0.5) + 1) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / l)) + ln((nn - d1 + 0.5) / (d1 + 0.5) + 1) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / l))
       + ln((nn - d2 + 0.5) / (d2 + 0.5) + 1) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / l)), 6) AS score FROM ct, stt WHERE f0 + f1 + f2 > 0)"""
_HITS = """SELECT message_id, role, content, thinking, created_at, score, title, source, conversation_id, cwd FROM (
  SELECT m.id AS message_id, role, CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE coalesce(content, '') END AS content, thinking, m.created_at, score, title, source, conversation_id, cwd,
  row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, m.id) AS n FROM sc JOIN m USING (id) JOIN c ON c.id = m.conversation_id {where}) WHERE n = 1 ORDER BY score DESC, message_id LIMIT 20"""


@_query(_SCORES + _HITS.format(where=""))
def search_(a) -> DataFrame:
    return search.search(a, WORDS)


def _living(a) -> tuple[Archive, search.Index]:
    """An index that was built on other texts, and followed three rounds of changes: texts rewritten, messages gone and come."""
    path = Scratch(a.spark, "living-index").path
    early = a.messages.filter("substr(id, 1, 1) <> 'a'").withColumn("content", F.when(F.col("id").substr(1, 1) < "5", F.lit("the hand of another thing")).otherwise(F.col("content")))
    extra = a.messages.filter("substr(id, 1, 1) = 'b'").withColumn("id", F.concat(F.lit("x"), F.substring("id", 2, 15)))
    index = search.Index(Archive(a.spark, messages=early.unionByName(extra)), path)
    index.build(1)
    seen = early.unionByName(extra)
    steps = [("3", seen.filter("substr(id, 1, 1) >= '3'").unionByName(a.messages.filter("substr(id, 1, 1) < '3'"))), ("5", a.messages.filter("substr(id, 1, 1) <> 'a'").unionByName(extra))]
    for generation, (upto, messages) in enumerate(steps, 2):
        index.archive = Archive(a.spark, messages=messages)
        index.update(generation, a.messages.filter(F.col("id").substr(1, 1) < upto).select("id"))
    index.archive = a
    index.update(4, extra.select("id").union(a.messages.filter("substr(id, 1, 1) = 'a'").select("id")))
    return a, index


@_query(_SCORES + _HITS.format(where=""))
def search_indexed(a) -> DataFrame:
    """As ``search_``, from the living index."""
    archive, index = _living(a)
    return search.search(archive, WORDS, index=index)


QUERIES["search"], ORACLES["search"] = QUERIES.pop("search_"), ORACLES.pop("search_")


@_query(_SCORES + _HITS.format(where="WHERE source = 'claude-code' AND role = 'user' AND (cwd = '/repo' OR starts_with(cwd, '/repo/')) AND m.created_at > TIMESTAMP '2024-01-01 00:00:00'"))
def search_filtered(a) -> DataFrame:
    return search.search(a, WORDS, source="claude-code", role="user", cwd="/repo", days=9, now=NOW)


_RANKED = _SCORES + f""",
base AS (SELECT m.id, m.conversation_id, role, content, m.created_at, embedding, title, source, cwd FROM m JOIN c ON c.id = m.conversation_id WHERE content IS NOT NULL AND NOT regexp_matches(content, '^(Base directory for this skill:|# AGENTS\\.md instructions for|<(codex_internal_context|environment_context|local-command-caveat|recommended_plugins|skill)( |>))')),
ft AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM sc WHERE id IN (SELECT id FROM base) QUALIFY r <= 50),
vs AS (SELECT id, round({_COS.format(a="CAST(embedding AS DOUBLE[])", b=_VECTOR_SQL)}, 6) AS score FROM base WHERE embedding IS NOT NULL),
vt AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM vs QUALIFY r <= 50),
fu AS (SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM ft UNION ALL SELECT * FROM vt) GROUP BY id)"""


@_query(_RANKED + """SELECT score, message_id, role, content, created_at, title, source, conversation_id, cwd FROM (SELECT fu.score, base.id AS message_id, role, content, created_at, title, source, conversation_id, cwd,
  row_number() OVER (PARTITION BY conversation_id ORDER BY fu.score DESC, base.id) AS n FROM fu JOIN base USING (id)) WHERE n = 1 ORDER BY score DESC, message_id LIMIT 10""")
def hybrid(a) -> DataFrame:
    return search.hybrid(a, WORDS, VECTOR)


_NEAR = f""",
ok AS (SELECT m.id, conversation_id, role, content, m.created_at, embedding, title, source, cwd, updated_at FROM m JOIN c ON c.id = m.conversation_id WHERE embedding IS NOT NULL AND coalesce(content, '') <> '' AND json_extract_string(metadata, '$.history_of') IS NULL),
nr AS (SELECT *, round({_COS.format(a="CAST(embedding AS DOUBLE[])", b=_VECTOR_SQL)}, 6) AS similarity, row_number() OVER (PARTITION BY content ORDER BY updated_at DESC NULLS LAST, id) AS copy FROM ok),
bs AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY similarity DESC, id) AS n FROM nr WHERE copy = 1 AND similarity >= -1)
"""


@_query(_NEAR + "SELECT similarity, id AS message_id, role, CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END AS content, created_at, title, source, conversation_id, cwd FROM bs WHERE n = 1 ORDER BY similarity DESC, conversation_id LIMIT 10")
def related(a) -> DataFrame:
    return explore.neighbours(a, explore.Seed("message", "-", "-", tuple(VECTOR))).drop("raw", "embedding")


def _walk(depth: int, vector: str, after: list[str], source: str = "ok") -> str:
    """One node's step of a trail in SQL: the nearest three of what none of the steps ``after`` has met."""
    met = " UNION ALL ".join(f"SELECT conversation_id, content FROM {t}" for t in after) or "SELECT NULL, NULL WHERE false"
    return f"""(SELECT conversation_id, id, content, embedding, {depth} AS depth, row_number() OVER (ORDER BY similarity DESC, conversation_id) AS r FROM (
      SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY similarity DESC, id) AS n FROM (
        SELECT ok.conversation_id, ok.id, ok.content, ok.embedding, round({_COS.format(a="CAST(ok.embedding AS DOUBLE[])", b=vector)}, 6) AS similarity, row_number() OVER (PARTITION BY ok.content ORDER BY updated_at DESC NULLS LAST, ok.id) AS copy
        FROM {source} WHERE ok.conversation_id NOT IN (SELECT conversation_id FROM ({met})) AND ok.content NOT IN (SELECT content FROM ({met})))
      WHERE copy = 1 AND similarity >= 0) WHERE n = 1 QUALIFY r <= 3)"""


_TRAIL = _NEAR.partition(",\nnr AS")[0] + f",\nt0 AS {_walk(1, _VECTOR_SQL, [])}" + "".join(f",\nt{j} AS {_walk(2, 'CAST(g.embedding AS DOUBLE[])', [f't{i}' for i in range(j)], f'ok, (SELECT embedding FROM t0 WHERE r = {j}) g')}" for j in (1, 2, 3))


@_query(_TRAIL + " SELECT '-' AS conversation_id, CAST(0 AS BIGINT) AS depth, '-' AS seed_id" + "".join(f" UNION ALL SELECT conversation_id, depth, id FROM t{j}" for j in range(4)))
def trail(a) -> DataFrame:
    nodes, _ = explore.trail(a, explore.Seed("message", "-", "-", tuple(VECTOR)), depth=2, width=3, minimum=0.0)
    return a.spark.createDataFrame([(n["conversation_id"], n["depth"], n["seed_id"]) for n in nodes], "conversation_id string, depth long, seed_id string")


@_query("""SELECT conversation_id, CAST(k AS BIGINT) AS k, round(avg(x), 6) AS x FROM (SELECT conversation_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM m WHERE embedding IS NOT NULL) GROUP BY conversation_id, k""")
def conversation_vectors(a) -> DataFrame:
    return explore.mean_vectors(a.messages, "conversation_id").withColumn("x", F.round("x", 6))


@_query("SELECT 'word' AS engine, count(*) AS cases, round(avg(CASE WHEN r IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (SELECT item_id, min(CASE WHEN contains(text, 'zz') THEN NULL ELSE item_id % 5 + 1 END) AS r FROM benchmark GROUP BY item_id)", archive=False)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    name, engine = F.col("item_id").cast("string").alias("name"), F.lit("word").alias("engine")
    cases = b.select(name, engine, F.sha2(F.col("item_id").cast("string"), 256).alias("expected"))
    hits = b.filter(~F.col("text").contains("zz")).select(name, engine, (F.col("item_id") % 5 + 1).alias("rank"), F.sha2(F.col("item_id").cast("string"), 256).alias("id"), F.lit("").alias("conversation_id"))
    return evaluate.summary(evaluate.first_ranks(cases, hits))


@_query("""WITH r AS (SELECT doc_id, 'e' || doc_id % 3 AS engine, CASE WHEN doc_id % 5 > 1 THEN doc_id % 7 + 1 END AS rank, doc_id % 3 = 1 AND doc_id % 11 = 4 AS bad FROM documents),
g AS (SELECT engine, count(*) AS runs, count(CASE WHEN NOT bad THEN rank END) AS hits, round(avg(CASE WHEN bad OR rank IS NULL THEN 0 ELSE 1.0 / rank END), 6) AS mrr, count(*) FILTER (WHERE bad) AS errors FROM r GROUP BY engine)
SELECT engine, runs, hits, round(hits / runs, 6) AS hit_rate, mrr, errors, errors = 0 AND round(hits / runs, 6) >= 0.6 AS passes FROM g""", archive=False)
def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("e"), (F.col("doc_id") % 3).cast("string")).alias("engine"), F.when(F.col("doc_id") % 5 > 1, F.col("doc_id") % 7 + 1).alias("rank"), F.when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 11 == 4), "timed out").alias("error"))
    return evaluate.gate(evaluate.report(d, d.filter("error is not null")), 0.6)


# -- reading -----------------------------------------------------------------------------------------------------------

_POS = """,
p AS (SELECT id, conversation_id, role, content, created_at, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, id) AS pos FROM m WHERE json_extract_string(metadata, '$.history_of') IS NULL AND (coalesce(content, '') <> '' OR coalesce(thinking, '') <> ''))
"""


@_query(_POS + "SELECT conversation_id, id, role, content, created_at, pos FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY pos DESC) AS n FROM p) WHERE n <= 3")
def read_tail(a) -> DataFrame:
    return reading.window(reading.positions(a), 3).select("conversation_id", "id", "role", "content", "created_at", F.col("pos").cast("long").alias("pos"))


@_query(_POS + """SELECT conversation_id, id, role, content, created_at, pos FROM (SELECT p.*, row_number() OVER (PARTITION BY p.conversation_id ORDER BY abs(p.pos - t.pos), p.pos) AS n
  FROM p JOIN (SELECT p.conversation_id, p.pos FROM p JOIN (SELECT conversation_id, min(id) AS id FROM p GROUP BY conversation_id) q ON q.id = p.id) t ON t.conversation_id = p.conversation_id) WHERE n <= 3""")
def read_around(a) -> DataFrame:
    base = reading.positions(a)
    anchors = base.groupBy("conversation_id").agg(F.min("id").alias("anchor"))
    return reading.window(base, 3, anchors).select("conversation_id", "id", "role", "content", "created_at", F.col("pos").cast("long").alias("pos"))


@_query("""SELECT conversation_id, source, title, cwd, max(m.created_at) AS last_at FROM m JOIN c ON c.id = m.conversation_id WHERE (cwd = '/repo/p1' OR starts_with(cwd, '/repo/p1/')) AND coalesce(content, '') <> '' AND json_extract_string(metadata, '$.history_of') IS NULL
  GROUP BY conversation_id, source, title, cwd ORDER BY last_at DESC NULLS LAST, conversation_id LIMIT 4""")
def resume_sessions(a) -> DataFrame:
    return reading.sessions(a, "/repo/p1")


@_query("""sn AS (SELECT *, row_number() OVER (ORDER BY last_at DESC NULLS LAST, conversation_id) AS k FROM (SELECT conversation_id, max(m.created_at) AS last_at FROM m JOIN c ON c.id = m.conversation_id
  WHERE (cwd = '/repo/p1' OR starts_with(cwd, '/repo/p1/')) AND coalesce(content, '') <> '' AND json_extract_string(metadata, '$.history_of') IS NULL GROUP BY conversation_id) QUALIFY k <= 4),
tn AS (SELECT k, m.conversation_id, m.id, role, regexp_replace(content, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g') AS plain, row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.created_at DESC NULLS LAST, m.id DESC) AS n FROM m JOIN sn USING (conversation_id)
  WHERE coalesce(content, '') <> '' AND json_extract_string(metadata, '$.history_of') IS NULL QUALIFY n <= 6),
fl AS (SELECT *, row_number() OVER (ORDER BY k, n) AS i, (SELECT count(*) FROM sn) - k + 1 AS others FROM tn),
al AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS k, CAST(16000 AS BIGINT) AS room, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS given
  UNION ALL SELECT i, k, room, used + CASE WHEN quota <= used THEN 0 WHEN size <= least(1200, quota - used) THEN size ELSE greatest(least(1200, quota - used), 3) END, CASE WHEN quota <= used THEN 0 WHEN size <= least(1200, quota - used) THEN size ELSE greatest(least(1200, quota - used), 3) END
  FROM (SELECT i, k, room, used, size, least(room, greatest(1200, room // others)) AS quota FROM (
    SELECT fl.i, fl.k, CASE WHEN fl.k = al.k THEN room ELSE greatest(0, room - used) END AS room, CASE WHEN fl.k = al.k THEN used ELSE 0 END AS used, length(plain) AS size, others FROM al JOIN fl ON fl.i = al.i + 1)))
SELECT conversation_id, id AS message_id, role, CASE WHEN given >= length(plain) THEN plain ELSE substr(plain, 1, given - 3) || '...' END AS content FROM al JOIN fl USING (i) WHERE given > 0""", recursive=True)
def resume_packet(a) -> DataFrame:
    p = reading.packet(a, "/repo/p1")
    rows = [(s["conversation_id"], t["message_id"], t["role"], t["content"]) for s in p["sessions"] for t in s["turns"]]
    return a.spark.createDataFrame(rows, "conversation_id string, message_id string, role string, content string")


@_query("""SELECT conversation_id, file_path, edits, last_at, n FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY last_at DESC NULLS LAST, file_path) AS n FROM (SELECT conversation_id, file_path, count(*) AS edits, max(fe.created_at) AS last_at FROM fe JOIN m ON m.id = fe.message_id GROUP BY conversation_id, file_path)) WHERE n <= 8""")
def recent_files(a) -> DataFrame:
    return reading.activity(a)[0].withColumn("n", F.col("n").cast("long"))


@_query("""SELECT conversation_id, id, tool_name, status, created_at, n FROM (SELECT conversation_id, tc.id, tool_name, status, tc.created_at, row_number() OVER (PARTITION BY conversation_id ORDER BY tc.created_at DESC NULLS LAST, tc.id DESC) AS n FROM tc JOIN m ON m.id = tc.message_id) WHERE n <= 5""")
def recent_tools(a) -> DataFrame:
    return reading.activity(a)[1].withColumn("n", F.col("n").cast("long"))


@_query(_POS + """SELECT p.pos, 'tool' AS kind, tc.id, message_id, tc.created_at, tool_name AS label, status, duration_ms, input AS before, '{}' AS after FROM tc JOIN p ON p.id = tc.message_id
  UNION ALL SELECT p.pos, 'edit', fe.id, message_id, fe.created_at, file_path, edit_type, NULL, old_content, fe.content FROM fe JOIN p ON p.id = fe.message_id""")
def replay_events(a) -> DataFrame:
    return reading.events_of(a, reading.positions(a)).withColumn("pos", F.col("pos").cast("long"))


@_query("""SELECT source, (SELECT count(*) FROM c x WHERE x.source = s.source) AS conversations, (SELECT count(*) FROM m JOIN c x ON x.id = m.conversation_id WHERE x.source = s.source) AS messages, (SELECT count(*) FROM tc JOIN m ON m.id = tc.message_id JOIN c x ON x.id = m.conversation_id WHERE x.source = s.source) AS tool_calls,
  (SELECT count(*) FROM att JOIN m ON m.id = att.message_id JOIN c x ON x.id = m.conversation_id WHERE x.source = s.source) AS attachments, (SELECT count(*) FROM fe JOIN m ON m.id = fe.message_id JOIN c x ON x.id = m.conversation_id WHERE x.source = s.source) AS file_edits FROM (SELECT DISTINCT source FROM c) s""")
def counts_by_source(a) -> DataFrame:
    return reading.counts_by_source(a)


@_query("SELECT c.id, source, title, count(m.id) AS messages FROM c LEFT JOIN m ON m.conversation_id = c.id GROUP BY c.id, source, title")
def conversation_sizes(a) -> DataFrame:
    return reading.conversation_sizes(a)


@_query("SELECT count(*) AS messages, count(*) FILTER (WHERE embedding IS NULL AND coalesce(content, '') <> '') AS unembedded, count(*) FILTER (WHERE json_extract_string(metadata, '$.history_of') IS NOT NULL) AS superseded, (SELECT count(*) FROM c) AS conversations, (SELECT count(*) FROM fe WHERE message_id NOT IN (SELECT id FROM m)) AS orphan_edits FROM m")
def archive_health(a) -> DataFrame:
    return reading.health(a)


@_query("SELECT source, tool_name, count(*) AS calls, count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(duration_ms), 6) AS mean_ms FROM tc JOIN m ON m.id = tc.message_id JOIN c ON c.id = m.conversation_id GROUP BY source, tool_name")
def tool_usage(a) -> DataFrame:
    own = a.messages.select(F.col("id").alias("message_id"), "conversation_id").join(a.conversations.select(F.col("id").alias("conversation_id"), "source"), "conversation_id")
    return a.tool_calls.join(own, "message_id").groupBy("source", "tool_name").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


@_query("SELECT file_path, count(*) AS edits, count(DISTINCT message_id) AS turns, max(created_at) AS last_edit FROM fe GROUP BY file_path ORDER BY edits DESC, file_path LIMIT 20")
def most_edited_files(a) -> DataFrame:
    return a.file_edits.groupBy("file_path").agg(F.count(F.lit(1)).alias("edits"), F.count_distinct("message_id").alias("turns"), F.max("created_at").alias("last_edit")).orderBy(F.col("edits").desc(), "file_path").limit(20)


@_query("SELECT m.conversation_id, m.id, role, content, m.created_at, source, title, c.created_at AS started_at FROM m JOIN c ON c.id = m.conversation_id")
def export_flat(a) -> DataFrame:
    return reading.export_flat(a)


@_query("""SELECT c.id, (SELECT count(*) FROM m WHERE m.conversation_id = c.id) AS messages, (SELECT count(*) FROM tc JOIN m ON m.id = tc.message_id WHERE m.conversation_id = c.id) AS tool_calls, (SELECT count(*) FROM fe JOIN m ON m.id = fe.message_id WHERE m.conversation_id = c.id) AS file_edits,
  (SELECT arg_min(content, (created_at, id)) FROM m WHERE m.conversation_id = c.id) AS first_message FROM c""")
def export_nested(a) -> DataFrame:

    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(F.col(c))).cast("long").alias(c)

    return reading.export_nested(a).select("id", F.get(F.col("messages"), F.lit(0))["content"].alias("first_message"), size("messages"), size("tool_calls"), size("file_edits"))


# -- changes -----------------------------------------------------------------------------------------------------------

_EDITS = """,
ed AS (SELECT fe.id, file_path, edit_type AS type, fe.content, old_content AS old, fe.created_at AS ts, coalesce(m.conversation_id, 'unknown') AS conv, coalesce(source, '?') AS source,
       (SELECT u.content FROM m u WHERE u.conversation_id = m.conversation_id AND u.role = 'user' AND u.content <> '' AND u.created_at <= fe.created_at ORDER BY u.created_at DESC, u.id DESC LIMIT 1) AS prompt, message_id
       FROM fe LEFT JOIN m ON m.id = fe.message_id LEFT JOIN c ON c.id = m.conversation_id)
"""


@_query(_EDITS + "SELECT * FROM ed")
def edit_prompts(a) -> DataFrame:
    return changes.edits(a)


@_query(_EDITS + "SELECT file_path, id, ts, conv, source, type, (type = 'write' OR coalesce(old, '') <> '') AS exact, substr(split_part(coalesce(prompt, ''), chr(10), 1), 1, 80) AS prompt FROM ed WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') <= '2024-01-05' OR starts_with(strftime(ts, '%Y-%m-%d %H:%M:%S'), '2024-01-05')")
def timeline_as_of(a) -> DataFrame:
    return changes.timeline(changes.cut(changes.edits(a), "2024-01-05"))


@_query(_EDITS + """, q AS (SELECT *, max(CASE WHEN contains(conv, 'a1') THEN (ts, id) END) OVER (PARTITION BY file_path) AS last FROM ed) SELECT file_path, id, conv FROM q WHERE CASE WHEN last IS NULL THEN strftime(ts, '%Y-%m-%d %H:%M:%S') <= 'a1' ELSE (ts, id) <= last END""")
def cut_by_conversation(a) -> DataFrame:
    return changes.cut(changes.edits(a), "a1").select("file_path", "id", "conv")


@_query("SELECT file_path AS file, conversation_id AS conv, message_id AS msg, source FROM fe JOIN m ON m.id = fe.message_id JOIN c ON c.id = m.conversation_id")
def graph_edges(a) -> DataFrame:
    return changes.graph(a)


@_query("SELECT DISTINCT '  \"' || substr(conversation_id, 1, 8) || '\" -> \"' || file_path || '\";' AS line FROM fe JOIN m ON m.id = fe.message_id JOIN c ON c.id = m.conversation_id")
def graph_dot(a) -> DataFrame:
    return changes.graph_dot(changes.graph(a))


_WEIGHTS = "SELECT file_path, coalesce(m.conversation_id, 'unknown') AS conv, coalesce(source, '?') AS source, coalesce(title, '') AS title, count(*) AS edits, max(fe.created_at) AS last_edit FROM fe LEFT JOIN m ON m.id = fe.message_id LEFT JOIN c ON c.id = m.conversation_id GROUP BY 1, 2, 3, 4"


@_query(_WEIGHTS)
def edge_weights(a) -> DataFrame:
    return changes.weights(a)


@_query(f", w AS ({_WEIGHTS}) SELECT file_path AS node, CAST(sum(edits) AS BIGINT) AS edits, max(last_edit) AS last_edit, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM w GROUP BY file_path")
def file_nodes(a) -> DataFrame:
    return changes.nodes(changes.weights(a), "file_path")


@_query(f", w AS ({_WEIGHTS}) SELECT conv AS node, CAST(sum(edits) AS BIGINT) AS edits, max(last_edit) AS last_edit, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM w GROUP BY conv")
def conversation_nodes(a) -> DataFrame:
    return changes.nodes(changes.weights(a), "conv")


@_query(_EDITS.lstrip()[1:] + """, pe AS (SELECT *, max(CASE WHEN type = 'write' THEN (ts, id) END) OVER (PARTITION BY file_path) AS last FROM ed WHERE type <> 'shell'),
oe AS (SELECT file_path, regexp_replace(coalesce(content, ''), '\\n$', '') AS content, coalesce(old, '') AS old, conv, source, ts, substr(split_part(coalesce(prompt, ''), chr(10), 1), 1, 80) AS prompt, row_number() OVER (PARTITION BY file_path ORDER BY ts, id) AS k FROM pe WHERE (ts, id) >= last),
vn AS (SELECT file_path, k, content AS body, CASE WHEN content = '' THEN [] ELSE list_transform(string_split(content, chr(10)), lambda x: k) END AS owners FROM oe WHERE k = 1
  UNION ALL SELECT file_path, k, body, list_concat(owners[1:above], list_transform(range(greatest(0, CASE WHEN body = '' THEN 0 ELSE length(body) - length(replace(body, chr(10), '')) + 1 END - above - len(below))), lambda x: k), below)
  FROM (SELECT file_path, k, owners, above, owners[above + within + 2:] AS below, CASE WHEN old <> '' AND place > 0 THEN regexp_replace(substr(body, 1, place - 1) || content || substr(body, place + length(old)), '\\n$', '') END AS body
    FROM (SELECT o.file_path, o.k, o.old, o.content, v.body, v.owners, strpos(v.body, o.old) AS place, length(old) - length(replace(old, chr(10), '')) AS within, len(string_split(substr(v.body, 1, strpos(v.body, o.old) - 1), chr(10))) - 1 AS above
      FROM vn v JOIN oe o ON o.file_path = v.file_path AND o.k = v.k + 1 WHERE v.body IS NOT NULL))),
fv AS (SELECT file_path, string_split(body, chr(10)) AS texts, owners FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY k DESC) AS r FROM vn) WHERE r = 1 AND body <> ''),
ln AS (SELECT file_path, unnest(range(1, len(texts) + 1)) AS line, unnest(texts) AS text, unnest(owners) AS k FROM fv)
SELECT file_path, line, conv, source, ts, prompt, text FROM ln JOIN oe USING (file_path, k)""", recursive=True)
def blame(a) -> DataFrame:
    return changes.blame(changes.edits(a).filter("type <> 'shell'"))


@_query(_EDITS + """, l AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, id DESC) AS n FROM ed WHERE type = 'write')
  SELECT file_path, CAST(1 AS BIGINT) AS line, conv, source, ts, substr(split_part(coalesce(prompt, ''), chr(10), 1), 1, 80) AS prompt, content AS text FROM l WHERE n = 1""")
def blame_of_writes(a) -> DataFrame:
    return changes.blame(changes.edits(a).filter("type = 'write'"))


def _provenance(a) -> changes.Provenance:
    e = a.file_edits
    repo = F.regexp_extract("file_path", "^/repo/(p[0-9])/", 1)
    files = e.select(F.sha2("file_path", 256).alias("id"), repo.alias("repository"), F.regexp_extract("file_path", "^/repo/p[0-9]/(.*)$", 1).alias("path")).distinct()
    links = e.select(F.col("id").alias("file_edit_id"), F.sha2("file_path", 256).alias("file_id"), F.lit("path").alias("evidence"), F.sha2(F.coalesce("old_content", F.lit("")), 256).alias("old_content_hash"), F.sha2("content", 256).alias("new_content_hash"))
    repositories = files.select(F.col("repository").alias("id"), F.substring("repository", 1, 1).alias("lineage")).distinct()
    checkpoints = files.select(F.concat(F.lit("k"), "repository").alias("id"), "repository", F.sha2("repository", 256).alias("head"), F.lit("s").alias("state_hash"), F.lit("[]").alias("paths"), F.lit("hook").alias("capture_source"), F.lit("2024").alias("observed_at")).distinct()
    checkpoint_edits = e.select(F.concat(F.lit("k"), repo).alias("checkpoint_id"), F.col("id").alias("file_edit_id"), F.lit("hash").alias("evidence"))
    return changes.Provenance(a, files, links, checkpoints, checkpoint_edits, repositories)


_HIST = _EDITS.rstrip() + """,
h AS (SELECT ts AS observed_at, regexp_extract(file_path, '^/repo/(p[0-9])/', 1) AS repository, regexp_extract(file_path, '^/repo/p[0-9]/(.*)$', 1) AS path, type AS edit_type, 'path' AS evidence, message_id AS changeset_id, conv AS conversation, message_id AS turn, prompt, sha256(coalesce(old, '')) AS old_content_hash, sha256(content) AS new_content_hash FROM ed)
"""


@_query(_HIST + "SELECT * FROM h")
def file_history(a) -> DataFrame:
    return _provenance(a).file_history()


@_query(_HIST + "SELECT changeset_id AS id, conversation, turn, prompt, repository, path, edit_type, evidence FROM h WHERE conversation <> 'unknown'")
def changeset_files(a) -> DataFrame:
    return _provenance(a).changeset_files()


@_query(_HIST + "SELECT conversation, changeset_id, min(prompt) AS prompt, count(DISTINCT repository) AS repositories, count(DISTINCT coalesce(repository, '') || ':' || path) AS files, min(observed_at) AS first_edit, max(observed_at) AS last_edit FROM h GROUP BY conversation, changeset_id")
def conversation_changes(a) -> DataFrame:
    return _provenance(a).conversation_changes()


@_query(_HIST + "SELECT repository, conversation, changeset_id, count(*) AS edits, max(observed_at) AS last_edit FROM h WHERE conversation <> 'unknown' GROUP BY repository, conversation, changeset_id")
def repository_activity(a) -> DataFrame:
    return _provenance(a).repository_activity()


@_query(_HIST + "SELECT sha256(repository) AS head, conversation, changeset_id, repository, 'hash' AS evidence FROM h WHERE conversation <> 'unknown'")
def commit_conversations(a) -> DataFrame:
    return _provenance(a).commit_conversations()


@_query(_HIST + "SELECT DISTINCT repository, sha256(repository) AS head, 's' AS state_hash, '[]' AS paths, 'hook' AS capture_source, '2024' AS observed_at FROM h")
def checkpoint_states(a) -> DataFrame:
    return _provenance(a).checkpoint_states()


@_query(_HIST + "SELECT substr(repository, 1, 1) AS lineage, count(*) AS repositories, string_agg(repository, ',' ORDER BY repository) AS repository_ids FROM (SELECT DISTINCT repository FROM h) GROUP BY 1")
def repository_lineages(a) -> DataFrame:
    return _provenance(a).repository_lineages()


# -- redaction ---------------------------------------------------------------------------------------------------------

def _with_secrets(a):
    """Messages with a made-up key in every third one."""
    odd = F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 3 == 0
    secret = F.concat(F.lit(" AK"), F.lit("IA"), F.upper(F.substring("id", 1, 16)), F.lit(" end"))
    return a.messages.withColumn("content", F.when(odd, F.concat("content", secret)).otherwise(F.col("content")))


_SECRETS = """, ms AS (SELECT id, CASE WHEN CAST('0x' || substr(id, 1, 2) AS INTEGER) % 3 = 0 THEN content || ' AK' || 'IA' || upper(substr(id, 1, 16)) || ' end' ELSE content END AS content FROM m) """


@_query(_SECRETS + r"SELECT id, regexp_replace(content, '\b(AKIA|ASIA)[A-Z0-9]{16}\b', '[REDACTED:aws_access_key]', 'g') AS content FROM ms")
def redact_scrub(a) -> DataFrame:
    return redact.scrub(_with_secrets(a).select("id", "content"), "content")


@_query(_SECRETS + r"SELECT 'aws_access_key' AS kind, count(*) AS n FROM ms WHERE regexp_matches(content, '\b(AKIA|ASIA)[A-Z0-9]{16}\b')")
def redact_scan(a) -> DataFrame:
    a.messages = _with_secrets(a)
    return redact.by_kind(redact.scan(a))


# -- upsert and change index -------------------------------------------------------------------------------------------

def _incoming(a):
    some = F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 2 == 0
    return a.conversations.filter(some).select("id", "source", F.lit("renamed").alias("title"), (F.col("created_at") - F.expr("interval 1 hour")).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit("m1").alias("model"), F.lit(None).cast("string").alias("cwd"), "git_branch", "project_id", "metadata")


@_query("SELECT id, source, CASE WHEN e THEN 'renamed' ELSE title END AS title, CASE WHEN e THEN created_at - INTERVAL 1 HOUR ELSE created_at END AS created_at, updated_at, CASE WHEN e THEN 'm1' END AS model, cwd FROM (SELECT *, CAST('0x' || substr(id, 1, 2) AS INTEGER) % 2 = 0 AS e FROM c)")
def upsert_conversations(a) -> DataFrame:
    return upsert.conversations(a.conversations.select(*[f for f in a.conversations.columns]), _incoming(a)).select("id", "source", "title", "created_at", "updated_at", "model", "cwd")


@_query("""SELECT 'live' AS what, count(*) AS n, count(*) FILTER (WHERE embedding IS NOT NULL AND NOT e) AS vectors FROM (SELECT *, CAST('0x' || substr(id, 1, 2) AS INTEGER) % 4 = 0 AS e FROM m)
  UNION ALL SELECT 'history', count(*), count(embedding) FROM m WHERE CAST('0x' || substr(id, 1, 2) AS INTEGER) % 4 = 0""")
def upsert_messages(a) -> DataFrame:
    from threadloom import schema

    cols = [f.name for f in schema.MESSAGES]
    m = a.messages.select(*cols)
    new = m.filter(F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 4 == 0).withColumn("content", F.concat("content", F.lit(" more"))).withColumn("embedding", F.lit(None).cast("array<float>"))
    out = upsert.messages(m, new, NOW)
    old = F.get_json_object("metadata", "$.superseded_at").isNotNull()
    return out.groupBy(F.when(old, "history").otherwise("live").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("vectors"))


@_query("SELECT 'conversations' AS kind, id AS entity, CAST(2 AS BIGINT) AS generation FROM c WHERE CAST('0x' || substr(id, 1, 2) AS INTEGER) % 2 = 0")
def change_index(a) -> DataFrame:
    return upsert.index(upsert.changed("conversations", a.conversations, upsert.conversations(a.conversations, _incoming(a)), 2))


# -- memory ledger -----------------------------------------------------------------------------------------------------

def _ledger(spark: SparkSession, sf_dir: str):
    d = table(spark, sf_dir, "documents")
    provider = F.when(F.col("doc_id") % 2 == 0, "codex").otherwise("claude-code")
    sources = d.select(F.col("doc_id").cast("string").alias("id"), provider.alias("provider"), F.concat(F.lit("/p"), (F.col("doc_id") % 7).cast("string")).alias("scope"), F.col("source").alias("locator"), "text", (F.col("doc_id") % 11 != 0).alias("active")).select("id", "provider", "scope", "locator", F.sha2("text", 256).alias("hash"), F.col("text").alias("content"), "active")
    n = F.col("id").cast("long")
    links = sources.filter(n % 3 == 0).select(F.col("id").alias("source"), F.concat(F.lit("mem"), (n % 50).cast("string")).alias("canonical"), F.when(n % 6 == 0, F.col("hash")).otherwise(F.lit("old")).alias("applied_hash"))
    canonicals = sources.filter(n % 5 == 0).select(F.concat(F.lit("mem"), "id").alias("id"), "scope", "hash", "content")
    return sources, links, canonicals


_LEDGER = """WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'codex' ELSE 'claude-code' END AS provider, '/p' || (doc_id % 7) AS scope, source AS locator, sha256(text) AS hash, doc_id % 11 <> 0 AS active FROM documents),
l AS (SELECT id AS source, 'mem' || (doc_id % 50) AS canonical, CASE WHEN doc_id % 6 = 0 THEN hash ELSE 'old' END AS applied_hash FROM s WHERE doc_id % 3 = 0),
k AS (SELECT 'mem' || id AS id, scope, hash FROM s WHERE doc_id % 5 = 0),
col AS (SELECT canonical FROM l JOIN s ON s.id = l.source WHERE active AND applied_hash <> hash GROUP BY canonical HAVING count(*) > 1),
pl AS (SELECT s.id AS source, provider, scope, locator, hash, l.canonical, (SELECT min(k.id) FROM k WHERE k.hash = s.hash AND k.scope = s.scope) AS suggested,
       (SELECT min(n.id) FROM s n WHERE n.active AND n.provider = s.provider AND n.locator = s.locator AND n.hash = s.hash AND n.id <> s.id) AS replacement, active
       FROM s LEFT JOIN l ON l.source = s.id WHERE (active AND (l.source IS NULL OR applied_hash <> hash)) OR (NOT active AND l.source IS NOT NULL)),
p AS (SELECT source, provider, scope, locator, hash, CASE WHEN NOT active THEN 'missing' WHEN canonical IN (SELECT canonical FROM col) THEN 'collision' WHEN canonical IS NULL AND suggested IS NOT NULL THEN 'exact' WHEN canonical IS NULL THEN 'unlinked' ELSE 'changed' END AS kind, canonical, suggested, replacement FROM pl)
"""


@_query(_LEDGER + "SELECT * FROM p", archive=False)
def memory_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.plan(*_ledger(spark, sf_dir))


@_query(_LEDGER + """, o AS (SELECT scope, count(*) AS n FROM p GROUP BY scope), u AS (SELECT source, scope, hash, count(*) OVER (PARTITION BY scope, hash) AS n FROM p WHERE kind = 'unlinked')
  SELECT source, 'detach' AS action, NULL AS canonical FROM p WHERE kind = 'missing' AND replacement IS NOT NULL UNION ALL SELECT source, 'same', suggested FROM p WHERE kind = 'exact'
  UNION ALL SELECT source, 'merge', 'mem_' || substr(sha256(scope || ':' || hash), 1, 16) FROM u WHERE n > 1
  UNION ALL SELECT source, 'distinct', 'mem_' || substr(sha256(scope || ':' || hash), 1, 16) FROM u JOIN o USING (scope) WHERE u.n = 1 AND o.n = 1 AND scope NOT IN (SELECT scope FROM k)""", archive=False)
def memory_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, links, canonicals = _ledger(spark, sf_dir)
    return memory.reconcile(memory.plan(sources, links, canonicals), canonicals.select("scope", "hash"))


@_query(_LEDGER + "SELECT scope, count(*) AS sources, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE NOT active) AS missing FROM s GROUP BY scope", archive=False)
def memory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.status(_ledger(spark, sf_dir)[0])


@_query("""SELECT id AS message, CASE WHEN CAST('0x' || substr(id, 1, 2) AS INTEGER) % 3 = 0 THEN 'old' ELSE sha256(content) END AS content_hash, CASE WHEN CAST('0x' || substr(id, 1, 2) AS INTEGER) % 3 = 0 THEN 'changed' ELSE 'verified' END AS status FROM m
  UNION ALL SELECT 'gone' || conv_id, '', 'missing' FROM (SELECT DISTINCT conv_id FROM st)""")
def memory_evidence(a) -> DataFrame:
    h = F.when(F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 3 == 0, F.lit("old")).otherwise(F.sha2("content", 256))
    known = a.messages.select(F.col("id").alias("message"), h.alias("content_hash"))
    gone = a.conversations.select(F.concat(F.lit("gone"), F.substring_index("title", " ", -1)).alias("message"), F.lit("").alias("content_hash"))
    return memory.evidence_status(known.unionByName(gone), a.messages)


@_query("SELECT file_path AS path, CASE WHEN starts_with(file_path, '/repo/p1/') THEN '/repo/p1' WHEN starts_with(file_path, '/repo/p2/f1.py') THEN '/repo/p2/f1.py' ELSE '/repo' END AS scope FROM (SELECT DISTINCT file_path FROM fe)")
def longest_scope(a) -> DataFrame:
    scopes = a.spark.createDataFrame([("/repo",), ("/repo/p1",), ("/repo/p2/f1.py",), ("/rep",)], "scope string")
    return memory.scope_for(a.file_edits.select(F.col("file_path").alias("path")).distinct(), scopes)


# -- replication -------------------------------------------------------------------------------------------------------

def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as revisions of a row; each fifth event forks off its grandparent."""
    e, own = table(spark, sf_dir, "events"), Window.partitionBy("user_id").orderBy("event_id")
    return e.select("user_id", "event_id", F.lag("event_id", 1).over(own).alias("p"), F.lag("event_id", 2).over(own).alias("g")).select(F.lit("w").alias("workspace"), F.lit("row").alias("kind"), F.col("user_id").cast("string").alias("row_id"), F.lit("u").alias("author"), F.col("event_id").cast("string").alias("revision"), F.when(F.col("event_id") % 5 == 0, F.coalesce("g", "p")).otherwise(F.col("p")).cast("string").alias("previous_revision"))


_REV = """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS row_id, CAST(event_id AS VARCHAR) AS revision, CAST(CASE WHEN event_id % 5 = 0 THEN coalesce(g, p) ELSE p END AS VARCHAR) AS previous_revision FROM (SELECT user_id, event_id, lag(event_id, 1) OVER w AS p, lag(event_id, 2) OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))),
lv AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.row_id = r.row_id AND x.previous_revision = r.revision))
"""


@_query(_REV + "SELECT row_id, revision FROM lv", archive=False)
def revision_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.leaves(_revisions(spark, sf_dir)).select("row_id", "revision")


@_query(_REV + "SELECT row_id, string_agg(revision, ',' ORDER BY revision) AS revisions FROM lv GROUP BY row_id HAVING count(*) > 1", archive=False)
def revision_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.merge(_revisions(spark, sf_dir))[1].select("row_id", F.array_join("revisions", ",").alias("revisions"))


@_query("""SELECT 'w' AS workspace, author, first_missing, last_missing FROM (SELECT author, coalesce(lag(seq) OVER (PARTITION BY author ORDER BY seq), 0) + 1 AS first_missing, seq - 1 AS last_missing FROM (SELECT user_id % 20 AS author, event_id // 20 AS seq FROM events WHERE event_id % 13 <> 0 AND event_id // 20 > 0 GROUP BY ALL)) WHERE last_missing >= first_missing""", archive=False)
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_id % 13 <> 0 and event_id div 20 > 0")
    return replicate.gaps(e.select(F.lit("w").alias("workspace"), (F.col("user_id") % 20).alias("author"), F.expr("event_id div 20").alias("seq")))


@_query("SELECT 'w' AS workspace, user_id AS author, max(event_id) AS seq, arg_max(event_type, event_id) AS event FROM events GROUP BY user_id", archive=False)
def sequence_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.heads(table(spark, sf_dir, "events").select(F.lit("w").alias("workspace"), F.col("user_id").alias("author"), F.col("event_id").alias("seq"), F.col("event_type").alias("event")))


@_query("""WITH v AS (SELECT event_type AS proposal, user_id AS u, arg_max(event_id % 2 = 0, event_id) AS yes FROM events GROUP BY 1, 2), n AS (SELECT event_type AS proposal, count(DISTINCT user_id) AS electors FROM events GROUP BY 1)
  SELECT n.proposal, electors, count(*) FILTER (WHERE yes) AS yes, count(*) FILTER (WHERE yes) >= electors // 2 + 1 AS approved FROM n JOIN v USING (proposal) GROUP BY n.proposal, electors""", archive=False)
def quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("proposal"), F.col("user_id").alias("user"), (F.col("event_id") % 2 == 0).alias("approve"), F.col("event_id").alias("cast_at"))
    return replicate.approved(e, e.select("proposal", "user"))


@_query("SELECT cursor, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY cursor) AS s, row_number() OVER (ORDER BY cursor) AS n FROM (SELECT doc_id AS cursor, n_chars AS bytes FROM documents WHERE doc_id > 10 ORDER BY doc_id LIMIT 200)) WHERE s <= 60000 OR n = 1", archive=False)
def byte_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.page(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cursor"), F.col("n_chars").alias("bytes")), 10, 200, 60000)


@_query("""o AS (SELECT conversation_id, id, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS k FROM m),
w AS (SELECT conversation_id, id, bytes, k, 1 AS n, bytes AS total, 0 AS batch FROM o WHERE k = 1 UNION ALL
  SELECT o.conversation_id, o.id, o.bytes, o.k, CASE WHEN w.n >= 3 OR w.total + o.bytes > 4000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 3 OR w.total + o.bytes > 4000 THEN o.bytes ELSE w.total + o.bytes END,
  CASE WHEN w.n >= 3 OR w.total + o.bytes > 4000 THEN w.batch + 1 ELSE w.batch END FROM w JOIN o ON o.conversation_id = w.conversation_id AND o.k = w.k + 1)
SELECT conversation_id, id, bytes, CAST(batch AS BIGINT) AS batch FROM w""", recursive=True)
def upload_batches(spark_archive) -> DataFrame:
    m = spark_archive.messages.select("conversation_id", "id", F.octet_length("content").cast("long").alias("bytes"))
    return replicate.batches(m, ["conversation_id"], 3, 4000)


@_query("""SELECT DISTINCT e.event_id AS object, e.user_id % 10 AS device FROM events e WHERE e.event_id % 8 >= (e.user_id % 10) % 4 AND (e.event_id % 8 + e.user_id % 10) % 3 <> 0""", archive=False)
def readable_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    replicas = e.select((F.col("user_id") % 10).alias("workspace"), F.col("event_id").alias("object"), (F.col("event_id") % 8).alias("epoch"))
    members = spark.range(10).select(F.col("id").alias("workspace"), F.col("id").alias("user"), F.col("id").alias("device"), (F.col("id") % 4).alias("history_from"))
    envelopes = spark.range(80).select(F.expr("id div 8").alias("workspace"), F.expr("id div 8").alias("device"), (F.col("id") % 8).alias("epoch")).filter("(epoch + device) % 3 <> 0")
    return replicate.readable(replicas, members, envelopes).select("object", "device")


@_query("SELECT user_id AS user, CAST(sum(b) AS BIGINT) AS bytes, sum(b) <= 2000 AS within FROM (SELECT DISTINCT user_id, event_id % 50 AS o, (event_id % 50) * 10 AS b FROM events) GROUP BY user_id", archive=False)
def storage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 50).alias("object"), (F.col("event_id") % 50 * 10).alias("bytes"))
    return replicate.quota(o, 2000)


@_query("""WITH RECURSIVE o AS (SELECT user_id AS u, event_id % 3 AS epoch, event_id % 37 AS object, min(event_id) AS cursor, (event_id % 37) * 7 + 1 AS bytes FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY cursor) AS k FROM o),
w AS (SELECT u, epoch, object, cursor, bytes, k, bytes <= 900 AS admitted, CASE WHEN bytes <= 900 THEN bytes ELSE 0 END AS used FROM k WHERE k = 1 UNION ALL
  SELECT k.u, k.epoch, k.object, k.cursor, k.bytes, k.k, w.used + k.bytes <= 900, w.used + CASE WHEN w.used + k.bytes <= 900 THEN k.bytes ELSE 0 END FROM w JOIN k ON k.u = w.u AND k.k = w.k + 1)
SELECT u AS "user", epoch, object, cursor, CAST(bytes AS BIGINT) AS bytes, admitted, CAST(used AS BIGINT) AS used FROM w""", archive=False)
def admitted_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 3).alias("epoch"), (F.col("event_id") % 37).alias("object"), (F.col("event_id") % 37 * 7 + 1).alias("bytes"), F.col("event_id").alias("cursor"))
    return replicate.admitted(o, 900)


@_query(_REV.replace("WITH", "WITH RECURSIVE", 1) + """, n AS (SELECT row_id, count(*) AS n FROM lv GROUP BY row_id),
up AS (SELECT row_id, revision AS leaf, previous_revision AS revision, 1 AS d FROM lv WHERE previous_revision IS NOT NULL UNION ALL SELECT up.row_id, up.leaf, r.previous_revision, d + 1 FROM up JOIN r ON r.row_id = up.row_id AND r.revision = up.revision WHERE r.previous_revision IS NOT NULL),
ln AS (SELECT row_id, leaf, string_agg(revision, ',' ORDER BY d) AS line FROM up GROUP BY ALL),
u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS row_id, user_id % 7 > 0 AS there, 'h' || user_id % 3 AS hash FROM events),
a AS (SELECT row_id, revision AS head, coalesce(line, '') AS line, CASE WHEN n > 1 THEN 'conflict' WHEN NOT there THEN 'tombstone' WHEN hash = 'h' || CAST(revision AS BIGINT) % 3 THEN 'replica' ELSE 'attest' END AS action
  FROM lv JOIN n USING (row_id) JOIN u USING (row_id) LEFT JOIN ln ON ln.row_id = lv.row_id AND ln.leaf = lv.revision)
SELECT row_id, action, head, CASE WHEN action = 'tombstone' THEN trim(head || ',' || line, ',') ELSE line END AS lineage FROM a""", archive=False)
def replica_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _revisions(spark, sf_dir).withColumn("content_hash", F.concat(F.lit("h"), (F.col("revision").cast("long") % 3).cast("string"))).withColumn("state", F.lit("active"))
    users = table(spark, sf_dir, "events").select("user_id").distinct().filter("user_id % 7 > 0")
    rows = users.select(F.lit("w").alias("workspace"), F.lit("row").alias("kind"), F.col("user_id").cast("string").alias("row_id"), F.lit("u").alias("author"), F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("content_hash"))
    return replicate.replica_feed(rows, r).select("row_id", "action", "head", F.array_join("lineage", ",").alias("lineage"))


_ODD_PATHS = """WITH p AS (SELECT event_id AS id, ['/', '', './', '//'][event_id % 4 + 1] || 'a' || ['', '/', '//', '/./'][event_id // 4 % 4 + 1] || ['', '../', 'b/../', 'c/./'][event_id // 16 % 4 + 1] || ['', 'd', '..', 'e/'][event_id // 64 % 4 + 1] AS path FROM events)"""


@_query(_ODD_PATHS.replace("WITH", "WITH RECURSIVE", 1) + """, s AS (SELECT DISTINCT path, starts_with(path, '/') AS rooted, string_split(path, '/') AS parts FROM p),
f AS (SELECT path, rooted, parts, 1 AS k, CAST([] AS VARCHAR[]) AS stack FROM s UNION ALL SELECT path, rooted, parts, k + 1,
  CASE WHEN parts[k] IN ('', '.') THEN stack WHEN parts[k] <> '..' THEN list_append(stack, parts[k]) WHEN len(stack) > 0 AND stack[-1] <> '..' THEN stack[:len(stack) - 1] WHEN rooted THEN stack ELSE list_append(stack, '..') END FROM f WHERE k <= len(parts)),
n AS (SELECT path, CASE WHEN rooted THEN '/' ELSE '' END || array_to_string(stack, '/') AS x FROM f WHERE k = len(parts) + 1)
SELECT id, path, CASE WHEN x = '' THEN '.' ELSE x END AS normal, x = '/a' OR starts_with(x, '/a/') AS under FROM p JOIN n USING (path)""", archive=False)
def odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (F.floor(e / by) % 4).cast("int"))
    path = F.concat(pick(["/", "", "./", "//"], 1), F.lit("a"), pick(["", "/", "//", "/./"], 4), pick(["", "../", "b/../", "c/./"], 16), pick(["", "d", "..", "e/"], 64))
    p = table(spark, sf_dir, "events").select(e.alias("id"), path.alias("path"))
    return p.select("id", "path", T.normal_path(F.col("path")).alias("normal"), T.under(F.col("path"), "/x/../a/").alias("under"))


@_query("SELECT DISTINCT id FROM (SELECT id FROM c WHERE cwd = '/repo/p2' OR starts_with(cwd, '/repo/p2/') UNION ALL SELECT conversation_id FROM fe JOIN m ON m.id = fe.message_id WHERE starts_with(file_path, '/repo/p2/'))")
def team_scope(a) -> DataFrame:
    return replicate.team_scope(a.conversations, a.messages, a.file_edits, a.spark.createDataFrame([("/repo/p2/",)], "root string"))


@_query("SELECT substr(sha256('w:u:messages:' || id), 1, 16) AS id, substr(sha256('w:u:conversations:' || conversation_id), 1, 16) AS conversation_id, substr(sha256('w:u:messages:' || parent_id), 1, 16) AS parent_id FROM m")
def foreign_ids(a) -> DataFrame:
    return replicate.foreign(a.messages.select("id", "conversation_id", "parent_id"), "w", "u", "messages", {"conversation_id": "conversations", "parent_id": "messages"})


@_query("SELECT id, conversation_id FROM m WHERE CAST('0x' || substr(conversation_id, 1, 2) AS INTEGER) % 2 = 0")
def recovered_orphans(a) -> DataFrame:
    """Messages whose conversation is lost, found again from the rule that made their ids: a join on the hash of each number and turn."""
    lost = a.messages.filter(F.conv(F.substring("conversation_id", 1, 2), 16, 10).cast("int") % 2 == 0).select("id")
    known = a.conversations.select(F.col("id").alias("conversation_id"), F.substring_index("title", " ", -1).alias("n"), "created_at", "updated_at")
    # turns are a minute each from the conversation's own hour, so its first and last times tell its first and last turn
    turn = lambda at: F.expr(f"cast(cast({at} - (timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(n as int), 0, 0)) as interval minute) as bigint)")
    known = known.select("conversation_id", "n", turn("created_at").alias("first"), turn("updated_at").alias("last"))
    known = known.select("conversation_id", "n", "last", F.explode(F.sequence("first", "last", F.lit(BLOCK).cast("long"))).alias("block"))
    made = known.select("conversation_id", "n", F.explode(F.sequence("block", F.least(F.col("block") + BLOCK - 1, F.col("last")))).alias("turn")).select("conversation_id", F.substring(F.sha2(F.concat(F.lit("msg:"), "n", F.lit(":"), F.col("turn").cast("string")), 256), 1, 16).alias("id"))
    return made.join(lost, "id", "left_semi").select("id", "conversation_id")


# -- streams and plain SQL ---------------------------------------------------------------------------------------------

@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2", archive=False)
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inbox.windowed(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


@_query("SELECT 'codex' AS source, '/f' || (user_id % 50) AS path, max(event_id) AS mtime FROM events GROUP BY 2", archive=False)
def inbox_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lit("codex").alias("source"), F.concat(F.lit("/f"), (F.col("user_id") % 50).cast("string")).alias("path"), F.col("event_id").alias("mtime"), F.lit(1).cast("long").alias("size"))
    return inbox.coalesced(rows).select("source", "path", "mtime")


@_query("SELECT event_id AS id, ts AS update_time FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 5 SECOND AND 30000 - event_id // 100 <= (SELECT coalesce(min(30000 - p), 30000) FROM (SELECT event_id // 100 AS p, min(ts) AS o FROM events GROUP BY 1) WHERE o < TIMESTAMP '2024-01-15' - INTERVAL 5 SECOND)", archive=False)
def frontier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "events").select((30000 - F.expr("event_id div 100")).alias("page"), F.col("event_id").alias("id"), F.col("ts").alias("update_time"))
    return inbox.frontier(pages, datetime(2024, 1, 15))


@_query("SELECT id, conversation_id, role FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id) = 1")
def sql_qualify(a) -> DataFrame:
    return gate.run(a, "SELECT id, conversation_id, role FROM messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id) = 1")


@_query("SELECT source, role, count(*) AS n FROM m JOIN c ON c.id = m.conversation_id GROUP BY ROLLUP (source, role)")
def sql_rollup(a) -> DataFrame:
    return gate.run(a, "SELECT source, role, count(*) AS n FROM messages m JOIN conversations c ON c.id = m.conversation_id GROUP BY ROLLUP (source, role)")


@_query("SELECT id, json_extract_string(metadata, '$.history_of') AS h, starts_with(id, '0') AS zero FROM m")
def sql_shim(a) -> DataFrame:
    return gate.run(a, "SELECT id, json_extract_string(metadata, '$.history_of') AS h, starts_with(id, '0') AS zero FROM messages")


@_query("SELECT role, conversation_id, id FROM (SELECT *, row_number() OVER (PARTITION BY role, conversation_id ORDER BY id) AS n FROM m) WHERE n = 1")
def sql_qualify_lines(a) -> DataFrame:
    return gate.run(a, "select role, conversation_id, id\nfrom messages\nqualify row_number() over (partition by role, conversation_id order by id) = 1\norder by id")


@_query("SELECT source, count(*) AS n FROM (SELECT c.source, row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.id) AS k FROM m JOIN c ON c.id = m.conversation_id) WHERE k <= 2 GROUP BY source")
def sql_qualify_cte(a) -> DataFrame:
    return gate.run(a, "WITH firsts AS (SELECT m.id, c.source FROM messages m JOIN conversations c ON c.id = m.conversation_id QUALIFY row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.id) <= 2) SELECT source, count(*) AS n FROM firsts GROUP BY source")


@_query("(SELECT role AS name, id FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY id) AS n FROM m) WHERE n = 1) UNION ALL SELECT source, min(id) FROM c GROUP BY source")
def sql_qualify_union(a) -> DataFrame:
    return gate.run(a, "SELECT role AS name, id FROM messages QUALIFY row_number() OVER (PARTITION BY role ORDER BY id) = 1 UNION ALL SELECT source, min(id) FROM conversations GROUP BY source")


@_query("SELECT CAST(extract(year FROM created_at) AS INT) AS y, count(*) AS n FROM (SELECT created_at, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS k FROM m) WHERE k = 1 GROUP BY 1")
def sql_qualify_subquery(a) -> DataFrame:
    return gate.run(a, "SELECT y, count(*) AS n FROM (SELECT CAST(EXTRACT(YEAR FROM created_at) AS INT) AS y, id FROM messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) = 1) GROUP BY y")


@_query("""SELECT id, follows FROM (SELECT id, parent_id IS NOT DISTINCT FROM lag(id) OVER w AS follows, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, id)) WHERE n <= 3""")
def sql_qualify_distinct_from(a) -> DataFrame:
    return gate.run(a, "SELECT id, parent_id IS NOT DISTINCT FROM lag(id) OVER w AS follows FROM messages QUALIFY row_number() OVER w <= 3 WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, id)")


@_query("SELECT role, count(*) AS n FROM m WHERE conversation_id IN (SELECT id FROM c WHERE source <> 'claude') AND EXISTS (SELECT 1 FROM c WHERE c.id = m.conversation_id) GROUP BY role HAVING count(*) > 1")
def sql_subqueries(a) -> DataFrame:
    return gate.run(a, "SELECT role, count(*) AS n FROM messages m WHERE conversation_id IN (SELECT id FROM conversations WHERE source <> 'claude') AND EXISTS (SELECT 1 FROM conversations c WHERE c.id = m.conversation_id) GROUP BY role HAVING count(*) > 1")


@_query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source DESC NULLS LAST, doc_id) AS n FROM documents) WHERE n = 1", archive=False)
def collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.one_copy(table(spark, sf_dir, "documents"), "text", F.col("source").desc_nulls_last(), "doc_id").select("doc_id", "source")


@_query("SELECT id, parent_id FROM m WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM m)")
def missing_parents(a) -> DataFrame:
    m = a.messages.select("id", "parent_id").filter("parent_id is not null")
    return m.join(a.messages.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


@_query("SELECT id, CASE WHEN length(content) > 40 THEN substr(content, 1, 40) || '...' ELSE content END AS short FROM m WHERE NOT regexp_matches(content, '^<skill( |>)')")
def clean_clips(a) -> DataFrame:
    return a.messages.filter(T.clean(F.col("content"))).select("id", T.clip(F.col("content"), 40).alias("short"))
