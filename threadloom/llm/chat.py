"""Chat formatting with collapse of cumulative snapshots.

Chat systems log a conversation again after each turn, so many logged conversations are prefixes of longer ones. Each
turn gets a rolling hash of its conversation up to it: the exclusive or of 128-bit hashes of its position and of the
128-bit hash of its role and text, so a long conversation is hashed in blocks of turns that are joined afterwards, and
texts are shuffled only once it is known which conversations stay. A conversation whose last hash and length
are a prefix of a longer one falls to an anti-join; of equal ones the smallest id stays. The rest is rendered, a row for
each ``CHUNK`` turns, so a conversation of any length is no single row or task.

Defined results: a null role renders as ``unknown``, a null text as ''. A null turn comes before all others. A turn
that is logged twice, alike in all columns, counts once; several texts of one turn stand in order of role and text.
Rows with a null id are one conversation. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.runtime import Scratch

CHUNK = 256
#: Turns of a conversation that one task numbers and hashes at a time, by turn number.
BLOCK = 256


def _turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """id, turn, role, text and ``k1``, ``k2``, a 128-bit hash of role and text, for each row."""
    t = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return t.withColumn("k1", F.xxhash64("role", "text")).withColumn("k2", F.xxhash64(F.lit("second"), "text", "role"))


def _same(*more: str) -> Column:
    """Equal ids, null with null, and equal columns ``more``; those of ``_other`` end in an underscore."""
    on = F.col("id").eqNullSafe(F.col("id_"))
    for c in more:
        on = on & (F.col(c) == F.col(f"{c}_"))
    return on


def _other(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_") for c in keys], *[c for c in df.columns if c not in keys])


def prefixes(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn, without its text: id, turn, role, k1, k2, pos (from 1), h1 and h2, hashes of the conversation up to it.

    A text is hashed where it is read, and only hashes are shuffled and sorted. Where a turn has several texts of one
    role, their order is the texts': those turns alone are read again.
    """
    scratch = Scratch(df.sparkSession, "chat-turns")
    rows = _turns(df, id_col, turn_col, role_col, text_col)
    each = scratch.keep(rows.select("id", "turn", "role", "k1", "k2").distinct(), "each")
    # written, so that its size is known when it is joined: no text moves where few turns or none are tied
    tied = scratch.keep(each.groupBy("id", "turn", "role").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "tied")
    several = rows.join(_other(tied, "id", "turn", "role"), _same("turn", "role"), "left_semi").distinct()
    ranked = several.withColumn("nth", F.row_number().over(Window.partitionBy("id", "turn", "role").orderBy("text"))).select("id", "turn", "role", "k1", "k2", "nth")
    order = scratch.keep(ranked, "order")
    keys = ("id", "turn", "role", "k1", "k2")
    turns = each.join(_other(order, *keys), _same(*keys[1:]), "left").select(*keys, F.coalesce("nth", F.lit(1)).alias("nth"), F.floor(F.col("turn") / BLOCK).alias("block"))

    own = Window.partitionBy("id", "block").orderBy("turn", "role", "nth")
    earlier = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.row_number().over(own))
    sizes = turns.groupBy("id", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    numbered = placed.join(_other(starts, "id", "block"), _same("block")).select(*keys, "block", (F.col("start") + F.col("at")).cast("long").alias("pos"))
    hashed = scratch.keep(numbered.withColumn("x1", F.xxhash64("pos", "k1", "k2")).withColumn("x2", F.xxhash64(F.lit("second"), "k2", "k1", "pos")), "hashed")
    so_far = Window.partitionBy("id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    within = hashed.withColumn("y1", F.bit_xor("x1").over(so_far)).withColumn("y2", F.bit_xor("x2").over(so_far))
    blocks = hashed.groupBy("id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    base = blocks.select("id", "block", F.coalesce(F.bit_xor("b1").over(earlier), F.lit(0)).alias("z1"), F.coalesce(F.bit_xor("b2").over(earlier), F.lit(0)).alias("z2"))
    return within.join(_other(base, "id", "block"), _same("block")).select(*keys, "pos", F.col("y1").bitwiseXOR(F.col("z1")).alias("h1"), F.col("y2").bitwiseXOR(F.col("z2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """The ids, of ``prefixes``' rows, whose conversation is no prefix of a longer one, and the least of equal ones; with ``n``."""
    ends = turns.groupBy("id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e")).select("id", F.col("e.pos").alias("n"), F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2"))
    inner = turns.select("id", "pos", "h1", "h2").join(ends.select(F.col("id").alias("i"), F.col("n")), F.col("id").eqNullSafe(F.col("i"))).filter("pos < n").select(F.col("pos").alias("p"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    whole = ends.groupBy("n", "h1", "h2").agg(F.min("id").alias("id"))
    return whole.join(inner, (F.col("n") == F.col("p")) & (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left_anti").select("id", "n")


def render(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Id, chunk (from 0), n_turns (of the conversation) and rendered, for each ``CHUNK`` turns of each maximal conversation."""
    scratch = Scratch(df.sparkSession, "chat")
    turns = scratch.keep(prefixes(df, id_col, turn_col, role_col, text_col), "turns")
    stay = maximal(turns)
    keys = ("id", "turn", "role", "k1", "k2")
    kept = scratch.keep(turns.join(_other(stay, "id"), _same()).select(*keys, "pos", "n"), "kept")
    # texts meet what stays once; a turn that is logged twice gives its piece twice, and the set has it once
    read = _turns(df, id_col, turn_col, role_col, text_col)
    whole = read.join(_other(kept, *keys), _same(*keys[1:]))
    pieces = whole.select("id", "n", F.floor((F.col("pos") - 1) / CHUNK).cast("long").alias("chunk"), "pos", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("piece"))
    rows = pieces.groupBy("id", "n", "chunk").agg(F.array_sort(F.collect_set(F.struct("pos", "piece"))).alias("p"))
    return rows.select(F.col("id").alias(id_col), "chunk", F.col("n").alias("n_turns"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("rendered"))


def op2_snapshot_collapse(spark, sf_dir: str) -> DataFrame:
    """``conversations`` without logged prefixes, rendered."""
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n, role, text FROM t
), h AS (
  SELECT conv_id, pos, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece,
         sha256(string_agg(role || chr(0) || text, chr(1)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h FROM p
), e AS (
  SELECT n, h, min(conv_id) AS conv_id FROM h WHERE pos = n GROUP BY n, h
), k AS (
  SELECT conv_id FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pos = e.n AND h.h = e.h AND h.n > e.n)
)
SELECT conv_id, CAST(floor((pos - 1) / 256) AS BIGINT) AS chunk, n AS n_turns, string_agg(piece, '' ORDER BY pos) AS rendered
FROM h WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id, chunk, n
"""
