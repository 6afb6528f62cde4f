"""Line dedup: normalised lines that many documents have go, but for one document's.

Lines are exploded with their positions, and those long enough are told by a hash of their key: the first 16 bytes of
its SHA-256. Documents are counted by (hash, id) first and then by hash, so that a line of a third of all documents is
counted where it stands. Lines of hashes over the threshold are dropped but in the largest id that has them: frequent
hashes meet their lines by a join that broadcasts the few hot ones and shuffles the rest. Dropped positions are gathered
a text, and a text is put together again from the positions that are left, all in built-in functions.

Defined results: a null or empty text is one empty line. Rows of one id are one document when documents are counted,
and rows without an id are one together, which is smaller than any other; each row gets its own result. Repeated lines
of a document count once, and go or stay together. An empty table gives an empty result. ``drop_lines`` carries the
caller's row in a struct, so that no name of it can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.hot import attach
from threadloom.runtime import Scratch

#: Keys of fewer code points are left alone.
LEAST_LENGTH = 40
#: Keys in fewer documents are left alone.
LEAST_DOCS = 5

_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def lines(text: Column) -> Column:
    """The lines of ``text``; null gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(_SPACE)))


def _text_id(text: Column) -> list[Column]:
    """Tells texts of one id apart: rows of one id and one text have the same lines at the same positions."""
    return [F.xxhash64(text).alias("_sum"), F.octet_length(text).alias("_bytes")]


def dropped_lines(df: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_sum`` and ``_bytes`` of each text that loses lines, with ``dropped``, their positions in order."""
    scratch, text = Scratch(df.sparkSession, "line-dedup"), F.coalesce(F.col(text_col), F.lit(""))
    # the outer form, or the optimiser splits once more to filter by the array's size
    each = df.select(F.col(id_col).alias("_id"), *_text_id(text), F.posexplode_outer(lines(F.col(text_col))).alias("_pos", "_line"))
    trimmed = each.select("_id", "_sum", "_bytes", "_pos", F.trim("_line", F.lit(_SPACE)).alias("_line")).filter(F.char_length("_line") >= least_length)
    hashed = trimmed.select("_id", "_sum", "_bytes", "_pos", F.substring(F.unhex(F.sha2(ascii_lower(F.col("_line")).cast("binary"), 256)), 1, 16).alias("_hash"))
    places = scratch.keep(hashed, "places")
    by_document = places.groupBy("_hash", "_id").agg(F.count(F.lit(1)).alias("_lines"))
    by_hash = by_document.groupBy("_hash").agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper"), F.sum("_lines").alias("_rows"))
    often = scratch.keep(by_hash.filter(F.col("_docs") >= least_docs).drop("_docs"), "often")
    gone = attach(places, often, "_hash", "_rows").filter(~F.col("_id").eqNullSafe(F.col("_keeper")))
    return gone.groupBy("_id", "_sum", "_bytes").agg(F.array_sort(F.collect_set("_pos")).alias("dropped"))


def drop_lines(df: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``df``: ``row``, its columns; ``text`` that is left; ``n_lines`` before; ``n_dropped``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(id_col).alias("_id"), text.alias("_text"), *_text_id(text))
    gone = dropped_lines(df, least_length, least_docs, id_col, text_col).select(F.col("_id").alias("_i"), F.col("_sum").alias("_s"), F.col("_bytes").alias("_b"), "dropped")
    found = whole.join(gone, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sum") == F.col("_s")) & (F.col("_bytes") == F.col("_b")), "left")
    split = found.select("row", "_text", F.split("_text", "\n", -1).alias("_lines"), "dropped")
    # positions by set difference: a look-up in a hash set for each line, however many lines a text has
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("dropped"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    return split.select("row", F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(left).alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``documents`` without the lines of at least 40 code points that at least 5 documents have."""
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
