"""Exact dedup by content sort: DataFrame operations only.

Texts are normalised by deleting ASCII white space. Sampled splitters (Spark's range partitioner) deal the
rows out by their normalised bytes' first letters and a digest, each partition is sorted externally, by the whole
bytes in the end, and a sort-based window compares each row with its neighbour in full. Texts that hold more than ``1 / HOT_SHARE`` of all rows would land in one
range, so they are found first by an aggregate of 8-byte digests and dealt to several ranges by a salt;
their partial groups are merged afterwards, one row a salt.

Defined results: a null or empty text, or one of white space only, normalises to '' and forms one group like
any other. Ties of the longest original go to the smallest id, a null id last. Repeated rows count once each, and of
rows that agree in all this one stays. An empty table gives an empty result. Columns beyond the id and the text are
ignored by ``copies``, and carried by ``drop_copies`` in a struct, so that names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.runtime import Scratch

#: A text is hot when it has more than 1/HOT_SHARE of all rows; so at most HOT_SHARE texts are, of 20 bytes each.
HOT_SHARE = 65_536
#: and never with fewer rows than this.
HOT_ROWS = 64

#: Code points of a normalised text that splitters hold.
HEAD = 24

_SPACE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """``text`` without the characters of [\\x20\\x09-\\x0D]; null gives ''."""
    return F.translate(F.coalesce(text, F.lit("")), _SPACE, "")


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    The row with the most code points in its original text stays, then the one with the smallest id.
    """
    spark = df.sparkSession
    n = df.count()
    most = max(HOT_ROWS, n // HOT_SHARE)
    docs = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_cp")).withColumn("_h", F.xxhash64("_norm"))
    hot = docs.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > most).select("_h", F.ceil(F.col("_c") / most).cast("int").alias("_salts"))
    # at most n / most <= HOT_SHARE rows: bounded, whatever the input
    dealt = docs.join(F.broadcast(hot), "_h", "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("_id", "_cp"), F.col("_salts")).cast("int"))).drop("_salts")
    # splitters are sampled to the driver, so they are a short prefix and a digest; equal texts agree in both
    dealt = dealt.withColumn("_head", F.substring("_norm", 1, HEAD))
    near = Window.partitionBy("_head", "_h", "_norm", "_salt")
    best = near.orderBy(F.col("_cp").desc(), F.col("_id").asc_nulls_last())
    sorted_rows = (
        dealt.repartitionByRange("_head", "_h", "_salt")
        .withColumn("_keep", F.first("_id").over(best))
        .withColumn("_keep_cp", F.first("_cp").over(best))
        .withColumn("_rank", F.row_number().over(best))
        .withColumn("_size", F.count(F.lit(1)).over(near))
        .select("_id", "_salt", "_keep", "_keep_cp", "_rank", "_size", F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"))
    )
    # a hot text's salts each have a first row; where these agree in length and id, the least salt's stays
    groups = Scratch(spark, "content-sort").keep(sorted_rows, "groups")
    firsts = groups.filter((F.col("_salt") >= 0) & (F.col("_rank") == 1))
    # a row for each salt of the hot texts; then one a hot text: bounded as above
    whole = firsts.groupBy("_sha").agg(F.min(F.struct((-F.col("_keep_cp")).alias("a"), F.col("_keep").isNull().alias("b"), F.col("_keep").alias("id"), F.col("_salt").alias("salt"))).alias("_w"), F.sum("_size").alias("_n"))
    found = groups.join(F.broadcast(whole.withColumnRenamed("_sha", "_hot")), F.col("_sha") == F.col("_hot"), "left")
    is_hot = F.col("_hot").isNotNull()
    stays = F.when(is_hot, F.col("_salt") == F.col("_w.salt")).otherwise(True) & (F.col("_rank") == 1)
    return found.select(
        F.col("_id").alias(id_col), F.when(is_hot, F.col("_w.id")).otherwise(F.col("_keep")).alias("keep_id"), F.when(is_hot, F.col("_n")).otherwise(F.col("_size")).alias("group_size"),
        stays.alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the one row of each group that stays; its columns are unchanged."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    stay = copies(df, id_col, text_col).filter("kept").select(F.col(id_col).alias("_stay"), F.col("text_sha256").alias("_stay_sha"))
    keyed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("_sha"), F.length(body).alias("_cp"), F.xxhash64(body).alias("_sum"))
    found = keyed.join(stay, F.col("_id").eqNullSafe(F.col("_stay")) & (F.col("_sha") == F.col("_stay_sha")), "left_semi")
    # rows that repeat an id and its text are all found; the longest of them stays
    one = Window.partitionBy("_id", "_sha").orderBy(F.col("_cp").desc(), "_sum")
    return found.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").select("_row.*")


def op7_content_sort(spark, sf_dir: str) -> DataFrame:
    """Exact dedup of ``documents``."""
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id)
"""
