"""Gapless numbers within groups, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within each value of ``keys``, which must not be null.

    Rows of a key are dealt to ``parts`` buckets by a hash of ``order``; a bucket's first number is the sum of the
    counts of the buckets before it. So a key with most of the rows is numbered by ``parts`` tasks. Rows that agree
    in all of ``order`` take numbers in any order, so ``order`` should hold all that tells rows apart.
    """
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = dealt.withColumn("_rn", F.row_number().over(own) - 1)
    return local.join(starts, [*keys, "_bucket"]).withColumn(name, (F.col("_start") + F.col("_rn")).cast("long")).select(*df.columns, name)
