"""Jump consistent hashing: stable keys to shards without a ring table.

Law ``key``: the id and the number of shards decide. When shards are appended, a row stays or moves into an
appended shard, and only the share that these need moves. Ids are mixed by xxhash64 first, since neighbouring
integers would otherwise start the generator from neighbouring states.

Defined results: a null text has no bytes, so size 1 and checksum 0; an empty one the same. A null id is a key
of its own. Repeated rows go to the same shard, in slots of their own. An empty table gives an empty result.
Extra columns are carried by ``assign``; working columns start with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.ranks import numbered
from threadloom.runtime import Scratch, share_code


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; Lamping and Veach's generator, over whole arrays."""
    key = keys.astype(np.uint64)
    bucket = np.zeros(len(key), np.int64)
    step = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = step[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        step[live] = ((bucket[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[step[live] < shards]
    return bucket


def shard_of(*keys: Column | str, shards: int) -> Column:
    """The shard of a row by its ``keys``."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(jump(x.to_numpy(np.int64), shards).astype(np.int32))

    return F.pandas_udf(of, "int")(F.xxhash64(*keys))


def assign(df: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard``, the shard when one more is appended."""
    share_code(df.sparkSession)
    return df.withColumn("shard", shard_of(id_col, shards=shards)).withColumn("grown_shard", shard_of(id_col, shards=shards + 1))


def op5_jump_hash(spark, sf_dir: str) -> DataFrame:
    """``documents`` to 8 shards by key, with a gapless slot in each shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # numbers only, written, as they are counted and numbered in two passes: texts are read once
    slim = Scratch(spark, "jump-hash").keep(docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")), "slim")
    dealt = assign(slim, 8)
    return numbered(dealt, ["shard"], ["doc_id", "size", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
