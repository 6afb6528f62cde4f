"""Capture by streams: an inbox of records, drained exactly once into the store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from threadloom.functions import text as T
from threadloom.store import Store

RECORD = StructType([StructField("source", StringType()), StructField("path", StringType()), StructField("mtime", LongType()), StructField("size", LongType())])


def records(spark: SparkSession, path: str, files_per_trigger: int = 10_000) -> DataFrame:
    """The inbox as a stream of JSON records."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(path)


def coalesced(batch: DataFrame) -> DataFrame:
    """The newest record of each file."""
    key = T.gen_id("hook", F.concat_ws(":", "source", "path"))
    return batch.filter("path is not null").groupBy(key.alias("key")).agg(F.max_by(F.struct("source", "path", "mtime", "size"), F.struct("mtime", "size")).alias("r")).select("key", "r.*")


def pending(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Records whose file has changed since ``state`` (key, mtime, size)."""
    return coalesced(batch).join(state.select("key", "mtime", "size"), ["key", "mtime", "size"], "left_anti")


def drain(spark: SparkSession, path: str, store: Store, parse: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, now: Callable[[], datetime] = datetime.now, once: bool = True) -> StreamingQuery:
    """Parses what the inbox names and ingests it. A batch that is run twice merges the same ids, so nothing doubles."""

    def batch(df: DataFrame, _: int) -> None:
        fresh = coalesced(df)
        if not fresh.isEmpty():
            store.ingest(parse(fresh), now())

    writer = records(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def frontier(pages: DataFrame, since, skew: str = "5 seconds") -> DataFrame:
    """Of listing pages (page, id, update_time), the rows up to and with the first page that reaches back to ``since``, each id once."""
    cut = F.lit(since).cast("timestamp_ntz") - F.expr(f"interval {skew}")
    last = pages.groupBy("page").agg(F.min("update_time").alias("oldest")).filter(F.col("oldest") < cut).agg(F.min("page").alias("p"))
    rows = pages.withColumn("_last", last.scalar()).filter(F.col("_last").isNull() | (F.col("page") <= F.col("_last")))
    return rows.groupBy("id").agg(F.max("update_time").alias("update_time")).filter(F.col("update_time") >= cut)


def changed_files(seen: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files (path, mtime) that are new or newer than those seen."""
    s = seen.select("path", F.col("mtime").alias("_m"))
    return listed.join(s, "path", "left").filter(F.col("_m").isNull() | (F.col("mtime") > F.col("_m"))).drop("_m")


def windowed(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``events`` by window and type, with a watermark: for batches and streams alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")
