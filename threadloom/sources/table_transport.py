"""A transport that answers from a table of replies, for services that were recorded or are simulated by Spark."""

from __future__ import annotations

import time

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.runtime import Scratch
from threadloom.sources.paged import OVERLAP, PAGE

# Bytes of a row group that ``record`` writes, and row groups that a transport holds.
GROUP, HELD = 1 << 20, 4


class TableTransport:
    """Replies from Parquet files of ``url`` and ``body``, and perhaps ``size``, the url's length; a url that isn't there is a 404.

    A request reads the row groups whose least and greatest url and size it lies between, and the last few stay: files
    as ``record`` writes them, asked in their order, are read once. Files in any other order are right as well, but slower.
    The clock runs only by what is slept, so that a recorded service isn't waited for.
    """

    def __init__(self, path: str):
        self.clock, self.started = 0.0, time.monotonic()
        self.groups = [g for f in ds.dataset(path, format="parquet").get_fragments() for g in f.split_by_row_group()]
        told = [g.row_groups[0].statistics for g in self.groups]
        bounds, sizes = [t.get("url") or {} for t in told], [t.get("size") or {} for t in told]
        self.least, self.most = (np.array([b.get(k) for b in bounds], dtype=object) for k in ("min", "max"))
        self.short, self.long = np.array([b.get("min", 0) for b in sizes], np.int64), np.array([b.get("max", 1 << 62) for b in sizes], np.int64)
        # row groups without bounds are read for every url
        self.open = np.array([b.get("min") is None or b.get("max") is None for b in bounds], dtype=bool)
        self.least[self.open] = self.most[self.open] = ""
        self.held: dict[int, dict[str, str]] = {}

    def _bodies(self, group: int) -> dict[str, str]:
        if group in self.held:
            self.held[group] = self.held.pop(group)
        else:
            if len(self.held) >= HELD:
                del self.held[next(iter(self.held))]
            t = self.groups[group].to_table(columns=["url", "body"])
            self.held[group] = dict(zip(t["url"].to_pylist(), t["body"].to_pylist(), strict=True))
        return self.held[group]

    def get(self, url: str) -> tuple[int, dict, str]:
        near = (self.short <= len(url)) & (self.long >= len(url))
        for group in np.flatnonzero(near & (self.open | ((self.least <= url) & (self.most >= url)))).tolist():
            if (body := self._bodies(group).get(url)) is not None:
                return (200, {}, body)
        return (404, {}, "")

    def now(self) -> float:
        return self.clock

    def sleep(self, seconds: float) -> None:
        self.clock += seconds


def make(options: dict[str, str]) -> TableTransport:
    """The transport of the option ``replies``, a path."""
    return TableTransport(options["replies"])


def _listed(items: DataFrame) -> DataFrame:
    """``items`` with ``n``, their place from 0 on, newest first: sorted in ranges, each of which begins after the counts of those before."""
    newest = [F.col("update_time").desc(), F.col("id")]
    # ranges are drawn by a sample, so they are written before they are counted
    dealt = Scratch(items.sparkSession, "listing").keep(items.repartitionByRange(*newest).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*newest)) - 1
    return dealt.withColumn("_at", own).join(F.broadcast(starts), "_range").withColumn("n", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def replies(items: DataFrame, base: str = "") -> DataFrame:
    """``url`` and ``body`` of a service that lists ``items`` (id, update_time in seconds, title, detail) in overlapping pages, newest first."""
    step = PAGE - OVERLAP
    total = items.count()
    first = F.greatest(F.ceil((F.col("n") - PAGE + 1) / step), F.lit(0))
    line = _listed(items.select("id", "update_time", "title"))
    dealt = line.withColumn("page", F.explode(F.sequence(first, F.floor(F.col("n") / step)))).filter((F.col("page") == 0) | (F.col("page") * step + OVERLAP < total))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n", "id", "update_time", "title"))), lambda x: F.struct(x["id"].alias("id"), x["update_time"].alias("update_time"), x["title"].alias("title")))
    pages = dealt.groupBy("page").agg(rows.alias("items")).withColumn("total", F.lit(total))
    if not total:  # a service that has nothing still answers with its first page
        pages = items.sparkSession.range(1).select(F.col("id").alias("page"), F.array().cast(pages.schema["items"].dataType).alias("items"), F.lit(0).alias("total"))
    listing = pages.select(F.concat(F.lit(f"{base}/backend-api/conversations?offset="), (F.col("page") * step).cast("string"), F.lit(f"&limit={PAGE}&order=updated")).alias("url"), F.to_json(F.struct("items", "total")).alias("body"))
    details = items.select(F.concat(F.lit(f"{base}/backend-api/conversation/"), "id").alias("url"), F.col("detail").alias("body"))
    return listing.unionByName(details)


def record(answers: DataFrame, path: str) -> None:
    """Writes ``url`` and ``body`` for ``make``: in order of length, then text, so that pages stand in the order of their numbers, and in small row groups."""
    order = [F.col("size"), F.col("url")]
    answers.withColumn("size", F.length("url")).repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(path)
