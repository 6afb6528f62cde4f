"""Memories as files, one a scope: their text, whether what is there is what was written, and writing and removing them."""

from __future__ import annotations

import hashlib
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import folds, memory
from threadloom.runtime import Scratch, delete, exists

#: What a file begins with.
HEAD = "<!-- memory projection:v1 -->\n# Synchronized memories"


def pieces(canonicals: DataFrame) -> DataFrame:
    """Lines of text (scope, place, text) that make each scope's file: its head, and its memories by id.

    ``canonicals``: id, scope, hash and content. A piece is a row, so a scope of any size is never together; written in
    order of place, each with a line feed behind it, they are the file. Memories without an id or a scope are in no file,
    and of several of one id in a scope any one is.
    """
    own = canonicals.filter("id is not null and scope <> ''").dropDuplicates(["scope", "id"])
    body = F.concat(F.lit("\n<!-- canonical:"), "id", F.lit(" revision:"), F.coalesce("hash", F.lit("")), F.lit(" -->\n## "), "id", F.lit("\n\nScope: `"), "scope", F.lit("`\n\n"), F.coalesce("content", F.lit("")))
    rows = own.select("scope", F.col("id").alias("place"), body.alias("text"))
    return own.select("scope").distinct().select("scope", F.lit("").alias("place"), F.lit(HEAD).alias("text")).unionByName(rows)


def digests(of: DataFrame) -> DataFrame:
    """scope, the SHA-256 of its file and its size in bytes, in one ordered pass that holds a piece at a time."""

    def more(state: tuple, part: pd.DataFrame) -> tuple:
        scope, sha, size = state
        for text in part["text"]:
            raw = text.encode() + b"\n"
            sha.update(raw)
            size += len(raw)
        return (scope, sha, size), None

    end = lambda s: pd.DataFrame({"scope": [s[0]], "wanted_hash": [s[1].hexdigest()], "bytes": [s[2]]})
    return folds.ordered(of, ["scope"], ["place"], "scope string, wanted_hash string, bytes long", lambda key: (key[0], hashlib.sha256(), 0), more, end)


def _scope() -> Column:
    """The scope that a file's path names, as Spark writes it into a folder's name."""
    return F.url_decode(F.replace(F.regexp_extract("path", "/scope=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))


class Projections:
    """Files under ``path``, in a folder a scope, and beside them a log of what was written there.

    On a local disk Hadoop lays a checksum beside each file: whoever edits a file there must delete it, or its read fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files, self.log = f"{self.path}/files", f"{self.path}/log"

    def _raw(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(self.files)

    def disk(self) -> DataFrame:
        """scope and ``disk_hash``, the SHA-256 of the file that is there."""
        if not exists(self.spark, self.files):
            return self.spark.createDataFrame([], "scope string, disk_hash string")
        return self._raw().select(_scope().alias("scope"), F.sha2("content", 256).alias("disk_hash"))

    def recorded(self) -> DataFrame:
        """scope and ``recorded_hash``, of each scope's last entry; removed ones have none."""
        if not exists(self.spark, self.log):
            return self.spark.createDataFrame([], "scope string, recorded_hash string")
        log = self.spark.read.schema("scope string, hash string, at timestamp_ntz").parquet(self.log)
        return log.groupBy("scope").agg(F.max_by(F.struct("hash"), "at").alias("r")).select("scope", F.col("r.hash").alias("recorded_hash")).filter("recorded_hash is not null")

    def status(self, canonicals: DataFrame, pending: DataFrame | None = None) -> DataFrame:
        """Each scope's wanted, recorded and present hash with ``status``.

        pending: a source of the scope (``pending``: scope) waits to be reconciled; else as ``memory.projection_status``.
        """
        both = digests(pieces(canonicals)).join(self.recorded(), "scope", "left").join(self.disk(), "scope", "left")
        out = memory.projection_status(both)
        if pending is None:
            return out
        waits = pending.select("scope").distinct().withColumn("_waits", F.lit(True))
        return out.join(waits, "scope", "left").withColumn("status", F.when(F.col("_waits"), "pending").otherwise(F.col("status"))).drop("_waits")

    def write(self, canonicals: DataFrame, now: datetime, pending: DataFrame | None = None) -> DataFrame:
        """Writes the files that are to be created or updated, no others, and gives ``status`` as it was before.

        A scope's lines are sorted and written by one task as they come. Drifted files stay as they are.
        """
        found = Scratch(self.spark, "projection").keep(self.status(canonicals, pending), "status")
        due = found.filter("status in ('create', 'update')")
        rows = pieces(canonicals).join(due.select("scope"), "scope", "left_semi")
        if not due.isEmpty():
            rows.repartition("scope").sortWithinPartitions("scope", "place").select("scope", "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").text(self.files)
            due.select("scope", F.col("wanted_hash").alias("hash"), F.lit(now).cast("timestamp_ntz").alias("at")).write.mode("append").parquet(self.log)
        return found

    def remove(self, scope: str, now: datetime) -> str:
        """Removes a scope's file: removed, or absent; one that isn't owned or has drifted is an error and stays."""
        there = self.disk().filter(F.col("scope") == scope).first()
        wrote = self.recorded().filter(F.col("scope") == scope).first()
        if there is not None and (wrote is None or wrote["recorded_hash"] != there["disk_hash"]):
            raise ValueError(f"the file of {scope} {'has drifted' if wrote else 'was not written from here'}: it stays")
        if there is not None:
            delete(self.spark, self._raw().select("path").filter(_scope() == scope).first()["path"])
        if wrote is not None:
            self.spark.createDataFrame([(scope, None, now)], "scope string, hash string, at timestamp_ntz").write.mode("append").parquet(self.log)
        return "absent" if there is None else "removed"
