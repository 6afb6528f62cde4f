"""The memory ledger as an append-only log of revisions, from which its state at any version, and a memory's history, follow.

A version is the rows that changed with it: sources, links and canonical memories, each by its id, or the word that a row
is gone. Nothing is rewritten when a version is added; a version counts once its mark is written, so a lost writer leaves
nothing half done. Actions are checked against the plan and applied in one version, or refused together.

Defined results: a row that is the same as before makes no revision. History has each text of a row once, when it was
first seen since the row was last gone. A version that was never marked is not there.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators import memory
from threadloom.runtime import delete, exists

#: What rows of each table have beside their id.
TABLES = {"sources": ("provider", "scope", "locator", "content", "hash", "active"), "links": ("canonical", "applied_hash"), "canonicals": ("scope", "hash", "content")}
_TYPES = {"active": "boolean"}
_FIELDS = sorted({c for columns in TABLES.values() for c in columns})
LOG = "version long, at timestamp_ntz, kind string, id string, gone boolean, " + ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in _FIELDS)


class Refused(ValueError):
    """Actions that may not be applied."""


def _keyed(rows: DataFrame, kind: str) -> DataFrame:
    """A table's rows as they stand in the log: a link's id is its source."""
    own = rows.withColumnRenamed("source", "id") if kind == "links" else rows
    return own.select("id", F.struct(*[(F.col(c) if c in TABLES[kind] else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in _FIELDS]).alias("row"))


def revisions(before: dict[str, DataFrame], after: dict[str, DataFrame], version: int, at: datetime) -> DataFrame:
    """The rows of a log by which ``after`` differs from ``before``; both have sources, links and canonicals."""
    parts = []
    for kind in TABLES:
        old, new = _keyed(before[kind], kind).withColumnRenamed("row", "old"), _keyed(after[kind], kind)
        both = old.join(new, "id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("row")))
        parts.append(both.select(F.lit(version).cast("long").alias("version"), F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(kind).alias("kind"), "id", F.col("row").isNull().alias("gone"), *[F.col(f"row.{c}").alias(c) for c in _FIELDS]))
    return reduce(DataFrame.unionByName, parts)


def state(log: DataFrame, version: int | None = None) -> dict[str, DataFrame]:
    """Sources, links and canonicals as they were at ``version``, or are."""
    seen = log if version is None else log.filter(F.col("version") <= version)
    last = seen.groupBy("kind", "id").agg(F.max_by(F.struct("gone", *_FIELDS), "version").alias("r")).filter(~F.col("r.gone"))
    one = lambda kind: last.filter(F.col("kind") == kind).select(F.col("id").alias("source" if kind == "links" else "id"), *[F.col(f"r.{c}").alias(c) for c in TABLES[kind]])
    return {kind: one(kind) for kind in TABLES}


def _since_gone(log: DataFrame) -> DataFrame:
    """What a log has of each row since it was last gone."""
    gone = log.filter("gone").groupBy("kind", "id").agg(F.max("version").alias("_gone"))
    return log.join(gone, ["kind", "id"], "left").filter(F.col("_gone").isNull() | (F.col("version") > F.col("_gone"))).drop("_gone")


def history(log: DataFrame) -> DataFrame:
    """Each text that a source or memory had: ``revision``, from 1, its hash and content, and when it was first seen."""
    texts = _since_gone(log.filter("kind in ('sources', 'canonicals')"))
    first = texts.groupBy("kind", "id", "hash").agg(F.min("version").alias("version"), F.min_by(F.struct("at", "content"), "version").alias("r"))
    return first.select("kind", "id", F.row_number().over(Window.partitionBy("kind", "id").orderBy("version")).alias("revision"), "hash", "r.content", "r.at", "version")


class Ledger:
    """A log in a folder: a folder for each version, and marks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        if not exists(self.spark, f"{self.path}/_done"):
            return 0
        return self.spark.read.schema("version long").parquet(f"{self.path}/_done").agg(F.max("version")).first()[0] or 0

    def log(self) -> DataFrame:
        """All revisions of versions that are marked."""
        if not self.version():
            return self.spark.createDataFrame([], LOG)
        # only marked folders are read
        done = [r["version"] for r in self.spark.read.schema("version long").parquet(f"{self.path}/_done").distinct().collect()]
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{v}" for v in sorted(done)])

    def state(self, version: int | None = None) -> dict[str, DataFrame]:
        return state(self.log(), version)

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{version}")
        self.spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{self.path}/_done")

    def commit(self, after: dict[str, DataFrame], at: datetime) -> int:
        """The next version, in which the ledger is ``after``; tables that it leaves out stay."""
        version, before = self.version() + 1, self.state()
        self._write(revisions(before, {**before, **after}, version, at), version)
        return version

    def apply(self, actions: DataFrame, at: datetime, made_from: str | None = None, scope: str | None = None) -> int:
        """Checks ``actions`` against the plan of now, applies them in one version, or raises ``Refused`` and writes nothing."""
        now = self.state()
        parts = now["sources"], now["links"], now["canonicals"]
        bad = memory.refused(actions, memory.plan(*parts, scope), now["canonicals"])
        told = [f"{r['source'] or r['canonical']}: {r['reason']}" for r in bad.orderBy("source", "canonical").limit(20).collect()]
        if told:
            raise Refused("; ".join(told))
        linked, canonicals = memory.apply(*parts, actions, made_from, scope)
        return self.commit({"links": linked, "canonicals": canonicals}, at)

    def erase(self) -> None:
        """Writes the log anew without what it has of rows from before they were gone, so that forgotten texts are in no version.

        The marks are changed last: a writer that is lost before leaves the old log whole. The old folders are then
        deleted.
        """
        last, log = self.version(), self.log()
        if not last:
            return
        gone = log.filter("gone").groupBy("kind", "id").agg(F.max("version").alias("_gone"))
        kept = log.join(gone, ["kind", "id"], "left").filter(F.col("_gone").isNull() | (F.col("version") >= F.col("_gone"))).drop("_gone")
        old = [r["version"] for r in self.spark.read.schema("version long").parquet(f"{self.path}/_done").distinct().collect()]
        kept.write.mode("overwrite").parquet(f"{self.path}/{last + 1}")
        self.spark.range(1).select(F.lit(last + 1).cast("long").alias("version")).write.mode("overwrite").parquet(f"{self.path}/_done")
        for version in old:
            delete(self.spark, f"{self.path}/{version}")
