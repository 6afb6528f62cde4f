"""The archive: its tables as DataFrames, and the filters that all readers share."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.functions import text as T


class NotOne(ValueError):
    """A prefix that names no row, or several."""


class Archive:
    """Six tables; those not given are empty."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        self.spark = spark
        for name, shape in schema.TABLES.items():
            found = tables.get(name)
            if found is None:
                found = spark.createDataFrame([], shape)
            else:
                missing = [f for f in shape if f.name not in found.columns]
                found = found.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]) if missing else found
            setattr(self, name, found)

    def filtered(self, source: str | None = None, days: int | None = None, role: str | None = None, cwd: str | None = None, conversation: str | None = None, now: datetime | None = None) -> DataFrame:
        """Messages with their conversation's title, source and cwd, as far as the filters let them; without vectors.

        ``days`` is strict, counts from ``now`` and leaves out messages without a time.
        """
        c = self.conversations
        if source:
            c = c.filter(F.col("source") == source)
        if cwd:
            c = c.filter(T.under(F.col("cwd"), cwd))
        if conversation:
            c = c.filter(F.col("id").startswith(conversation))
        m = self.messages.drop("embedding", "model", "parent_id")
        if role:
            m = m.filter(F.col("role") == role)
        if days:
            m = m.filter(F.col("created_at") > F.lit((now or datetime.now()) - timedelta(days=days)).cast("timestamp_ntz"))
        return m.join(c.select(F.col("id").alias("conversation_id"), "title", "source", "cwd", "updated_at"), "conversation_id")

    def one(self, df: DataFrame, prefix: str, what: str, order=None) -> str:
        """The id that starts with ``prefix``; two rows at most reach the driver."""
        found = df.filter(F.col("id").startswith(prefix))
        rows = (found.orderBy(order) if order is not None else found).select("id").limit(2).collect()
        if len(rows) != 1:
            raise NotOne(f"no matching {what}" if not rows else f"ambiguous {what}: " + ", ".join(r["id"] for r in rows))
        return rows[0]["id"]
