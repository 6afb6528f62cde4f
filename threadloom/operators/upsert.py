"""Additive upsert with history, and the change index."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadloom import schema
from threadloom.functions import text as T
from threadloom.runtime import share_code

#: Payload columns whose change makes a history row: all but these.
_NOT_PAYLOAD = ("id", "created_at")


@F.pandas_udf(StringType())
def _json_list(*columns: pd.Series) -> pd.Series:
    """Values as a JSON list, in the form that history ids are made of."""
    return pd.Series([json.dumps([None if pd.isna(v) else v for v in row], default=str) for row in zip(*columns, strict=True)], dtype=object)


def latest(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row an id: the last by ``order``, or else the last as they were read."""
    by = F.monotonically_increasing_id() if order is None else F.col(order)
    columns = [c for c in rows.columns if c != "id"]
    last = rows.select("id", F.struct(*columns).alias("r"), by.alias("_by")).groupBy("id").agg(F.max_by("r", "_by").alias("r"))
    return last.select(*[F.col("id") if c == "id" else F.col(f"r.{c}").alias(c) for c in rows.columns])


def conversations(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merged: times widen, model, cwd, branch and project keep what is known, the rest is overwritten."""
    both = current.select("id", F.struct(*current.columns).alias("o")).join(incoming.select("id", F.struct(*incoming.columns).alias("n")), "id", "full_outer")
    new = F.col("n").isNotNull()
    merged = {
        "created_at": F.least("o.created_at", "n.created_at"), "updated_at": F.greatest("o.updated_at", "n.updated_at"),
        **{c: F.coalesce(f"n.{c}", f"o.{c}") for c in ("model", "cwd", "git_branch", "project_id")},
        **{c: F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in ("source", "title", "metadata")},
    }
    return both.select("id", *[merged[f.name].alias(f.name) for f in schema.CONVERSATIONS if f.name != "id"])


def messages(current: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    """Merged: a changed message leaves its old version under a history id; a vector stays only while the content does."""
    share_code(current.sparkSession)
    cols = [f.name for f in schema.MESSAGES]
    both = current.select("id", F.struct(*cols).alias("o")).join(incoming.select("id", F.struct(*cols).alias("n")), "id", "full_outer")
    row = F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.col("o"))
    same = F.col("n.content").eqNullSafe(F.col("o.content"))
    vector = F.when(F.col("n").isNull(), F.col("o.embedding")).otherwise(F.when(same & F.col("o").isNotNull(), F.coalesce("n.embedding", "o.embedding")).otherwise(F.col("n.embedding")))
    live = both.select("id", *[(vector if c == "embedding" else row[c]).alias(c) for c in cols if c != "id"])
    differs = F.lit(False)
    for c in ("role", "content", "thinking"):
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    old = both.filter(F.col("n").isNotNull() & F.col("o").isNotNull() & differs).select("o.*")
    key = F.concat(F.lit("messages:"), "id", F.lit(":"), _json_list("role", "content", "thinking"))
    stamp = F.lit(json.dumps(now.isoformat()))
    meta = F.concat(F.regexp_replace(F.coalesce("metadata", F.lit("{}")), r"\}\s*$", ""), F.when(F.coalesce("metadata", F.lit("{}")).rlike(r"^\{\s*\}$"), "").otherwise(", "), F.lit('"history_of": "'), "id", F.lit('", "superseded_at": '), stamp, F.lit("}"))
    history = old.withColumn("metadata", meta).withColumn("id", T.gen_id("history", key)).select(*cols)
    return live.unionByName(history.join(current.select("id"), "id", "left_anti"))


def replace_preserving(current: DataFrame, incoming: DataFrame, table: str) -> DataFrame:
    """Merged: incoming rows replace, and a changed row's old version stays under a history id."""
    share_code(current.sparkSession)
    cols = current.columns
    payload = [c for c in cols if c not in _NOT_PAYLOAD]
    both = current.select("id", F.struct(*cols).alias("o")).join(incoming.select("id", F.struct(*cols).alias("n")), "id", "full_outer")
    live = both.select(F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.col("o")).alias("r")).select("r.*")
    differs = F.lit(False)
    for c in payload:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    old = both.filter(F.col("n").isNotNull() & F.col("o").isNotNull() & differs).select("o.*")
    key = F.concat(F.lit(f"{table}:"), "id", F.lit(":"), _json_list(*payload))
    history = old.withColumn("id", T.gen_id("history", key)).select(*cols)
    return live.select(*cols).unionByName(history.join(current.select("id"), "id", "left_anti"))


def changed(kind: str, before: DataFrame, after: DataFrame, generation: int) -> DataFrame:
    """Entities of ``kind`` that were added, changed or removed, under ``generation``."""
    digest = lambda df: df.select("id", F.xxhash64(*[c for c in df.columns if c != "id"]).alias("h"))
    a, b = digest(before).withColumnRenamed("h", "x"), digest(after).withColumnRenamed("h", "y")
    return a.join(b, "id", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select(F.lit(kind).alias("kind"), F.col("id").alias("entity"), F.lit(generation).cast("long").alias("generation"))


def index(changes: DataFrame) -> DataFrame:
    """The latest generation of each entity."""
    return changes.groupBy("kind", "entity").agg(F.max("generation").alias("generation"))


def since(changes: DataFrame, generation: int, kind: str, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``table`` holds of the entities that changed after ``generation``, and those it no longer has."""
    late = changes.filter((F.col("kind") == kind) & (F.col("generation") > generation)).select(F.col("entity").alias("id")).distinct()
    return table.join(late, "id", "left_semi"), late.join(table.select("id"), "id", "left_anti")


def backfill_times(conversations_: DataFrame, messages_: DataFrame) -> DataFrame:
    """Conversations whose missing times come from their messages."""
    seen = messages_.groupBy("conversation_id").agg(F.min("created_at").alias("_a"), F.max("created_at").alias("_b"))
    out = conversations_.join(seen, F.col("id") == F.col("conversation_id"), "left")
    return out.withColumn("created_at", F.coalesce("created_at", "_a")).withColumn("updated_at", F.coalesce("updated_at", "_b")).select(*conversations_.columns)
