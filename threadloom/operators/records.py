"""Records for replication: their logical form, attestation, acceptance, dirty sets and counters."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import replicate
from threadloom.runtime import share_code

# The fields of each table that are replicated, the fields that hold JSON, and those that hold times.
FIELDS = {
    "conversations": ("source", "title", "created_at", "updated_at", "model", "project_id", "metadata"),
    "messages": ("conversation_id", "role", "content", "thinking", "created_at", "model", "metadata", "parent_id"),
    "tool_calls": ("message_id", "tool_name", "input", "output", "status", "duration_ms", "created_at"),
    "attachments": ("message_id", "filename", "mime_type", "size", "body_hash", "created_at"),
    "artifacts": ("conversation_id", "artifact_type", "title", "content", "language", "created_at", "version"),
    "file_edits": ("message_id", "file_path", "edit_type", "content", "created_at", "old_content"),
}
JSON_FIELDS, TIME_FIELDS = ("metadata", "input", "output"), ("created_at", "updated_at")

_ROW = ["workspace", "kind", "row_id"]


def logical(rows: DataFrame, table: str) -> DataFrame:
    """id, canonical body and its hash: a table's replicated fields only, JSON parsed, times in ISO form to the microsecond.

    Local columns such as vectors and paths are left out; text that is no JSON in a JSON field stays text.
    """
    share_code(rows.sparkSession)
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    fields = [(time(F.col(c)) if c in TIME_FIELDS else F.col(c)).alias(c) for c in FIELDS[table]]
    nested = [c for c in FIELDS[table] if c in JSON_FIELDS]

    @F.pandas_udf("string")
    def body(ids: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for i, t in zip(ids, texts, strict=True):
            data = json.loads(t)
            for c in nested:
                try:
                    data[c] = json.loads(data[c]) if isinstance(data[c], str) else data[c]
                except ValueError:
                    continue
            out.append(json.dumps({"v": 1, "kind": table, "id": i, "state": "active", "data": data}, sort_keys=True, separators=(",", ":")))
        return pd.Series(out, dtype=object)

    whole = rows.select("id", body("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("body"))
    return whole.select("id", "body", F.sha2("body", 256).alias("content_hash"))


def attest(rows: DataFrame, proofs: DataFrame) -> DataFrame:
    """What each row (workspace, kind, row_id, author, content_hash) needs against the heads of its proofs.

    ``verdict`` is unchanged where a head has its hash, conflict where there are several others, else attest, with the
    head as ``previous_revision`` (null for a first proof).
    """
    key = [*_ROW, "author"]
    heads = replicate.leaves(proofs).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("revision").alias("_head"))
    # equality with any head is a join of its own, so that no list of heads is made
    same = replicate.leaves(proofs).select(*key, "content_hash").distinct().withColumn("_same", F.lit(True))
    verdict = F.when(F.col("_same"), "unchanged").when(F.col("_n") > 1, "conflict").otherwise("attest")
    out = rows.join(heads, key, "left").join(same, [*key, "content_hash"], "left").withColumn("verdict", verdict)
    return out.withColumn("previous_revision", F.when(F.col("verdict") == "attest", F.col("_head"))).drop("_n", "_head", "_same")


def proofs_for(origins: DataFrame, proofs: DataFrame) -> DataFrame:
    """Each physical row with its proof: the one that its origin names, or, for a row of one's own, any of its row id.

    ``origins``: row_id, proof_id (null for own rows). Two equi-joins instead of a condition with OR.
    """
    p = proofs.select(F.col("id").alias("proof_id"), F.col("row_id").alias("of_row"))
    named = origins.filter("proof_id is not null").join(p, "proof_id").select("row_id", "proof_id")
    own = origins.filter("proof_id is null").select("row_id").join(p, F.col("row_id") == F.col("of_row")).select("row_id", "proof_id")
    return named.unionByName(own)


def counters(proofs: DataFrame, queue: DataFrame) -> DataFrame:
    """A workspace's proofs and its queued, lazy and deferred events; 0 where it has none. ``queue``: workspace, state."""
    p = proofs.groupBy("workspace").agg(F.count(F.lit(1)).alias("proofs"))
    states = ("queued", "lazy", "deferred")
    q = queue.groupBy("workspace").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    return p.join(q, "workspace", "full_outer").select("workspace", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("proofs", *states)])


def acceptance(events: DataFrame, supported: DataFrame, lazy_over: int = 65536) -> DataFrame:
    """Events in their author's order with ``status``: accepted, lazy, deferred or waiting.

    An event waits while an earlier number of its author is missing (numbers begin with 1) or deferred. One whose kind
    and version aren't in ``supported`` is deferred until they are; one of more than ``lazy_over`` bytes is accepted
    without its body, which is fetched when it is read. Copies of a number count once.
    """
    known = supported.select("kind", "version").distinct().withColumn("_known", F.lit(True))
    e = events.dropDuplicates(["workspace", "author", "seq"]).join(F.broadcast(known), ["kind", "version"], "left")
    own = Window.partitionBy("workspace", "author").orderBy("seq")
    e = e.withColumn("_stuck", F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("_n", F.row_number().over(own))
    waits = (F.col("seq") != F.col("_n")) | (F.coalesce("_stuck", F.lit(0)) > 0)
    status = F.when(F.col("_known").isNull(), "deferred").when(waits, "waiting").when(F.col("bytes") > lazy_over, "lazy").otherwise("accepted")
    return e.withColumn("status", status).drop("_known", "_stuck", "_n")


def dirty(marks: DataFrame, done: DataFrame) -> DataFrame:
    """Ids that were marked after they were last done; marks and claims are appended, so a failed claim costs nothing.

    Both have id and ``at``. An id that was marked at the moment of its claim counts as dirty still.
    """
    last = lambda df, name: df.groupBy("id").agg(F.max("at").alias(name))
    both = last(marks, "marked").join(last(done, "finished"), "id", "left")
    return both.filter(F.col("finished").isNull() | (F.col("marked") >= F.col("finished"))).select("id", "marked")
