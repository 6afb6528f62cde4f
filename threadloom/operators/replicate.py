"""Replication: revision graphs, event sequences, votes, pages and access."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import folds
from threadloom.runtime import Scratch

_ROW = ["workspace", "kind", "row_id"]


def leaves(revisions: DataFrame) -> DataFrame:
    """Revisions that no other of their row and author names as the previous one; copies of a revision count once."""
    r = revisions.dropDuplicates([*_ROW, "author", "revision"])
    named = r.filter("previous_revision is not null").select(*_ROW, "author", F.col("previous_revision").alias("revision")).distinct()
    return r.join(named, [*_ROW, "author", "revision"], "left_anti")


def merge(revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with one leaf, to be projected, and rows with several, which conflict; in whatever order revisions came."""
    own = leaves(revisions).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*_ROW, "author")))
    conflicts = own.filter("_n > 1").groupBy(*_ROW, "author").agg(F.array_sort(F.collect_set("revision")).alias("revisions"))
    return own.filter("_n = 1").drop("_n"), conflicts


def lineage(spark, revisions: DataFrame, view: str = "_revisions") -> DataFrame:
    """Each leaf with the revisions it descends from and their distance: a recursive query, a join for each generation."""
    revisions.select(*_ROW, "author", "revision", "previous_revision").createOrReplaceTempView(view)
    leaves(revisions).select(*_ROW, "author", "revision").createOrReplaceTempView(f"{view}_leaves")
    return spark.sql(f"""
        WITH RECURSIVE up(workspace, kind, row_id, author, leaf, revision, distance) AS (
          SELECT workspace, kind, row_id, author, revision, revision, 0 FROM {view}_leaves
          UNION ALL
          SELECT u.workspace, u.kind, u.row_id, u.author, u.leaf, r.previous_revision, u.distance + 1 FROM up u JOIN {view} r
          ON r.workspace = u.workspace AND r.kind = u.kind AND r.row_id = u.row_id AND r.author = u.author AND r.revision = u.revision WHERE r.previous_revision IS NOT NULL
        ) SELECT * FROM up""")


def gaps(events: DataFrame) -> DataFrame:
    """Missing runs of each author's sequence, which begins with 1."""
    own = Window.partitionBy("workspace", "author").orderBy("seq")
    before = F.coalesce(F.lag("seq").over(own), F.lit(0))
    return events.select("workspace", "author", "seq").distinct().withColumn("_b", before).filter(F.col("seq") > F.col("_b") + 1).select("workspace", "author", (F.col("_b") + 1).alias("first_missing"), (F.col("seq") - 1).alias("last_missing"))


def heads(events: DataFrame) -> DataFrame:
    """Each author's latest event."""
    return events.groupBy("workspace", "author").agg(F.max("seq").alias("seq"), F.max_by("event", "seq").alias("event"))


def contradictions(events: DataFrame) -> DataFrame:
    """Sequence numbers under which an author published different events."""
    return events.groupBy("workspace", "author", "seq").agg(F.count_distinct("event").alias("events")).filter("events > 1")


def accept(copies: DataFrame) -> DataFrame:
    """Of copies of an object from several uploaders: one valid copy is enough; the least uploader's stays."""
    return copies.filter("valid").groupBy("object").agg(F.min_by("uploader", "uploader").alias("uploader"), F.min_by("body", "uploader").alias("body"))


def rewind(copies: DataFrame) -> DataFrame:
    """Where a pull starts again: before the first object without a valid copy."""
    bad = copies.groupBy("object").agg(F.max("valid").alias("ok"), F.min("cursor").alias("cursor")).filter(~F.col("ok"))
    return bad.agg((F.min("cursor") - 1).alias("cursor"))


def missing(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Ids to upload."""
    return local.select("id").join(remote.select("id"), "id", "left_anti")


def approved(votes: DataFrame, electorate: DataFrame) -> DataFrame:
    """Proposals that more than half of their electorate approve; one vote a user, the last."""
    last = votes.join(electorate.select("proposal", "user"), ["proposal", "user"], "left_semi").groupBy("proposal", "user").agg(F.max_by("approve", "cast_at").alias("approve"))
    n = electorate.select("proposal", "user").distinct().groupBy("proposal").agg(F.count(F.lit(1)).alias("electors"))
    yes = last.groupBy("proposal").agg(F.count_if("approve").alias("yes"))
    return n.join(yes, "proposal", "left").select("proposal", "electors", F.coalesce("yes", F.lit(0)).alias("yes"), (F.coalesce("yes", F.lit(0)) >= F.floor(F.col("electors") / 2) + 1).alias("approved"))


def page(rows: DataFrame, after: int, limit: int, size: int) -> DataFrame:
    """Rows beyond a cursor, at most ``limit`` and ``size`` bytes, but one at least; the limit comes before the running sum."""
    top = rows.filter(F.col("cursor") > after).orderBy("cursor").limit(limit)
    so_far = Window.orderBy("cursor").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("_sum", F.sum("bytes").over(so_far)).withColumn("_n", F.row_number().over(Window.orderBy("cursor"))).filter((F.col("_sum") <= size) | (F.col("_n") == 1)).drop("_sum", "_n")


def batches(rows: DataFrame, by: list[str], limit: int = 500, size: int = 8 << 20) -> DataFrame:
    """``rows`` with ``batch``: of at most ``limit`` rows and ``size`` bytes within each key, a larger row alone.

    Each batch begins where the one before is full. Within what a task has read, sums tell where the next one begins,
    so a batch is one look-up and not a row at a time.
    """

    def step(state: tuple[int, int, int], part: pd.DataFrame):
        batch, n, total = state
        sizes = part["bytes"].to_numpy(np.int64)
        sums, out, at = np.concatenate([[0], np.cumsum(sizes)]), np.empty(len(sizes), np.int64), 0
        while at < len(sizes):
            # how many more this batch takes: by rows, by bytes, and one at least if it is empty
            fits = int(np.searchsorted(sums, sums[at] + size - total, side="right")) - 1 - at
            take = min(limit - n, max(fits, 0)) if n else min(limit, max(fits, 1))
            take = min(take, len(sizes) - at)
            out[at : at + take] = batch
            n, total, at = n + take, total + int(sums[at + take] - sums[at]), at + take
            if at < len(sizes):
                batch, n, total = batch + 1, 0, 0
        return (batch, n, total), part.assign(batch=out)

    return folds.ordered(rows, by, ["id"], rows.schema.simpleString()[7:-1] + ",batch:long", lambda key: (0, 0, 0), step)


def admitted(objects: DataFrame, allowed: int) -> DataFrame:
    """Which objects (user, epoch, object, bytes, cursor) a user's store takes: in order of cursor, each that still fits into ``allowed``.

    What doesn't fit is refused, and a later, smaller one may still be taken, so no running sum tells. An object that is
    sent again is the same one: the first sending counts, and each epoch has a store of its own, whose objects count
    towards the user's sum. ``used`` is the user's sum after it.
    """
    first = objects.groupBy("user", "epoch", "object").agg(F.min(F.struct("cursor", F.col("bytes").cast("long").alias("bytes"))).alias("f")).select("user", "epoch", "object", F.col("f.cursor").alias("cursor"), F.col("f.bytes").alias("bytes"))

    def step(used: int, part: pd.DataFrame):
        taken, sums = [], []
        for b in part["bytes"].tolist():
            fits = used + b <= allowed
            used += b if fits else 0
            taken.append(fits)
            sums.append(used)
        return used, part.assign(admitted=taken, used=sums)

    return folds.ordered(first, ["user"], ["cursor", "epoch", "object"], first.schema.simpleString()[7:-1] + ",admitted:boolean,used:long", lambda key: 0, step)


def ancestry(revisions: DataFrame) -> DataFrame:
    """Each leaf with all revisions that it descends from, and their distance: by pointers that double, so a chain of n takes log n joins.

    A revision that isn't there ends a chain; a ring, which has no leaf, isn't met.
    """
    key = [*_ROW, "author"]
    scratch = Scratch(revisions.sparkSession, "ancestry")
    have = revisions.select(*key, "revision", "previous_revision").distinct()
    there = have.select(*key, F.col("revision").alias("up")).distinct()
    jump = scratch.keep(have.filter("previous_revision is not null").withColumnRenamed("previous_revision", "up").join(there, [*key, "up"], "left_semi").select(*key, "revision", "up"), "jump0")
    met = scratch.keep(leaves(revisions).select(*key, F.col("revision").alias("leaf"), "revision", F.lit(0).cast("long").alias("distance")), "met0")
    k, size = 0, met.count()
    while True:
        further = met.join(jump, [*key, "revision"]).select(*key, "leaf", F.col("up").alias("revision"), (F.col("distance") + (1 << k)).alias("distance"))
        met = scratch.keep(met.unionByName(further).groupBy(*key, "leaf", "revision").agg(F.min("distance").alias("distance")), f"met{k + 1}")
        if (now := met.count()) == size:
            return met
        size = now
        jump = scratch.keep(jump.join(jump.select(*key, F.col("revision").alias("up"), F.col("up").alias("_far")), [*key, "up"]).select(*key, "revision", F.col("_far").alias("up")).distinct(), f"jump{k + 1}")
        k += 1


def _walked(have: DataFrame) -> DataFrame:
    """The lineage of each leaf (key, revision, _lineage) of ``have`` (key, revision, previous_revision): a row's revisions meet in one task, which goes up from its leaves."""
    key = [*_ROW, "author"]

    def step(state: tuple[tuple, dict[str, list[str]]], part: pd.DataFrame):
        for r, p in zip(part["revision"], part["previous_revision"], strict=True):
            ups = state[1].setdefault(r, [])
            if p is not None and p not in ups:
                ups.append(p)
        return state, None

    def end(state: tuple[tuple, dict[str, list[str]]]) -> pd.DataFrame | None:
        own, ups = state
        named, told = {p for x in ups.values() for p in x}, []
        for leaf in ups.keys() - named:
            line, seen, level = [], {leaf}, [leaf]
            while level := sorted({p for r in level for p in ups[r] if p in ups and p not in seen}):
                seen.update(level)
                line += level
            if line:
                told.append((*own, leaf, line))
        return pd.DataFrame(told, columns=[*key, "revision", "_lineage"]) if told else None

    return folds.ordered(have, key, [], ",".join(f"{k} string" for k in [*key, "revision"]) + ",_lineage array<string>", lambda own: (own, {}), step, end)


def lineages(revisions: DataFrame, longest: int = 4096) -> DataFrame:
    """Each leaf that descends from others (key, revision) with ``_lineage``, nearest first.

    What is shuffled is the revisions, once, and not each pair of a leaf and an ancestor again and again. A row of more
    than ``longest`` revisions isn't held by one task: its pairs come by ``ancestry``.
    """
    key = [*_ROW, "author"]
    have = Scratch(revisions.sparkSession, "lineages").keep(revisions.select(*key, "revision", "previous_revision").filter("revision is not null"), "have")
    long = have.groupBy(*key).count().filter(F.col("count") > longest).select(*key)
    if long.isEmpty():
        return _walked(have)
    pairs = ancestry(have.join(long, key, "left_semi")).filter("distance > 0").groupBy(*key, F.col("leaf").alias("revision")).agg(F.array_sort(F.collect_list(F.struct("distance", "revision"))).alias("_l"))
    return _walked(have.join(long, key, "left_anti")).unionByName(pairs.select(*key, "revision", F.transform("_l", lambda x: x["revision"]).alias("_lineage")))


def replica_feed(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """What is to be sent of each row that is there, or has revisions: ``action``, the head, and the ``lineage`` it is sent with.

    ``rows``: workspace, kind, row_id, author, content_hash. A head of the row's hash is sent as it is (replica); of
    another it is to be attested first (attest, also where there is none); a row that went is sent as a tombstone
    after its head, unless the head is one; several heads are a conflict, one row each. ``lineage`` has the revisions
    before the head, nearest first, and for a tombstone the head first.
    """
    key = [*_ROW, "author"]
    back = lineages(revisions)
    own = leaves(revisions).select(*key, "revision", F.col("content_hash").alias("_hash"), F.coalesce("state", F.lit("active")).alias("_state"))
    own = own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).join(back, [*key, "revision"], "left")
    both = rows.select(*key, "content_hash", F.lit(True).alias("_there")).join(own, key, "full_outer")
    action = F.when(F.col("_n") > 1, "conflict").when(F.col("_there").isNull(), F.when(F.col("_state") == "deleted", "replica").otherwise("tombstone"))
    action = action.when(F.col("content_hash").eqNullSafe(F.col("_hash")) & (F.col("_state") == "active"), "replica").otherwise("attest")
    told = both.withColumn("action", action).withColumn("_lineage", F.coalesce("_lineage", F.array().cast("array<string>")))
    return told.select(*key, "action", F.col("revision").alias("head"), F.when(F.col("action") == "tombstone", F.concat(F.array("revision"), "_lineage")).otherwise(F.col("_lineage")).alias("lineage"))


def readable(replicas: DataFrame, members: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Replicas that a device may read: of an epoch that its member's history reaches, and for which it holds a key."""
    own = members.select("workspace", "user", "device", "history_from")
    seen = replicas.join(own, "workspace").filter(F.col("epoch") >= F.col("history_from"))
    return seen.join(envelopes.select("workspace", "device", "epoch").distinct(), ["workspace", "device", "epoch"], "left_semi")


def quota(objects: DataFrame, allowed: int) -> DataFrame:
    """Bytes stored by each user, objects once each, and whether that is within ``allowed``."""
    return objects.dropDuplicates(["user", "object"]).groupBy("user").agg(F.sum("bytes").alias("bytes")).withColumn("within", F.col("bytes") <= allowed)


def team_scope(conversations: DataFrame, messages: DataFrame, edits: DataFrame, roots: DataFrame) -> DataFrame:
    """Conversations that touch a team's directories: by their own, or by any edited file. Paths meet roots by their ancestors."""

    def ups(c: Column):
        parts = F.split(c, "/")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.coalesce(F.nullif(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("")), F.lit("/"))))

    own = roots.select(T.normal_path(F.col("root")).alias("up")).distinct()
    by_cwd = conversations.filter("cwd is not null").select("id", ups(T.normal_path(F.col("cwd"))).alias("up")).join(own, "up", "left_semi").select("id")
    edited = edits.select("message_id", ups(T.normal_path(F.col("file_path"))).alias("up")).join(own, "up", "left_semi").select(F.col("message_id").alias("mid")).distinct()
    by_edit = messages.join(edited, F.col("id") == F.col("mid"), "left_semi").select(F.col("conversation_id").alias("id"))
    return by_cwd.union(by_edit).distinct()


def foreign(rows: DataFrame, workspace: str, user: str, table: str, keys: dict[str, str]) -> DataFrame:
    """``rows`` with ids mapped into another's namespace; ``keys`` names the table that each id column points into."""
    out = rows
    for column, target in {"id": table, **keys}.items():
        out = out.withColumn(column, F.when(F.col(column).isNotNull(), F.substring(F.sha2(F.concat_ws(":", F.lit(workspace), F.lit(user), F.lit(target), F.col(column)), 256), 1, 16)))
    return out


def proof(rows: DataFrame, key: bytes, payload: str) -> DataFrame:
    """``rows`` with ``mac``, an HMAC-SHA256 of ``payload``: the default signer."""

    @F.pandas_udf("string")
    def mac(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return rows.withColumn("mac", mac(F.col(payload)))


def seal(rows: DataFrame, column: str, key: bytes) -> DataFrame:
    """``column`` encrypted by AES-GCM, within the JVM."""
    return rows.withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), F.lit(key)))


def unseal(rows: DataFrame, column: str, key: bytes) -> DataFrame:
    """The reverse of ``seal``."""
    return rows.withColumn(column, F.aes_decrypt(F.col(column), F.lit(key)).cast("string"))
