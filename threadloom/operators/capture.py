"""Facts of provenance: made from edits and observed working copies, verified, compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import memory, redact
from threadloom.runtime import Scratch, share_code


def _texts(c: str):
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def observe(edits: DataFrame, checkouts: DataFrame, worktree: DataFrame, source: str = "sync") -> dict[str, DataFrame]:
    """Facts by kind, of edits (id, path, type, content, old, ts, turn) in observed working copies.

    ``checkouts``: root, repository, lineage, head, state_hash. ``worktree``: root, path below it, content_hash, dirty.
    An edit belongs to the longest root above its path; without one it has no repository and keeps its whole path. A
    checkpoint is linked to a file's last edit where the path is clean and the edit's text is the file's.
    """
    share_code(edits.sparkSession)
    scratch = Scratch(edits.sparkSession, "capture")
    roots = memory.scope_for(edits.select("path").distinct(), checkouts.select(F.col("root").alias("scope")))
    places = edits.join(roots.select("path", F.col("scope").alias("root")), "path", "left").join(checkouts.select("root", "repository"), "root", "left")
    below = F.when(F.col("root").isNotNull(), F.expr("substring(path, length(rtrim('/', root)) + 2)")).otherwise(F.col("path"))
    placed = places.withColumn("below", below).withColumn("file", T.identity(repository=F.col("repository"), path=F.col("below")))
    # the file's name is made by a Python worker: written once, as all facts start here
    placed = scratch.keep(placed.select("id", "turn", "ts", "root", "repository", "below", "file", "type", F.when(F.col("old").isNotNull(), _texts("old")).alias("old_content_hash"), _texts("content").alias("new_content_hash"), ((F.col("type") == "write") | F.col("old").isNotNull()).alias("exact")), "placed")
    used = checkouts.join(placed.select("root").distinct(), "root", "left_semi")
    files = placed.groupBy("file").agg(F.min("repository").alias("repository"), F.min("below").alias("path")).withColumnRenamed("file", "id")
    facts = placed.select("id", "turn", "file", "repository", "old_content_hash", "new_content_hash", F.when(F.col("exact"), "captured_exact").otherwise("content_unknown").alias("evidence"))
    last = placed.filter("root is not null").groupBy("root", "below", "file").agg(F.max_by(F.struct("id", "new_content_hash"), F.struct(F.coalesce("ts", F.lit("0001-01-01").cast("timestamp_ntz")), "id")).alias("e"))
    full = last.join(worktree.select("root", F.col("path").alias("below"), "content_hash", "dirty").filter("content_hash is not null"), ["root", "below"])
    points = used.select(T.identity(repository=F.col("repository"), head=F.col("head"), state=F.col("state_hash")).alias("id"), "root", "repository", "head", "state_hash", F.lit(source).alias("capture_source"))
    linked = full.filter(~F.col("dirty") & (F.col("e.new_content_hash") == F.col("content_hash"))).join(points.select("root", F.col("id").alias("checkpoint")), "root")
    return {
        "repository.observed": used.select(F.col("repository").alias("id"), "lineage", "head").dropDuplicates(["id"]),
        "file.observed": files,
        "file.version": full.select(T.identity(file=F.col("file"), content=F.col("content_hash")).alias("id"), "file", "content_hash").distinct(),
        "edit.observed": facts,
        "git.checkpoint": points.drop("root").distinct(),
        "checkpoint.link": linked.select(T.identity(checkpoint=F.col("checkpoint"), edit=F.col("e.id")).alias("id"), "checkpoint", F.col("e.id").alias("edit"), F.lit("full_content_match").alias("evidence")).distinct(),
    }


# The members that each kind's id is made of, and the columns they come from.
_IDENTITIES = {
    "file.observed": {"repository": "repository", "path": "path"},
    "file.version": {"file": "file", "content": "content_hash"},
    "git.checkpoint": {"repository": "repository", "head": "head", "state": "state_hash"},
    "checkpoint.link": {"checkpoint": "checkpoint", "edit": "edit"},
}


def verify(kind: str, facts: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Facts of a kind with ``valid``: their id is that of what they say, and an edit is of the turn that they name.

    ``edits`` (id, message_id) is needed for ``edit.observed`` only; an edit that isn't there is not valid.
    """
    share_code(facts.sparkSession)
    if kind in _IDENTITIES:
        made = T.identity(**{k: F.col(c) for k, c in _IDENTITIES[kind].items()})
        return facts.withColumn("valid", F.coalesce(F.col("id") == made, F.lit(False)))
    if kind == "edit.observed":
        known = edits.select("id", F.col("message_id").alias("_turn")).dropDuplicates(["id"])
        return facts.join(known, "id", "left").withColumn("valid", F.coalesce(F.col("turn") == F.col("_turn"), F.lit(False))).drop("_turn")
    if kind == "repository.observed":
        return facts.withColumn("valid", F.col("id").isNotNull())
    raise ValueError(f"unknown kind of fact: {kind}")


def checkpoint_diffs(checkpoints: DataFrame, versions: DataFrame) -> DataFrame:
    """Each checkpoint against the one before it in its repository: whether head and state moved, and the files that differ.

    ``checkpoints``: id, repository, head, state_hash, observed_at. ``versions``: checkpoint, path, content_hash. A file
    is added, deleted or modified. No files for a first checkpoint.
    """
    own = Window.partitionBy("repository").orderBy("observed_at", "id")
    pair = checkpoints.select("repository", "id", "head", "state_hash", F.lag(F.struct("id", "head", "state_hash")).over(own).alias("p")).filter("p is not null")
    pair = pair.select("repository", F.col("p.id").alias("before"), F.col("id").alias("after"), (~F.col("p.head").eqNullSafe(F.col("head"))).alias("head_changed"), (~F.col("p.state_hash").eqNullSafe(F.col("state_hash"))).alias("state_changed"))
    v = versions.select("checkpoint", "path", "content_hash")
    old = pair.join(v, F.col("before") == F.col("checkpoint")).select("repository", "before", "after", "path", F.col("content_hash").alias("a"), F.lit(None).cast("string").alias("b"))
    new = pair.join(v, F.col("after") == F.col("checkpoint")).select("repository", "before", "after", "path", F.lit(None).cast("string").alias("a"), F.col("content_hash").alias("b"))
    both = old.unionByName(new).groupBy("repository", "before", "after", "path").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    changed = both.withColumn("status", status).filter("status is not null").select("repository", "before", "after", "path", "status")
    return pair.join(changed, ["repository", "before", "after"], "left")


def live_state(checkouts: DataFrame, worktree: DataFrame, most: int = 80) -> DataFrame:
    """Each root's branch, head, subject and the first ``most`` lines of its status, without secrets: what a session is resumed with.

    A head on no branch is ``(detached)``; ``truncated`` says whether there are more lines, ``redactions`` how many of
    the texts held a secret.
    """
    own = Window.partitionBy("root").orderBy("path")
    # ranked before it is gathered: of any copy at most ``most`` lines and one more
    lines = worktree.filter("dirty").select("root", "path", F.concat_ws(" ", "status", "path").alias("line")).withColumn("n", F.row_number().over(own)).filter(F.col("n") <= most + 1)
    safe = redact.scrub(lines.withColumn("was", F.col("line")), "line")
    told = safe.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"), F.count_if((F.col("n") <= most) & (F.col("line") != F.col("was"))).alias("hidden"))
    top = redact.scrub(checkouts.select("root", "branch", "head", F.col("subject").alias("was"), "subject"), "subject")
    j = top.join(told, "root", "left")
    status = F.transform(F.slice(F.coalesce("l", F.array().cast(told.schema["l"].dataType)), 1, most), lambda x: x["line"])
    return j.select("root", F.coalesce("branch", F.lit("(detached)")).alias("branch"), "head", "subject", status.alias("status"), F.coalesce(F.size("l") > most, F.lit(False)).alias("truncated"), (F.coalesce("hidden", F.lit(0)) + F.coalesce((F.col("subject") != F.col("was")).cast("int"), F.lit(0))).alias("redactions"))
