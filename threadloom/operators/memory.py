"""The memory ledger: sources, canonical memories, plans and reconciliation."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T


class StalePlan(ValueError):
    """The ledger has moved on since the plan was made."""


def scan(known: DataFrame, found: DataFrame, providers: list[str], scope: str | None = None) -> DataFrame:
    """Sources after a scan: those of the scanned providers that were not found are inactive, the rest carry what was found."""
    f = found.groupBy("provider", "scope", "locator").agg(F.max("content").alias("content")).select(T.gen_id("provider", F.concat_ws(":", "provider", "scope", "locator")).alias("id"), "provider", "scope", "locator", "content", F.sha2("content", 256).alias("hash"), F.lit(True).alias("active"))
    seen = F.col("o.provider").isin(providers)
    if scope is not None:
        seen = seen & (F.col("o.scope") == scope)
    cols = f.columns
    both = known.select("id", F.struct(*cols).alias("o")).join(f.select("id", F.struct(*cols).alias("n")), "id", "full_outer")
    row = F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.col("o"))
    active = F.when(F.col("n").isNotNull(), True).otherwise(F.when(seen, False).otherwise(F.col("o.active")))
    return both.select("id", *[(active if c == "active" else row[c]).alias(c) for c in cols if c != "id"])


def plan(sources: DataFrame, links: DataFrame, canonicals: DataFrame, scope: str | None = None) -> DataFrame:
    """Pending sources and their kind: missing, collision, exact, unlinked or changed, the first that fits."""
    s = sources if scope is None else sources.filter(F.col("scope") == scope)
    linked = s.join(links.select(F.col("source").alias("id"), "canonical", "applied_hash"), "id", "left")
    exact = canonicals.groupBy(F.col("scope").alias("scope"), "hash").agg(F.min("id").alias("exact"))
    # a moved source: the same locator and content under another id; the least of the others is one of the least two
    alike = ["provider", "locator", "hash"]
    least = sources.filter("active").select(*alike, "id").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*alike).orderBy("id"))).filter("_k <= 2")
    twins = least.groupBy(*alike).agg(F.array_sort(F.collect_list("id")).alias("_twins"))
    open_ = (F.col("active") & (F.col("canonical").isNull() | (F.col("applied_hash") != F.col("hash")))) | (~F.col("active") & F.col("canonical").isNotNull())
    collisions = linked.filter(F.col("active") & (F.col("applied_hash") != F.col("hash"))).groupBy("canonical").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("canonical", F.lit(True).alias("_collides"))
    rows = linked.filter(open_).join(exact, ["scope", "hash"], "left").join(twins, ["provider", "locator", "hash"], "left").join(collisions, "canonical", "left")
    kind = F.when(~F.col("active"), "missing").when(F.col("_collides"), "collision").when(F.col("canonical").isNull() & F.col("exact").isNotNull(), "exact").when(F.col("canonical").isNull(), "unlinked").otherwise("changed")
    return rows.select(F.col("id").alias("source"), "provider", "scope", "locator", "hash", kind.alias("kind"), "canonical", F.col("exact").alias("suggested"), F.get(F.filter("_twins", lambda x: x != F.col("id")), F.lit(0)).alias("replacement"))


def token(sources: DataFrame, links: DataFrame, canonicals: DataFrame, scope: str | None = None) -> str:
    """What a plan was made from: sums of the rows' digests, so that a ledger of any size is added up where it lies."""

    def part(df: DataFrame, *cols: str) -> DataFrame:
        h = df.select(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256).alias("h"))
        # 15 hex digits fit into a long, and their sums into 38 decimal digits
        sums = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(4)]
        return h.agg(F.count(F.lit(1)).cast("string").alias("n"), *sums)

    keep = (lambda df: df) if scope is None else (lambda df: df.filter(F.col("scope") == scope))
    own = keep(sources)
    found = [part(own, "id", "hash", "active"), part(links.join(own.select(F.col("id").alias("source")), "source", "left_semi"), "source", "canonical", "applied_hash"), part(keep(canonicals), "id", "hash")]
    return hashlib.sha256(json.dumps([2, scope, *[list(p.first()) for p in found]]).encode()).hexdigest()[:20]


def reconcile(pending: DataFrame, linked_scopes: DataFrame) -> DataFrame:
    """What needs no judgement: detach what moved, link what is the same, merge alike unlinked ones, and found a lone first memory.

    ``linked_scopes`` (scope, hash) has the canonicals there are.
    """
    detach = pending.filter("kind = 'missing' and replacement is not null").select("source", F.lit("detach").alias("action"), F.lit(None).cast("string").alias("canonical"))
    same = pending.filter("kind = 'exact'").select("source", F.lit("same").alias("action"), F.col("suggested").alias("canonical"))
    alike = Window.partitionBy("scope", "hash")
    lone = Window.partitionBy("scope")
    unlinked = pending.withColumn("_open", F.count(F.lit(1)).over(lone)).filter("kind = 'unlinked'").withColumn("_n", F.count(F.lit(1)).over(alike)).join(linked_scopes.select("scope", F.lit(True).alias("_has")).distinct(), "scope", "left")
    name = F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws(":", "scope", "hash"), 256), 1, 16))
    merged = unlinked.filter("_n > 1").select("source", F.lit("merge").alias("action"), name.alias("canonical"))
    first = unlinked.filter("_n = 1 and _open = 1 and _has is null").select("source", F.lit("distinct").alias("action"), name.alias("canonical"))
    return detach.unionByName(same).unionByName(merged).unionByName(first)


def _actions(actions: DataFrame) -> DataFrame:
    """``actions`` with all columns: source, action, canonical, hash and content."""
    return actions.select(*[(F.col(c) if c in actions.columns else F.lit(None)).cast("string").alias(c) for c in ("source", "action", "canonical", "hash", "content")])


def apply(sources: DataFrame, links: DataFrame, canonicals: DataFrame, actions: DataFrame, made_from: str | None = None, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Links and canonicals after ``actions`` (source, action, canonical): detach, same, merge, distinct, scoped, supersedes, revise or unresolved.

    ``scoped`` founds a memory as ``distinct`` does, ``supersedes`` puts the source's text in place of an existing
    memory's, and ``revise``, which has no source but ``hash`` and ``content``, a new text in place of that hash's.
    ``made_from`` is the plan's token; a ledger that has changed since is left alone. Nothing is written: the frames are
    the preview, and a caller that stores them has applied it. ``ledger.Ledger.apply`` asks ``refused`` first.
    """
    if made_from is not None and token(sources, links, canonicals, scope) != made_from:
        raise StalePlan("stale plan: the ledger has changed")
    told = _actions(actions).filter("action <> 'unresolved'")
    does = told.filter("source is not null").select("source", "action", "canonical").join(sources.select(F.col("id").alias("source"), "scope", "hash", "content"), "source")
    kept = links.join(does.select("source"), "source", "left_anti")
    linked = kept.unionByName(does.filter("action <> 'detach'").select("source", "canonical", F.col("hash").alias("applied_hash")))
    written = does.filter("action in ('merge', 'distinct', 'scoped', 'supersedes', 'revise')").groupBy("canonical").agg(F.max_by(F.struct("scope", "hash", "content"), "source").alias("r")).select(F.col("canonical").alias("id"), "r.*")
    revised = told.filter("source is null and action = 'revise'").select(F.col("canonical").alias("id"), F.sha2("content", 256).alias("hash"), "content").join(canonicals.select("id", "scope"), "id").select("id", "scope", "hash", "content")
    new = written.unionByName(revised)
    return linked, canonicals.select("id", "scope", "hash", "content").join(new.select("id"), "id", "left_anti").unionByName(new)


def refused(actions: DataFrame, pending: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Actions that may not be applied, with ``reason``; a source that is named twice, or isn't pending, is among them.

    A revision names no source but a memory, its text's hash as the caller knows it, and the new text.
    """
    known = pending.select("source", "kind", F.col("scope").alias("_scope")).dropDuplicates(["source"])
    hashes = F.col("hash") if "hash" in canonicals.columns else F.lit(None).cast("string")
    there = canonicals.select(F.col("id").alias("canonical"), F.col("scope").alias("_of"), hashes.alias("_hash")).dropDuplicates(["canonical"])
    revises = (F.col("action") == "revise") & F.col("source").isNull()
    a = _actions(actions).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("source", F.when(revises, F.col("canonical")), revises)))
    a = a.join(known, "source", "left").join(there, "canonical", "left")
    # The actions there are
    action = F.col("action")
    reason = (
        F.when(revises, F.when(F.col("_n") > 1, "named twice").when(F.col("content").isNull() | F.col("canonical").isNull(), "revise requires a memory and a text").when(F.col("_of").isNull(), "no such canonical").when(~F.col("hash").eqNullSafe(F.col("_hash")), "stale revision"))
        .when(~F.coalesce(action, F.lit("")).isin("unresolved", "detach", "distinct", "scoped", "same", "merge", "supersedes"), "unknown action")
        .when(F.col("_n") > 1, "named twice").when(F.col("kind").isNull(), "not pending").when(action == "unresolved", None)
        .when((action == "detach") & (F.col("kind") != "missing"), "detach requires a missing source").when((action != "detach") & (F.col("kind") == "missing"), "missing source")
        .when(action.isin("same", "supersedes") & F.col("_of").isNull(), "no such canonical").when(action.isin("distinct", "scoped") & F.col("_of").isNotNull(), "canonical exists")
        .when(F.col("_of") != F.col("_scope"), "canonical of another scope")
    )
    return a.withColumn("reason", reason).filter("reason is not null").select("source", "action", "canonical", "reason")


def remember(requests: DataFrame, canonicals: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests (scope, content, canonical or null) with the memory's id, hash, source and ``status``.

    created, linked (the memory is there) or unchanged (it is the source's text already) for new ones; revised,
    unchanged or refused where ``canonical`` is given: only a memory with one origin, the user's or a remote one, may be
    revised. Empty text is refused, and so is an id that has another text. Of equal requests one stays.
    """
    r = requests.select("scope", F.trim("content").alias("content"), "canonical").distinct()
    name = F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat("scope", F.lit("\x00"), "content"), 256), 1, 16))
    r = r.select(F.col("canonical").isNotNull().alias("_revises"), F.coalesce("canonical", name).alias("id"), "scope", "content", F.sha2("content", 256).alias("hash"))
    origin = links.join(sources.select(F.col("id").alias("source"), "provider", F.col("content").alias("_held")), "source").groupBy(F.col("canonical").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("source", "provider", "_held")).alias("_o"))
    known = canonicals.select("id", F.col("scope").alias("_scope"), F.col("content").alias("_text")).dropDuplicates(["id"])
    j = r.join(known, "id", "left").join(origin, "id", "left")
    own = F.coalesce((F.col("_n") == 1) & F.col("_o.provider").isin("user", "remote"), F.lit(False))
    made = F.substring(F.sha2(F.concat(F.lit("user\x00"), "scope", F.lit("\x00user/"), "id"), 256), 1, 20)
    source = F.when(F.col("_revises"), F.col("_o.source")).otherwise(made)
    j = j.withColumn("source", source).join(sources.select(F.col("id").alias("source"), F.col("content").alias("_prior")).dropDuplicates(["source"]), "source", "left")
    collides = F.coalesce(F.col("_scope") != F.col("scope"), F.lit(False)) | (~F.col("_revises") & F.coalesce(F.col("_text") != F.col("content"), F.lit(False)))
    refused_ = (F.length("content") == 0) | collides | (F.col("_revises") & (F.col("_text").isNull() | ~own))
    status = F.when(F.coalesce(refused_, F.lit(True)), "refused").when(F.col("_prior") == F.col("content"), "unchanged").when(F.col("_revises"), "revised").when(F.col("_text").isNotNull(), "linked").otherwise("created")
    return j.select("id", "scope", "content", "hash", "source", status.alias("status"))


def forget(ids: DataFrame, links: DataFrame, sources: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Each asked id with ``status``: forgotten, projected (a projection shows it) or refused.

    Only a settled memory of the user's own may go: every origin is the user's or remote, and each of the user's is
    active with the hash that was applied. ``shown`` has the ids that are in a projection.
    """
    o = links.join(sources.select(F.col("id").alias("source"), "provider", "hash", "active"), "source")
    settled = (F.col("provider") == "remote") | ((F.col("provider") == "user") & F.col("active") & (F.col("hash") == F.col("applied_hash")))
    guard = o.groupBy(F.col("canonical").alias("id")).agg(F.bool_and(F.coalesce(settled, F.lit(False))).alias("_ok"))
    out = ids.select("id").distinct().join(guard, "id", "left")
    seen = ids.select("id").limit(0) if shown is None else shown.select("id").distinct()
    out = out.join(seen.withColumn("_seen", F.lit(True)), "id", "left")
    status = F.when(~F.coalesce("_ok", F.lit(False)), "refused").when(F.col("_seen"), "projected").otherwise("forgotten")
    return out.select("id", status.alias("status"))


def without(forgotten: DataFrame, canonicals: DataFrame, links: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonicals, links and sources once ``forgotten`` (of ``forget``) has gone: a memory goes with its origins."""
    gone = forgotten.filter("status = 'forgotten'").select("id")
    of = links.join(gone.select(F.col("id").alias("canonical")), "canonical", "left_semi").select("source")
    return canonicals.join(gone, "id", "left_anti"), links.join(of, "source", "left_anti"), sources.join(of.select(F.col("source").alias("id")), "id", "left_anti")


def bind_scopes(checkouts: DataFrame, bound: DataFrame) -> DataFrame:
    """Each checkout (checkout, repository) with its memory scope, by the scopes that were bound before.

    Its own binding counts while it is of the same repository; else the one scope of its repository; else its own path,
    marked with the repository where the checkout was another's. ``scopes`` over 1 is ambiguous and has no scope.
    """
    own = bound.select("checkout", F.col("repository").alias("_r"), F.col("scope").alias("_own")).dropDuplicates(["checkout"])
    per = bound.groupBy("repository").agg(F.count_distinct("scope").alias("_n"), F.min("scope").alias("_one"))
    j = checkouts.select("checkout", "repository").distinct().join(own, "checkout", "left").join(per, "repository", "left")
    fits = F.col("_r").eqNullSafe(F.col("repository")) & F.col("_own").isNotNull()
    made = F.when(F.col("_own").isNotNull(), F.concat("checkout", F.lit("@"), F.substring("repository", 6, 8))).otherwise(F.col("checkout"))
    scope = F.when(F.col("repository").isNull(), F.col("checkout")).when(fits, F.col("_own")).when(F.col("_n") > 1, None).otherwise(F.coalesce("_one", made))
    n = F.when(fits | F.col("repository").isNull(), 1).otherwise(F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)))
    return j.select("checkout", "repository", scope.alias("scope"), n.cast("long").alias("scopes"))


def ancestor_leaves(revisions: DataFrame) -> DataFrame:
    """Revisions that no other of their entity has among its ``ancestors``, and ``settled`` where there is one.

    ``revisions``: workspace, author, entity, revision, ancestors. Ancestors are exploded and met by an equi-join.
    """
    key = ["workspace", "author", "entity"]
    r = revisions.dropDuplicates([*key, "revision"])
    above = revisions.select(*key, F.explode("ancestors").alias("revision")).distinct()
    left = r.join(above, [*key, "revision"], "left_anti")
    n = left.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return left.join(n, key).withColumn("settled", F.col("_n") == 1).drop("_n", "ancestors")


def projection_status(projections: DataFrame) -> DataFrame:
    """Files that show a memory, with ``status``, by hashes of what was written last, what is there and what should be.

    create: nothing is there and nothing was written; drift: what is there isn't what was written; unchanged or update.
    """
    wrote, there, wanted = F.col("recorded_hash"), F.col("disk_hash"), F.col("wanted_hash")
    status = F.when(there.isNull() & wrote.isNull(), "create").when(~there.eqNullSafe(wrote), "drift").when(there.eqNullSafe(wanted), "unchanged").otherwise("update")
    return projections.withColumn("status", status)


def current(canonicals: DataFrame, scope: str, query: str | None = None) -> DataFrame:
    """A scope's memories, by id; those that contain ``query`` in any case."""
    rows = canonicals.filter(F.col("scope") == scope)
    return (rows if not query else rows.filter(F.lower("content").contains(query.lower()))).orderBy("id")


def context_index(canonicals: DataFrame, scope: str, rows: int = 64, size: int = 16000) -> DataFrame:
    """Labels of a scope's memories: at most 64, and so many characters in all."""
    top = current(canonicals, scope).select("id", T.label(F.col("content")).alias("label")).limit(min(rows, 64))
    so_far = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)  # of at most 64 rows
    return top.withColumn("_c", F.sum(F.length("label") + 1).over(so_far)).filter(F.col("_c") <= size).drop("_c")


def select_one(canonicals: DataFrame, scope: str, selector: str) -> DataFrame:
    """The memories at the best tier that fits: id, beginning of the id, whole text, title, part of the text. One row is a match."""
    s = selector.lower()
    text, title = F.lower(F.trim("content")), F.lower(T.label(F.col("content")))
    tier = F.when(F.lower("id") == s, 1).when(F.lower("id").startswith(s), 2).when(text == s, 3).when(title == s, 4).when(text.contains(s), 5)
    rows = canonicals.filter(F.col("scope") == scope).withColumn("tier", tier).filter("tier is not null")
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("_least"))), F.col("tier") == F.col("_least")).drop("_least")


def evidence_status(evidence: DataFrame, messages: DataFrame | None) -> DataFrame:
    """Whether each message that a memory rests on still says what it did: verified, changed or missing.

    Without an archive (``messages`` is None) nobody can tell: unavailable.
    """
    if messages is None:
        return evidence.withColumn("status", F.lit("unavailable"))
    m = messages.select(F.col("id").alias("message"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("_now"))
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("content_hash"), "verified").otherwise("changed")
    return evidence.join(m, "message", "left").withColumn("status", status).drop("_now")


def audit(evidence: DataFrame, canonicals: DataFrame, messages: DataFrame | None) -> DataFrame:
    """Each memory's evidence (canonical, hash, message, content_hash) with scope, ``status``, and ``current``: of its present revision."""
    c = canonicals.select(F.col("id").alias("canonical"), "scope", F.col("hash").alias("_hash"))
    return evidence_status(evidence, messages).join(c, "canonical").withColumn("current", F.col("hash").eqNullSafe(F.col("_hash"))).drop("_hash")


def audit_summary(audited: DataFrame) -> DataFrame:
    """A row a scope: its evidence, and how much of it has each status."""
    return audited.groupBy("scope").agg(F.count(F.lit(1)).alias("evidence"), *[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "changed", "missing", "unavailable")])


def audit_lines(audited: DataFrame) -> DataFrame:
    """scope, canonical and a line of Markdown for each piece of evidence that isn't verified."""
    age = F.when(F.col("current"), "current").otherwise("historical")
    line = F.concat(F.lit("- ["), "status", F.lit("] "), age, F.lit(" `"), "canonical", F.lit("` @ `"), "scope", F.lit("`: `"), "message", F.lit("`"))
    return audited.filter("status <> 'verified'").select("scope", "canonical", line.alias("line"))


def scope_for(path_rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each path's scope: the longest that is the path or above it. Scopes meet a path by its ancestors, so it is a plain join."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    own = path_rows.select("path", F.explode(ups).alias("scope"))
    hits = own.join(scopes.select("scope").distinct(), "scope").groupBy("path").agg(F.max_by("scope", F.length("scope")).alias("scope"))
    return path_rows.join(hits, "path", "left")


def status(sources: DataFrame) -> DataFrame:
    """Sources, active and missing ones of each scope."""
    return sources.groupBy("scope").agg(F.count(F.lit(1)).alias("sources"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("missing"))


def task_groups(files: DataFrame) -> DataFrame:
    """A memory file cut at its ``# Task Group:`` headings, with the directories that each group applies to."""
    pieces = files.select("path", F.posexplode(F.split("content", r"(?m)^(?=# Task Group:)")).alias("n", "content")).filter(F.col("content").startswith("# Task Group:"))
    return pieces.withColumn("scopes", F.expr(r"regexp_extract_all(content, 'applies_to:\\s*cwd=([^\\s;,]+)', 1)"))
