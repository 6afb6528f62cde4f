"""Records made safe before a team sees them, whatever fields their payloads have, and a record of what was found."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import redact
from threadloom.runtime import Scratch, share_code

#: JSON may write a letter by its number or a slash by two signs, which the prefilter for plain text wouldn't see.
SUSPECT = redact.PREFILTER + r"|\\u00|\\/"
# What is left of an attachment's record.
ATTACHMENT = {"filename": "[REDACTED:attachment]", "mime_type": None, "size": None, "path": None, "url": None}
_FINDINGS = "array<struct<kind: string, path: string, line: int, start: int>>"


def _field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def _dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _safe(payload: str) -> tuple[str, list[dict]]:
    """A payload without secrets in any text at any depth; it stays as it is, letter for letter, where there are none."""
    try:
        value = json.loads(payload)
    except ValueError:
        return redact.inspect(payload, "$.payload")
    safe, found = redact.inspect(value, "$.payload")
    return (_dumps(safe) if found else payload), found


def _patched(payload: Column, patch: Column) -> Column:
    """``payload`` with the fields of ``patch``, both JSON objects; where ``patch`` is null it doesn't reach Python's parser."""

    @F.pandas_udf("string")
    def merge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in batches:
            yield pd.Series([None if n is None else _dumps({**json.loads(o), **json.loads(n)}) for o, n in zip(old, new, strict=True)], dtype=object)

    return F.coalesce(merge(F.when(patch.isNotNull(), payload), patch), payload)


def protect(records: DataFrame) -> DataFrame:
    """``records`` (kind, entity, payload: JSON text) without secrets, each for itself.

    Every text of a payload is searched, however deep it stands. ``findings`` has kind, path, line and start of each
    secret, never the secret; ``changed`` says whether there were any. Attachments lose name, type, size, path, url and
    body hash; of their chunks only the finding is left, with a null payload; deleted attachments stay as they are.
    Payloads that the prefilter passes by never reach Python.
    """
    share_code(records.sparkSession)
    hidden = (F.col("kind") == "attachment.record") & ~_field("state").eqNullSafe("deleted")
    chunk, other = F.col("kind") == "attachment.chunk", ~F.col("kind").isin("attachment.record", "attachment.chunk")

    @F.pandas_udf(f"payload string, findings {_FINDINGS}")
    def safe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([(None, None) if t is None else _safe(t) for t in x], columns=["payload", "findings"])

    body = F.when(F.col("payload").like('%"body_hash"%'), F.lit(_dumps({**ATTACHMENT, "body_hash": None}))).otherwise(F.lit(_dumps(ATTACHMENT)))
    told = records.select("kind", "entity", "payload", hidden.alias("_hidden"), safe(F.when(other & F.col("payload").rlike(SUSPECT), F.col("payload"))).alias("_s"))
    one = F.array(F.struct(F.lit("attachment_redacted").alias("kind"), F.lit("$.payload").alias("path"), F.lit(1).alias("line"), F.lit(0).alias("start")))
    left = F.when(~chunk, F.coalesce("_s.payload", _patched(F.col("payload"), F.when(F.col("_hidden"), body))))
    out = told.select("kind", "entity", left.alias("payload"), F.when(chunk | F.col("_hidden"), one).otherwise(F.coalesce("_s.findings", F.array().cast(_FINDINGS))).alias("findings"))
    return out.withColumn("changed", F.size("findings") > 0)


def protect_all(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Safe records (kind, entity, payload), and the findings in them (entity, record_kind, kind, path, line, start).

    What could tell of a changed edit's old text goes with it. Of the files and repositories of changed edits: versions
    of such a file, checkpoints of such a repository and links of such an edit go; the edit's own fact gets the hashes of
    the safe texts; the repository loses its lineage, roots and head.
    """
    # read several times below: written once, so that texts are searched once
    whole = Scratch(records.sparkSession, "guard").keep(protect(records), "safe")
    findings = whole.select("entity", F.col("kind").alias("record_kind"), F.inline("findings"))
    safe = whole.filter("payload is not null")
    changed = safe.filter("kind = 'file_edit.record' and changed").filter(~_field("state").eqNullSafe("deleted"))
    digests = F.struct(F.sha2(_field("old_content"), 256).alias("old_content_hash"), F.sha2(F.coalesce(_field("content"), F.lit("")), 256).alias("new_content_hash"))
    # of records that repeat an edit, one: the greatest
    edits = changed.groupBy(_field("id").alias("_edit")).agg(F.to_json(F.max(digests), {"ignoreNullFields": "false"}).alias("_digests"))
    facts = safe.filter("kind = 'edit.observed'").select(_field("id").alias("_edit"), _field("file").alias("_file"), _field("repository").alias("_repository")).join(edits, "_edit", "left_semi")
    # what changed edits reach, by what it is: an edit with its digests, a file or a repository
    mark = lambda of, k: F.struct(F.lit(of).alias("of"), k.alias("id")).alias("_mark")
    marks = edits.select(mark("edit", F.col("_edit")), "_digests")
    for of, column in (("file", "_file"), ("repository", "_repository")):
        marks = marks.unionByName(facts.select(mark(of, F.col(column))).distinct().withColumn("_digests", F.lit(None).cast("string")))
    kind = F.col("kind")
    about = F.when(kind == "checkpoint.link", mark("edit", _field("edit"))).when(kind == "edit.observed", mark("edit", _field("id"))).when(kind == "file.version", mark("file", _field("file")))
    about = about.when(kind == "repository.observed", mark("repository", _field("id"))).when(kind == "git.checkpoint", mark("repository", _field("repository")))
    told = safe.select("kind", "entity", "payload", about.alias("_mark"))
    # most records name nothing: in the join they would all be one key's, and so one task's
    named = F.col("_mark.id").isNotNull()
    j = told.filter(named).join(marks.filter(named).withColumn("_reached", F.lit(True)), "_mark", "left")
    goes = F.col("_reached").isNotNull() & kind.isin("file.version", "git.checkpoint", "checkpoint.link")
    patch = F.when(kind == "edit.observed", F.col("_digests")).when((kind == "repository.observed") & F.col("_reached"), F.lit(_dumps({"lineage": None, "roots": [], "head": None})))
    left = j.filter(~goes).select("kind", "entity", _patched(F.col("payload"), patch).alias("payload"))
    return told.filter(~named).select("kind", "entity", "payload").unionByName(left), findings


def audit(findings: DataFrame, workspace: str, now: datetime, previous: DataFrame | None = None) -> DataFrame:
    """A record of findings without their values: an id of place and kind, first and last seen. ``previous`` is an earlier one."""
    at = F.lit(now).cast("timestamp_ntz")
    place = F.concat_ws("\0", F.lit(workspace), "entity", "path", F.col("line").cast("string"), F.col("start").cast("string"), "kind")
    new = findings.select(F.concat(F.lit("sec_"), F.substring(F.sha2(place, 256), 1, 20)).alias("id"), F.lit(workspace).alias("workspace"), "entity", "record_kind", "kind", "path", "line", at.alias("first_seen"), at.alias("last_seen"))
    rows = new if previous is None else previous.unionByName(new)
    return rows.groupBy("id", "workspace", "entity", "record_kind", "kind", "path", "line").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def cached_scan(archive, cache: DataFrame | None, key: list) -> tuple[DataFrame, bool]:
    """Findings, and whether they are the cache's: only under the very key (path, time and size, or a generation) they were made under.

    ``cache`` has findings with ``key``, a string; an archive without findings leaves one row whose kind is null.
    """
    name = "|".join(map(str, key))
    if cache is not None:
        hits = cache.filter(F.col("key") == name)
        if not hits.isEmpty():
            return hits.filter("kind is not null").drop("key"), True
    return redact.scan(archive), False


def to_cache(findings: DataFrame, key: list) -> DataFrame:
    """``findings`` as a cache under ``key``; a row with nulls says that the archive was read."""
    mark = findings.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in findings.schema])
    return findings.unionByName(mark).withColumn("key", F.lit("|".join(map(str, key))))
