"""Change attribution: prompts as of an edit, replay, blame, graphs and provenance views."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.archive import Archive
from threadloom.functions import text as T
from threadloom.operators import folds

#: What may be given in place of an id, a year, a month or a day; a time may follow a day.
_DAY_FORMATS = ("%Y", "%Y-%m", "%Y-%m-%d")


def is_moment(text: str) -> bool:
    """Whether ``text`` is a time or its beginning, and no part of an id."""
    day, time = text[:10], text[10:]
    for form in _DAY_FORMATS:
        try:
            whole = datetime.strptime(day, form).strftime(form) == day
        except ValueError:
            continue
        if whole:
            return not time or (form == _DAY_FORMATS[-1] and time[0] in " T")
    return False


def edits(archive: Archive, path: str | None = None) -> DataFrame:
    """Every edit with its conversation, source and the latest user prompt at its time; orphans are ``unknown`` and ``?``.

    The prompt is an as-of join: prompts and edits of a conversation in one order, and the last prompt so far.
    """
    e = archive.file_edits if path is None else archive.file_edits.filter(F.col("file_path") == path)
    owners = archive.messages.select(F.col("id").alias("message_id"), "conversation_id")
    sources = archive.conversations.select(F.col("id").alias("conversation_id"), "source")
    placed = e.join(owners, "message_id", "left").join(sources, "conversation_id", "left")
    asked = archive.messages.filter((F.col("role") == "user") & T.has_text(F.col("content")) & F.col("created_at").isNotNull())
    rows = placed.select("conversation_id", F.col("created_at").alias("at"), F.lit(1).alias("side"), "id", F.lit(None).cast("string").alias("said"), F.struct("message_id", "file_path", "edit_type", "content", "old_content", "source").alias("e"))
    prompts = asked.join(placed.select("conversation_id").distinct(), "conversation_id", "left_semi").select("conversation_id", F.col("created_at").alias("at"), F.lit(0).alias("side"), "id", F.col("content").alias("said"), F.lit(None).cast(rows.schema["e"].dataType).alias("e"))
    # ties of prompts go to the larger id
    so_far = Window.partitionBy("conversation_id").orderBy(F.col("at").asc_nulls_first(), "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.filter("conversation_id is not null").unionByName(prompts).withColumn("prompt", F.last("said", ignorenulls=True).over(so_far)).filter("side = 1")
    orphans = rows.filter("conversation_id is null").withColumn("prompt", F.lit(None).cast("string"))
    return known.unionByName(orphans).select("id", F.col("e.file_path").alias("file_path"), F.col("e.edit_type").alias("type"), F.col("e.content").alias("content"), F.col("e.old_content").alias("old"), F.col("at").alias("ts"), F.coalesce("conversation_id", F.lit("unknown")).alias("conv"), F.coalesce("e.source", F.lit("?")).alias("source"), "prompt", F.col("e.message_id").alias("message_id"))


def cut(found: DataFrame, at: str | None) -> DataFrame:
    """Edits up to a moment (a time or its beginning) or up to the last edit of a conversation (part of its id)."""
    if at is None:
        return found
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    early = (text <= at) | text.startswith(at)
    if is_moment(at):
        return found.filter(early)
    own = Window.partitionBy("file_path")
    last = found.withColumn("_k", F.struct("ts", "id")).withColumn("_last", F.max(F.when(F.col("conv").contains(at), F.col("_k"))).over(own))
    return last.filter(F.when(F.col("_last").isNull(), early).otherwise(F.col("_k") <= F.col("_last"))).drop("_k", "_last")


@dataclass(frozen=True)
class Version:
    """A file's lines and which edit last touched each; the lines are None while the content can't be known."""

    lines: tuple[str, ...] | None = None
    by: tuple[int, ...] = ()

    def written(self, number: int, text: str) -> Version:
        lines = tuple(text.splitlines())
        return Version(lines, (number,) * len(lines))

    def changed(self, number: int, old: str, new: str) -> Version:
        """The first place of ``old`` becomes ``new``: lines that neither reaches keep their owners."""
        if self.lines is None or not old:
            return Version()
        before, found, behind = "\n".join(self.lines).partition(old)
        if not found:
            return Version()
        lines = tuple((before + new + behind).splitlines())
        above = before.count("\n")
        below = self.by[above + old.count("\n") + 1 :]
        return Version(lines, self.by[:above] + (number,) * max(0, len(lines) - above - len(below)) + below)

    def after(self, number: int, edit: dict) -> Version:
        match edit["type"]:
            case "write":
                return self.written(number, edit["content"] or "")
            case "edit":
                return self.changed(number, edit["old"] or "", edit["content"] or "")
            case _:  # what a shell or several changes at once did isn't known
                return Version()


def fold(edits_: list[dict]) -> tuple[list[str], list[int]] | tuple[None, None]:
    """A file's lines after its edits and which edit last touched each; nothing once the content can't be known."""
    last = reduce(lambda v, numbered: v.after(*numbered), enumerate(edits_), Version())
    return (None, None) if last.lines is None else (list(last.lines), list(last.by))


@dataclass(frozen=True)
class Known:
    """A file's version, how many edits it has seen, and what its lines' last edits were."""

    path: str | None
    version: Version = Version()
    seen: int = 0
    edits: dict[int, tuple] | None = None

    def after(self, part: pd.DataFrame) -> Known:
        version, seen, edits_ = self.version, self.seen, dict(self.edits or {})
        for kind, content, old, *owner in zip(*[part[c] for c in ("type", "content", "old", "conv", "source", "ts", "prompt")], strict=True):
            version = version.after(seen, {"type": kind, "content": content or "", "old": old})
            edits_[seen] = tuple(owner)
            seen += 1
        return Known(self.path, version, seen, {n: edits_[n] for n in set(version.by)})

    def lines(self) -> pd.DataFrame | None:
        if not self.version.lines:
            return None
        rows = [(self.path, i + 1, *self.edits[n], t) for i, (t, n) in enumerate(zip(self.version.lines, self.version.by, strict=True))]
        return pd.DataFrame(rows, columns=["file_path", "line", "conv", "source", "ts", "prompt", "text"])


def blame(found: DataFrame) -> DataFrame:
    """Each known line of each file with the conversation, source, time and prompt of its last edit.

    A write says the whole file, so what is before a file's last one is left out; the rest is one ordered pass, as each
    edit needs the text before it. Of a prompt the first 80 letters of its first line go along, not the prompt.
    """
    moment = F.struct("ts", "id")
    last = F.max(F.when(F.col("type") == "write", moment)).over(Window.partitionBy("file_path"))
    short = F.substring(F.substring_index(F.coalesce("prompt", F.lit("")), "\n", 1), 1, 80)
    slim = found.select("file_path", "id", "ts", "type", "content", "old", "conv", "source", short.alias("prompt")).withColumn("_last", last)
    rest = slim.filter(F.col("_last").isNull() | (moment >= F.col("_last"))).drop("_last")
    out = "file_path string, line long, conv string, source string, ts timestamp_ntz, prompt string, text string"
    return folds.ordered(rest, ["file_path"], [F.col("ts").asc_nulls_first(), "id"], out, lambda key: Known(key[0]), lambda known, part: (known.after(part), None), Known.lines)


def at(found: DataFrame, point: str) -> DataFrame:
    """Each file's content at a point in time or after a conversation."""
    lines = blame(cut(found, point))
    return lines.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l")).select("file_path", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"))


def timeline(found: DataFrame) -> DataFrame:
    """Edits in order, and whether each one's effect is known exactly."""
    exact = (F.col("type") == "write") | (F.coalesce("old", F.lit("")) != "")
    return found.select("file_path", "id", "ts", "conv", "source", "type", exact.alias("exact"), F.substring(F.substring_index(F.coalesce("prompt", F.lit("")), "\n", 1), 1, 80).alias("prompt"))


def graph(archive: Archive, part: str | None = None) -> DataFrame:
    """Edges file, conversation, message, source; of those that contain ``part`` in file or conversation."""
    e = archive.file_edits.select("file_path", "message_id").join(archive.messages.select(F.col("id").alias("message_id"), "conversation_id"), "message_id").join(archive.conversations.select(F.col("id").alias("conversation_id"), "source"), "conversation_id")
    out = e.select(F.col("file_path").alias("file"), F.col("conversation_id").alias("conv"), F.col("message_id").alias("msg"), "source")
    return out if part is None else out.filter(F.col("file").contains(part) | F.col("conv").contains(part))


def graph_dot(edges: DataFrame) -> DataFrame:
    """The distinct DOT lines of a graph."""
    return edges.select(F.concat(F.lit('  "'), F.substring("conv", 1, 8), F.lit('" -> "'), "file", F.lit('";')).alias("line")).distinct().orderBy("line")


def weights(archive: Archive) -> DataFrame:
    """Edges of file and conversation with their number of edits and latest time; orphans included."""
    e = archive.file_edits.join(archive.messages.select(F.col("id").alias("message_id"), "conversation_id"), "message_id", "left").join(archive.conversations.select(F.col("id").alias("conversation_id"), "source", "title"), "conversation_id", "left")
    return e.groupBy("file_path", F.coalesce("conversation_id", F.lit("unknown")).alias("conv"), F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("title", F.lit("")).alias("title")).agg(F.count(F.lit(1)).alias("edits"), F.max("created_at").alias("last_edit"))


def nodes(edges: DataFrame, by: str) -> DataFrame:
    """A roll-up of ``weights`` by file_path or conv."""
    return edges.groupBy(F.col(by).alias("node")).agg(F.sum("edits").alias("edits"), F.max("last_edit").alias("last_edit"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def adjacent(edges: DataFrame, of: str) -> DataFrame:
    """Each node of one side of ``weights`` (file_path or conv) with each neighbour, its edits and latest edit: a row a neighbour, not a list."""
    other = "conv" if of == "file_path" else "file_path"
    return edges.groupBy(F.col(of).alias("node"), F.col(other).alias("neighbour")).agg(F.sum("edits").alias("edits"), F.max("last_edit").alias("last_edit"))


class Provenance:
    """Views over provenance facts, given as DataFrames."""

    def __init__(self, archive: Archive, files: DataFrame, links: DataFrame, checkpoints: DataFrame | None = None, checkpoint_edits: DataFrame | None = None, repositories: DataFrame | None = None):
        self.archive, self.files, self.links, self.checkpoints, self.checkpoint_edits, self.repositories = archive, files, links, checkpoints, checkpoint_edits, repositories

    def file_history(self) -> DataFrame:
        e = edits(self.archive).select(F.col("id").alias("file_edit_id"), F.col("ts").alias("observed_at"), F.col("type").alias("edit_type"), F.col("message_id").alias("changeset_id"), F.col("conv").alias("conversation"), "prompt")
        f = self.files.select(F.col("id").alias("file_id"), "repository", "path")
        return self.links.join(f, "file_id").join(e, "file_edit_id").select("observed_at", "repository", "path", "edit_type", "evidence", "changeset_id", "conversation", F.col("changeset_id").alias("turn"), "prompt", "old_content_hash", "new_content_hash")

    def changeset_files(self) -> DataFrame:
        return self.file_history().filter("conversation <> 'unknown'").select(F.col("changeset_id").alias("id"), "conversation", "turn", "prompt", "repository", "path", "edit_type", "evidence")

    def conversation_changes(self) -> DataFrame:
        pair = F.concat(F.coalesce("repository", F.lit("")), F.lit(":"), "path")
        return self.file_history().groupBy("conversation", "changeset_id").agg(F.min("prompt").alias("prompt"), F.count_distinct("repository").alias("repositories"), F.count_distinct(pair).alias("files"), F.min("observed_at").alias("first_edit"), F.max("observed_at").alias("last_edit"))

    def repository_activity(self) -> DataFrame:
        return self.file_history().filter("conversation <> 'unknown'").groupBy("repository", "conversation", "changeset_id").agg(F.count(F.lit(1)).alias("edits"), F.max("observed_at").alias("last_edit"))

    def commit_conversations(self) -> DataFrame:
        e = edits(self.archive).filter("conv <> 'unknown'").select(F.col("id").alias("file_edit_id"), F.col("conv").alias("conversation"), F.col("message_id").alias("changeset_id"))
        p = self.checkpoints.select(F.col("id").alias("checkpoint_id"), "head", "repository")
        return self.checkpoint_edits.join(p, "checkpoint_id").join(e, "file_edit_id").select("head", "conversation", "changeset_id", "repository", "evidence")

    def checkpoint_states(self) -> DataFrame:
        return self.checkpoints.select("repository", "head", "state_hash", "paths", "capture_source", "observed_at")

    def repository_lineages(self) -> DataFrame:
        return self.repositories.groupBy("lineage").agg(F.count(F.lit(1)).alias("repositories"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("repository_ids"))
