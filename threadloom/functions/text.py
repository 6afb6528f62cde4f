"""Column functions that several operators share. All of them stay in generated code."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Openings of injected scaffolding, which is no conversation.
NOISE = r"^(Base directory for this skill:|# AGENTS\.md instructions for|<(codex_internal_context|environment_context|local-command-caveat|recommended_plugins|skill)( |>))"


def gen_id(source: Column | str, key: Column) -> Column:
    """The 16-digit id of ``key`` within ``source``."""
    name = F.lit(source) if isinstance(source, str) else source
    return F.substring(F.sha2(F.concat(name, F.lit(":"), key), 256), 1, 16)


def clip(text: Column, n: int) -> Column:
    """The first n characters, with dots when there are more; null gives ''."""
    body = F.coalesce(text, F.lit(""))
    return F.when(F.length(body) > n, F.concat(F.substring(body, 1, n), F.lit("..."))).otherwise(body)


def clip_within(text: Column, n: int) -> Column:
    """As ``clip``, but the dots count: at most n characters."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, max(0, n - 3)), F.lit("..."))).otherwise(text)


def clean(content: Column) -> Column:
    """Not null and not scaffolding."""
    return content.isNotNull() & ~content.rlike(NOISE)


def live(metadata: Column) -> Column:
    """Not a superseded version."""
    return F.get_json_object(metadata, "$.history_of").isNull()


def has_text(*columns: Column) -> Column:
    """Any of the columns is neither null nor ''."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(c, F.lit("")) != "")
    return out


def normal_path(path: Column) -> Column:
    """``path`` without empty and ``.`` parts, and with each ``..`` taken from the part before it; all in the JVM.

    A path from the root stays below it; of another one, ``..`` that nothing is before stays. What is left of nothing
    is ``.``. Parts are a stack, folded from left to right; most paths have nothing to fold and are left as they are.
    """
    rooted = F.startswith(path, F.lit("/"))
    top = lambda stack: F.get(stack, F.size(stack) - 1)
    up = lambda stack: F.when((F.size(stack) > 0) & (F.coalesce(top(stack), F.lit("")) != ".."), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(rooted, stack).otherwise(F.concat(stack, F.array(F.lit(".."))))
    push = lambda stack, part: F.when(part.isin("", "."), stack).when(part == "..", up(stack)).otherwise(F.concat(stack, F.array(part)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), push)
    whole = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    plain = path.rlike(r"^/?[^/.][^/]*(/[^/.][^/]*)*$")
    return F.when(plain, path).otherwise(F.when(whole == "", ".").otherwise(whole))


def under(path: Column, scope: str) -> Column:
    """``path`` is ``scope`` or lies below it, however both are written."""
    own, root = normal_path(path), normal_path(F.lit(scope))
    return (own == root) | own.startswith(F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))


def tokens(text: Column) -> Column:
    """Runs of a to z after lower-casing."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: t != "")


def dot(a: Column, b: Column) -> Column:
    """The scalar product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """The Euclidean length in double precision."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def without_controls(text: Column) -> Column:
    """Without control characters other than tab and newline."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", "")


def highlight(text: Column, query: str) -> Column:
    """Query words set in bold yellow."""
    out = text
    for word in query.split():
        out = F.regexp_replace(out, "(?i)(" + "".join(c if c.isalnum() else "\\" + c for c in word) + ")", "\x1b[1;33m$1\x1b[0m")
    return out


def remote_name(url: Column) -> Column:
    """A repository address in one form: host/path, without scheme, user, port, ``.git`` or a last slash; the host in lower case."""
    scp = F.regexp_replace(url, r"^(?:[^@/:]+@)?([^/:]+):(?!//)(?!\d+/)", "ssh://$1/")
    rest = F.regexp_replace(F.regexp_replace(scp, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?", ""), r"(\.git)?/*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^[^/]*", 0), r":\d+$", ""))
    return F.concat(host, F.regexp_extract(rest, "^[^/]*(.*)$", 1))


def timestamp_of(value: Column) -> Column:
    """A moment from epoch seconds or ISO text, without zone (UTC); null where it is neither."""
    epoch = F.expr("try_cast(null as double)") if value is None else value.try_cast("double")
    from_epoch = F.timestamp_seconds(epoch).cast("timestamp_ntz")
    return F.coalesce(from_epoch, F.try_to_timestamp(value).cast("timestamp_ntz"))


def munged(path: Column) -> Column:
    """A path as a folder name: whatever is neither letter, digit nor dash becomes a dash."""
    return F.regexp_replace(path, "[^A-Za-z0-9-]", "-")


@F.pandas_udf(StringType())  # not "string": a worker that imports this has no session to read it with
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text in one form: keys in order, no blanks, ASCII only; null stays null. Python's form of numbers and escapes counts."""
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), allow_nan=False), na_action="ignore")


def identity(**fields: Column) -> Column:
    """The SHA-256 of the canonical JSON object of ``fields``; nulls count as null members."""
    members = F.struct(*[v.alias(k) for k, v in fields.items()])
    return F.sha2(canonical_json(F.to_json(members, {"ignoreNullFields": "false"})), 256)


def label(content: Column, size: int = 96) -> Column:
    """What a memory is called: the name of its first twelve lines, else its first heading, else its first line with text.

    Each of these counts only if something is left of it; ``memory`` where nothing is. At most ``size`` characters.
    """
    lines = F.split(F.coalesce(content, F.lit("")), r"\r\n|\r|\n")
    first = lambda of, fits: F.get(F.filter(of, fits), F.lit(0))
    bare = lambda c, around: F.regexp_replace(c, f"^{around}+|{around}+$", "")
    named = bare(bare(F.regexp_replace(first(F.slice(lines, 1, 12), lambda x: x.startswith("name:")), "^name:", ""), r"\s"), "[\"']")
    headed = bare(F.regexp_replace(first(lines, lambda x: x.startswith("#")), "^[# ]+", ""), r"\s")
    plain = bare(first(lines, lambda x: x.rlike(r"\S")), r"\s")
    told = F.lit("memory")
    for c in (plain, headed, named):
        told = F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(told)
    return F.substring(told, 1, size)
