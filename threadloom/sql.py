"""Read-only SQL over the archive, with a shim for a few functions and clauses of another dialect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from threadloom import schema
from threadloom.archive import Archive

# Functions under another name here.
_NAMES = {"starts_with": "startswith", "json_extract_string": "get_json_object", "regexp_matches": "regexp_like", "list_contains": "array_contains", "strlen": "octet_length"}
#: Parsed plans that may stand in a query; all others are refused, among them whatever a later Spark adds.
PLANS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Intersect Except Join LateralJoin AsOfJoin Window WithWindowDefinition Generate Pivot UnresolvedPivot Unpivot UnresolvedHaving "
    "UnresolvedRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith SubqueryAlias OneRowRelation LocalRelation Range Sample UnresolvedOrdinal Expand".split()
)
#: Expressions that hold a plan of their own.
SUBQUERIES = frozenset({"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"})
#: Spark's own kinds of functions that work on a query's rows; those of another kind are allowed by name only.
FUNCTION_KINDS = frozenset(
    f"{kind}_funcs" for kind in "agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate string struct url variant window xml".split()
)
#: Functions of Spark's other kinds that may stand in a query.
FUNCTIONS = frozenset({"typeof", "uuid", "monotonically_increasing_id", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "hll_sketch_estimate", "hll_union"})
#: Table functions that make rows from their arguments.
TABLE_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "sequence", "variant_explode"})


class ReadOnly(ValueError):
    """The statement writes."""


def _masked(query: str) -> tuple[str, list[str]]:
    """The query with its literals, quoted names and comments taken out, so that nothing in them is rewritten."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"])*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", hide, query, flags=re.S), kept


# FROM after DISTINCT is part of a comparison, and WINDOW with a bracket a function
_WORDS = re.compile(r"[()]|\bDISTINCT\s+FROM\b|\b(?:SELECT|FROM|QUALIFY|WINDOW|ORDER\s+BY|LIMIT|OFFSET|UNION|INTERSECT|EXCEPT)\b(?!\s*\()", re.I)
_ENDS = ("WINDOW", "ORDER BY", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT")


def _levels(text: str) -> list[tuple[str, int, int, int]]:
    """Brackets and clause words in order: word, depth, and where it begins and ends."""
    out, depth = [], 0
    for m in _WORDS.finditer(text):
        word = re.sub(r"\s+", " ", m[0].upper())
        depth -= word == ")"
        out.append((word, depth, m.start(), m.end()))
        depth += word == "("
    return out


def _unqualified(text: str) -> str:
    """``text`` without QUALIFY: its select becomes a subquery with the condition as a column."""
    while True:
        words = _levels(text)
        at = max((k for k, w in enumerate(words) if w[0] == "QUALIFY"), key=lambda k: words[k][1], default=None)
        if at is None:
            return text
        _, depth, start, end = words[at]
        # its own select: the last at this depth, with no bracket closed below it
        own = next((k for k in range(at - 1, -1, -1) if words[k][0] == "SELECT" and words[k][1] == depth), None)
        source = next((w for w in words[own:at] if w[0] == "FROM" and w[1] == depth), None) if own is not None else None
        if source is None:
            raise ValueError("QUALIFY needs a select with FROM")
        ends = [w for w in words[at + 1 :] if w[1] < depth or (w[1] == depth and w[0] in _ENDS)]
        stop = rest = ends[0][2] if ends else len(text)
        if ends and ends[0][0] == "WINDOW" and ends[0][1] == depth:  # names that the condition uses: they go in with it
            rest = ends[1][2] if len(ends) > 1 else len(text)
        begin = words[own][3]
        inner = f"SELECT{text[begin : source[2]]}, ({text[end:stop].strip()}) AS _qualifies {text[source[2] : start]}{text[stop:rest]}"
        text = f"{text[: words[own][2]]}SELECT * EXCEPT (_qualifies) FROM ({inner}) WHERE _qualifies {text[rest:]}"


def shim(query: str) -> str:
    """The same query in Spark's dialect: renamed functions, ``EXCLUDE``, ``QUALIFY`` of a select, ``list_sort``-free."""
    text, kept = _masked(query)
    for old, new in _NAMES.items():
        text = re.sub(rf"\b{old}\s*\(", f"{new}(", text, flags=re.I)
    text = re.sub(r"\*\s*EXCLUDE\s*(\([^)]*\)|\w+)", lambda m: "* EXCEPT " + (m[1] if m[1][0] == "(" else f"({m[1]})"), text, flags=re.I)
    text = re.sub(r"\bUNNEST\s*\(", "explode(", text, flags=re.I)
    text = re.sub(r"::\s*(VARCHAR|TEXT)\b", "::STRING", text, flags=re.I)
    text = _unqualified(text)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _may_call(archive: Archive, name: str) -> bool:
    """Whether ``name`` is a function of Spark's own, of an allowed kind, and no other function was registered under it."""
    jvm = archive.spark._jvm
    key = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    own = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().lookupFunction(key)
    found = archive.spark._jsparkSession.sessionState().functionRegistry().lookupFunction(key)
    if own.isEmpty() or found.isEmpty() or own.get().getClassName() != found.get().getClassName():
        return False
    return own.get().getGroup() in FUNCTION_KINDS or name in FUNCTIONS


def check(archive: Archive, query: str) -> None:
    """Raises ``ReadOnly`` unless Spark's parser makes a plan of known kinds, over the archive's tables and harmless functions."""
    plan = archive.spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    known, todo, relations = set(schema.TABLES), [plan], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        expressions = _each(node.expressions().toList())
        if kind not in PLANS:
            raise ReadOnly(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            relations.append([str(x) for x in _each(node.multipartIdentifier())])
        elif kind == "UnresolvedTableValuedFunction":
            name = [str(x).lower() for x in _each(node.name())]
            if len(name) != 1 or name[0] not in TABLE_FUNCTIONS:
                raise ReadOnly(f"the table function {'.'.join(name)} isn't allowed")
        elif kind == "UnresolvedWith":
            for cte in _each(node.cteRelations()):
                known.add(cte._1().lower())
                todo.append(cte._2())
        todo += _each(node.children())
        while expressions:
            e = expressions.pop()
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                name = [str(x).lower() for x in _each(e.nameParts())]
                if len(name) != 1 or not _may_call(archive, name[0]):
                    raise ReadOnly(f"the function {'.'.join(name)} isn't allowed")
            if e.getClass().getSimpleName() in SUBQUERIES:
                todo.append(e.plan())
            elif "Subquery" in e.getClass().getSimpleName() and e.getClass().getSimpleName() != "InSubquery":
                raise ReadOnly(f"{e.getClass().getSimpleName()} isn't allowed")
            expressions += _each(e.children())
    for name in relations:
        if len(name) != 1 or name[0].lower() not in known:
            raise ReadOnly(f"{'.'.join(name)} is no table of the archive")


def run(archive: Archive, query: str) -> DataFrame:
    """Rows of a query over the archive's tables."""
    query = shim(query)
    check(archive, query)
    for name in schema.TABLES:
        getattr(archive, name).createOrReplaceTempView(name)
    return archive.spark.sql(query)
