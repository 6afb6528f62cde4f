"""Source divergence audit: how each source of a language uses words, against its other sources and the language.

Relational throughout. Matches of a term pattern, which are what is left when texts are split at all that matches
nothing of it, are exploded and counted by (lang, source, term); a language keeps the
terms that enough of its documents have; its groups are crossed with these, so that zeros are counted too; tables join
themselves by (lang, term), are summed, and ranked by windows. Counts are combined where rows are read, so that a hot
source or term costs no task of its own. Groups and kept terms meet by language and a part of the vocabulary, since a
language may hold most of both. Probabilities are whole billionths, by exact decimal division.

Defined results: null text, lang and source are ''. A row is a document, repeated or not. A group without terms has a
probability for each kept term all the same; a language without kept terms gives its pairs the value 0 and no terms.
Ties rank by the item's UTF-8 bytes. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.line_dedup import ascii_lower
from threadloom.runtime import Scratch

#: Fixed value: what stands between terms, which are of ASCII letters and all that isn't ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in.
LEAST_DOCS = 10
#: Ranks of terms that are told.
TOP = 10


def count_terms(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences and ``docs``, the rows that have it."""
    told = df.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source"), F.split(ascii_lower(F.coalesce(text_col, F.lit(""))), BETWEEN).alias("terms"))
    # all terms and then each once, in one array; the outer form, or the optimiser makes it once more to filter by its size
    each = told.select("lang", "source", F.size("terms").alias("all"), F.posexplode_outer(F.concat("terms", F.array_distinct("terms"))).alias("at", "term")).filter("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("all")).alias("n"), F.count_if(F.col("at") >= F.col("all")).alias("docs"))


def billionths(n: str, total: str, kinds: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kinds)), exactly."""
    return F.expr(f"1 + cast(1000000000 * cast({n} + 2 AS DECIMAL(28, 0)) AS DECIMAL(38, 0)) div cast({total} + 2 * {kinds} AS DECIMAL(20, 0))")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); of two billionths it fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(df: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: each source against the others, and its ``top`` terms."""
    spark = df.sparkSession
    scratch, salts = Scratch(spark, "source-audit"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = scratch.keep(count_terms(df, text_col, lang_col, source_col), "counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = scratch.keep(vocabulary.select("lang", "term", "lang_n"), "kept")
    own = scratch.keep(counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "own")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("lang_n").alias("lang_total"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = df.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    groups = scratch.keep(named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kinds", "lang_total"]), "groups")
    # each part of a language's vocabulary with all its groups: a group is told once a part, and no part is large
    parts = groups.filter("kinds > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"))
    grid = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(parts, ["lang", "part"])
    filled = grid.join(own, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = scratch.keep(filled.select("lang", "source", "term", "n", billionths("n", "total", "kinds").alias("p"), billionths("lang_n", "lang_total", "kinds").alias("q")), "dense")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    # the measure is the same both ways, so each two sources meet once a term
    met = dense.select("lang", "term", "source", "p").join(other, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    halves = met.groupBy("lang", "source", "item").agg(F.sum(divergence("p", "q")).alias("value"))
    both = halves.select("lang", "value", F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))))
    bare = groups.filter("kinds = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter(F.col("source") != F.col("item")).withColumn("value", F.lit(0).cast("long"))
    best = lambda rows, item: rows.select("*", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col(item))).alias("rank"))
    pairs = best(both.unionByName(none), "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    more = dense.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).withColumn("value", divergence("p", "q"))
    terms = best(more, "term").filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Each source of each language of ``documents`` against the others, and its ten most telling terms."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT doc_id, lang, source, unnest(terms) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS kinds, sum(n) AS total FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
x AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * l.kinds)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (v.n + 2)) // (l.total + 2 * l.kinds)::HUGEINT AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), y AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(y.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM x WHERE n > 0 AND p > q
), k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM k WHERE part = 'pair' OR rank <= 10
"""
