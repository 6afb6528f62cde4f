"""URL filters by a character language-model ratio: DataFrame operations only.

Two smoothed variable-order Markov models of characters, one of accepted and one of rejected URLs, score each URL by the
difference of its log-likelihoods, divided by its length. A character's probability blends contexts from none to the
longest by how often and in how many ways each context went on (Witten-Bell), so a context that was never seen gives
way to a shorter one. The threshold is calibrated on labelled URLs kept out of the counts: it is where the mean of both
classes' hit rates is best. Rules on host and path come first; those that they decide are the labelled URLs of the query.

Characters are kept as they are. Contexts are a table that grows with the input: a row for each gram of the pages, and
a longer context for each ``GROWTH``-fold of labelled characters. What calibrates the threshold is scored by counts
without it; then all labelled URLs are counted. Both take the same pass. Grams are counted before they are joined, and
those in more than one of ``HOT`` places are broadcast, so that no key's rows meet in one task.

Defined results: a null url, or one without ``://``, has an empty host and path. An empty or null url, and any url
when one of the classes has no labelled URL, is allowed unless a rule says otherwise. Of rules that fit the longest
wins, then the one with the longer host, then the first in order. Repeated rows are judged alike; an empty table gives
an empty result; the caller's row is carried in a struct, so that no name of it
can clash; a column ``score`` or ``verdict`` of it gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.runtime import Scratch

#: The character before a URL's first.
BEFORE = "\x00"
#: Contexts are longer by a character for so many times as many labelled characters; two at least.
GROWTH = 16
#: Grams in more than one of so many places are broadcast: at most so many rows.
HOT = 4096
#: Characters of a URL that are taken apart at once.
PIECE = 256
#: One labelled URL in so many calibrates the threshold.
FOLDS = 5
#: The four counts of a gram: in accepted and rejected URLs, without those that calibrate and with them.
COUNTS = ("good", "bad", "all_good", "all_bad")
#: Ratios are added up in billionths.
UNITS = 1e9
#: Scores are told apart to a thousandth when calibrating, within this range.
STEPS, RANGE = 1000, 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, in ASCII lower case, and the path of ``url``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits best, and its verdict; null without one. ``rules`` is an argument, so of a caller's size."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if verdict is None else verdict)


def threshold(calibration: DataFrame) -> DataFrame:
    """One row with ``cut``: the score from which URLs are accepted."""
    bins = calibration.filter(F.col("_score").isNotNull()).select("_good", F.floor(F.greatest(F.least(F.col("_score"), F.lit(RANGE)), F.lit(-RANGE)) * STEPS).alias("bin"))
    counts = bins.groupBy("bin").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"))  # at most 2 * RANGE * STEPS rows
    before, everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # of a class that calibrates nothing the rate is 0 everywhere
    kept_out = F.try_divide(F.coalesce(F.sum("bad").over(before), F.lit(0)), F.sum("bad").over(everything))
    let_in = 1 - F.try_divide(F.coalesce(F.sum("good").over(before), F.lit(0)), F.sum("good").over(everything))
    rated = counts.select("bin", F.coalesce(kept_out, F.lit(0.0)).alias("t"), F.coalesce(let_in, F.lit(0.0)).alias("u"))
    return rated.agg((F.max_by("bin", F.struct(F.round(F.col("t") + F.col("u"), 9), -F.col("bin"))) / STEPS).alias("cut"))


def order_for(letters: int) -> int:
    """The longest context that is counted over so many labelled characters."""
    order = 2
    while GROWTH ** (order + 1) <= letters:
        order += 1
    return order


def places(rows: DataFrame, url: str, order: int) -> DataFrame:
    """For each character of each url: ``_row``, ``g``, that is it and the ``order`` characters before it, and the row's ``COUNTS``."""
    pieces = rows.filter(F.length(url) > 0).select("_row", *COUNTS, F.concat(F.lit(BEFORE * order), url).alias("all"), F.explode(F.sequence(F.lit(1), F.length(url), F.lit(PIECE))).alias("at"))
    cut = pieces.select("_row", *COUNTS, F.substring("all", F.col("at"), F.lit(PIECE + order)).alias("piece"))
    each = cut.select("_row", *COUNTS, "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - order)).alias("i"))
    return each.select("_row", *COUNTS, F.substring("piece", F.col("i"), F.lit(order + 1)).alias("g"))


def blended(grams: DataFrame, order: int) -> DataFrame:
    """``g``, ``n`` and the probability of its last character by each of ``COUNTS``, for each of ``grams``."""
    lower = None
    for k in range(order + 1):
        # contexts of k characters: the last k + 1 of each gram
        short = grams.groupBy(F.substring("g", order - k + 1, k + 1).alias("s")).agg(*[F.sum(c).alias(c) for c in (*COUNTS, "n")])
        own = Window.partitionBy(F.substring("s", 1, k)) if k else Window.partitionBy()  # without context, a row for each character there is
        seen = short.select("*", *[F.sum(c).over(own).alias(f"seen_{c}") for c in COUNTS], *[F.sum((F.col(c) > 0).cast("long")).over(own).alias(f"kinds_{c}") for c in COUNTS], F.count(F.lit(1)).over(own).alias("size"))
        below = {c: 1 / F.col("size") for c in COUNTS}
        if lower is not None:
            seen = seen.join(lower.select(F.col("s").alias("l"), *[F.col(f"p_{c}").alias(f"l_{c}") for c in COUNTS]), F.substring("s", 2, k) == F.col("l"))
            below = {c: F.col(f"l_{c}") for c in COUNTS}
        p = lambda c: F.when(F.col(f"seen_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * below[c]) / (F.col(f"seen_{c}") + F.col(f"kinds_{c}"))).otherwise(below[c])  # noqa: B023, E731
        lower = seen.select("s", "n", *[p(c).alias(f"p_{c}") for c in COUNTS])
    return lower.withColumnRenamed("s", "g")


def judge_by_contexts(df: DataFrame, url: str = "url", good_col: str = "_good", fold_col: str = "_fold") -> DataFrame:
    """``df`` with ``score`` and ``verdict``, less ``good_col``, which is null where a url isn't labelled, and ``fold_col``, a number."""
    scratch = Scratch(df.sparkSession, "url-contexts")
    good, calibrates = F.col("_good"), F.col("_fold") % FOLDS == 0
    is_, counted = lambda c: F.coalesce(c, F.lit(False)).cast("int"), {"good": good & ~calibrates, "bad": ~good & ~calibrates, "all_good": good, "all_bad": ~good}
    carried = [c for c in df.columns if c not in (good_col, fold_col, "score", "verdict")]
    named = df.select(F.struct(*[F.col(c) for c in carried]).alias("_whole"), F.col(url).alias("_url"), F.col(good_col).alias("_good"), F.col(fold_col).alias("_fold"))
    numbered = named.withColumn("_row", F.monotonically_increasing_id()).withColumn("_calibrates", good.isNotNull() & calibrates)
    # written, so that a row's number stays, and pages' other columns aren't read again
    rows = scratch.keep(numbered.select("*", *[is_(counted[c]).alias(c) for c in COUNTS]), "rows")
    size = F.length("_url").cast("long")
    letters = rows.agg(F.sum(size).alias("n"), *[F.sum(size * F.col(c)).alias(c) for c in COUNTS]).first()
    order, has = order_for((letters["all_good"] or 0) + (letters["all_bad"] or 0)), lambda a, b: F.lit(bool(letters[a] and letters[b]))
    found = places(rows, "_url", order)
    grams = scratch.keep(found.groupBy("g").agg(*[F.sum(c).alias(c) for c in COUNTS], F.count(F.lit(1)).alias("n")), "grams")
    # whole numbers, so that sums don't depend on the order of rows
    ratio = lambda a, b: F.round((F.log(f"p_{a}") - F.log(f"p_{b}")) * UNITS).cast("long")
    model = scratch.keep(blended(grams, order).select("g", "n", ratio("good", "bad").alias("x"), ratio("all_good", "all_bad").alias("y")), "model")
    often = F.col("n") > F.lit((letters["n"] or 0) // HOT)
    hot = F.broadcast(model.filter(often).select("g", "x", "y"))
    known = found.select("_row", "g")
    parts = known.join(hot, "g").select("_row", "x", "y").unionByName(known.join(hot, "g", "left_anti").join(model.filter(~often).select("g", "x", "y"), "g").select("_row", "x", "y"))
    sums = parts.groupBy("_row").agg((F.sum("x") / F.count(F.lit(1)) / UNITS).alias("_held"), (F.sum("y") / F.count(F.lit(1)) / UNITS).alias("_score"))
    scores = scratch.keep(sums, "scores").select("_row", F.when(has("good", "bad"), F.col("_held")).alias("_held"), F.when(has("all_good", "all_bad"), F.col("_score")).alias("_score"))
    placed = rows.join(scores, "_row", "left")
    cut = scratch.keep(threshold(placed.filter("_calibrates").select("_good", F.col("_held").alias("_score"))), "cut")
    out = placed.withColumn("_cut", F.coalesce(cut.scalar(), F.lit(0.0))).withColumn("score", F.col("_score"))
    return out.select("_whole.*", "score", F.when(F.col("_score") < F.col("_cut"), "block").otherwise("allow").alias("verdict"))


def op8_letter_ratio(spark, sf_dir: str) -> DataFrame:
    """A verdict for every url of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    placed = pages.withColumn("host", host).withColumn("path", path)
    rule, says = by_rules(F.col("host"), F.col("path"), RULES)
    ruled = placed.withColumn("rule", rule).withColumn("_says", says)
    labelled = ruled.withColumn("_good", F.col("_says") == "allow").withColumn("_fold", F.crc32(F.col("url").cast("binary")))
    return judge_by_contexts(labelled).select("page_id", "host", "path", "rule", F.coalesce("_says", "verdict").alias("verdict"), F.round("score", 6).alias("score"))
