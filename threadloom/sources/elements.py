"""JSON files that are one list, read by its elements: files of any size, by many tasks each.

A file is cut at each closing brace by Spark's text reader, which splits it like any text. Whether such a cut ends an
element depends on all that is before it, so each fragment says what it does to the state (within a string or not, depth)
for both states that it may start in; these are summed within a split, splits are chained by one row each, and fragments
between two ends at the list's own level are joined. What is together in memory is one element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.runtime import Scratch


def _net(text: Column) -> Column:
    """Opening less closing brackets."""
    return F.length(F.translate(text, "}]", "")) - F.length(F.translate(text, "{[", ""))


def _chosen(start: Column, out: Column, within: Column) -> Column:
    return F.when(start % 2 == 0, out).otherwise(within)


def elements(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Elements (path, at, element) of the lists in files whose names fit ``pattern``, and faults (path, error).

    ``at`` orders a file's elements. An element is an object; other values, what is behind the last comma of a file that
    breaks off, and files that aren't lists are faults. Empty files and empty lists have neither. Elements are checked
    no further: a broken one is for its reader to tell.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "}").text(path)
    cut = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value", F.col("_metadata.file_size").alias("size"))
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    side = lambda odd: F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    quotes = F.size(parts) - 1
    told = cut.withColumn("q", quotes).withColumn("out", _net(side(0)) - F.when(F.col("q") % 2 == 0, 1).otherwise(0)).withColumn("within", _net(side(1)) - F.when(F.col("q") % 2 == 1, 1).otherwise(0))
    own = Window.partitionBy("path", "block").orderBy("n")
    so_far, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("s", F.coalesce(F.sum("q").over(before), F.lit(0)))
    told = told.withColumn("d0", F.sum(_chosen(F.col("s"), F.col("out"), F.col("within"))).over(so_far)).withColumn("d1", F.sum(_chosen(F.col("s") + 1, F.col("out"), F.col("within"))).over(so_far))
    fragments = Scratch(spark, "elements").keep(told.select("path", "block", "n", "value", "size", (F.col("s") + F.col("q")).alias("e"), "d0", "d1"), "fragments")

    # a row a split: how many quotes and which depth are before it; and whether it ends with a fragment that no brace ends
    splits = fragments.groupBy("path", "block").agg(*[F.max_by(c, "n").alias(c) for c in ("e", "d0", "d1")], F.min_by("value", "n").alias("head"), F.max("n").alias("tail"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.first("size").alias("size"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("h", F.coalesce(F.sum("e").over(earlier), F.lit(0))).withColumn("base", F.coalesce(F.sum(_chosen(F.col("h"), F.col("d0"), F.col("d1"))).over(earlier), F.lit(0)))
    is_list = F.col("head").rlike(r"^\x{FEFF}?\s*\[")
    whole = Window.partitionBy("path")
    cut_off = (F.sum("bytes").over(whole) > F.col("size")) & (F.col("block") == F.max("block").over(whole))
    lists = splits.withColumn("list", F.first(is_list).over(whole.orderBy("block"))).withColumn("tail", F.when(cut_off, F.col("tail"))).drop("e", "d0", "d1", "head", "bytes", "size")

    placed = fragments.join(lists, ["path", "block"]).filter("list")
    ends = ~F.col("n").eqNullSafe(F.col("tail")) & ((F.col("e") + F.col("h")) % 2 == 0) & (F.col("base") + _chosen(F.col("h"), F.col("d0"), F.col("d1")) == 1)
    placed = placed.select("path", "block", "n", "value", ends.alias("ends"))
    place = F.struct("block", "n")
    # what a split begins with belongs to the element after the last end of an earlier split
    last = placed.filter("ends").groupBy("path", "block").agg(F.max(place).alias("last"))
    opened = lists.select("path", "block").join(last, ["path", "block"], "left").withColumn("open", F.max("last").over(earlier)).select("path", "block", "open")
    at = F.coalesce(F.max(F.when(F.col("ends"), place)).over(before), F.col("open"))
    pieces = placed.join(opened, ["path", "block"]).withColumn("at", F.coalesce(at, F.struct(F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("n"))))
    joined = pieces.groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("l"), F.bool_or("ends").alias("whole"))
    text = F.array_join(F.transform("l", lambda x: x["value"]), "}")
    text = F.when(F.col("at.block") < 0, F.regexp_replace(text, r"^\x{FEFF}?\s*\[", "")).otherwise(F.regexp_replace(text, r"^\s*,", ""))
    found = joined.select("path", "at", F.trim(text).alias("element"), "whole")
    rest = found.filter(~F.col("whole") & ~F.col("element").rlike(r"^\s*\]\s*$")).select("path", F.concat(F.lit("no whole element: "), F.substring("element", 1, 80)).alias("error"))
    other = lists.filter(~F.col("list")).select("path", F.lit("not a list").alias("error")).distinct()
    return found.filter("whole").select("path", "at", F.concat("element", F.lit("}")).alias("element")), rest.unionByName(other)
