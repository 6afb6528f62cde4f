"""Retrieval evaluation: first hit's rank, hit rate and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """The rank of each case's first expected hit; null without one. ``cases``: name, engine, expected (id prefix); ``hits``: name, engine, rank, id, conversation_id."""
    all_cases = cases.select("name", "engine").distinct()
    met = hits.join(cases, ["name", "engine"]).filter(F.col("id").startswith(F.col("expected")) | F.col("conversation_id").startswith(F.col("expected")))
    return all_cases.join(met.groupBy("name", "engine").agg(F.min("rank").alias("rank")), ["name", "engine"], "left")


def summary(ranks: DataFrame) -> DataFrame:
    """Cases, hit rate and mean reciprocal rank of each engine."""
    return ranks.groupBy("engine").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def report(ranks: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Of each engine its runs, hits, hit rate, reciprocal rank and errors; a run that failed is no hit. ``errors``: name, engine, error."""
    bad = ranks.select("name", "engine").limit(0) if errors is None else errors.select("name", "engine").distinct()
    runs = ranks.select("name", "engine", "rank").join(bad, ["name", "engine"], "left_anti").select("engine", "rank", F.lit(0).alias("bad"))
    every = runs.unionByName(bad.select("engine", F.lit(None).cast(ranks.schema["rank"].dataType).alias("rank"), F.lit(1).alias("bad")))
    return every.groupBy("engine").agg(
        F.count(F.lit(1)).alias("runs"), F.count("rank").alias("hits"), F.round(F.count("rank") / F.count(F.lit(1)), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.sum("bad").alias("errors"))


def gate(reported: DataFrame, least: float = 0.0) -> DataFrame:
    """Each engine of a report with ``passes``: no run failed, and the hit rate is ``least`` or more."""
    return reported.withColumn("passes", (F.col("errors") == 0) & (F.col("hit_rate") >= least))


def ground(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Expected prefixes with how many ids each names; a case is sound when that is one."""
    short = cases.filter(F.length("expected") < 8).select("name", "expected", F.lit(0).cast("long").alias("n"))
    long = cases.filter(F.length("expected") >= 8)
    met = ids.select("id", F.explode(F.transform(F.sequence(F.lit(8), F.greatest(F.length("id"), F.lit(8))), lambda n: F.substring(F.col("id"), F.lit(1), n))).alias("expected")).distinct()
    return long.join(met, "expected", "left").groupBy("name", "expected").agg(F.count("id").alias("n")).unionByName(short)
