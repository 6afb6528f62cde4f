"""Memory files of coding assistants, and the sessions' history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def memory_files(spark: SparkSession, root: str, scopes: DataFrame | None = None) -> DataFrame:
    """provider, scope, locator and content of each ``*/memory/*.md`` below ``root``.

    A folder's name is its project's path with dashes; ``scopes`` (munged, scope) gives the paths back, and a folder
    that isn't in it keeps its name. Files without text are left out.
    """
    f = spark.read.option("wholetext", True).text(f"{root.rstrip('/')}/*/memory/*.md").select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("content"))
    parts = F.split("at", "/")
    rows = f.filter(F.trim("content") != "").select(F.element_at(parts, -3).alias("folder"), F.concat_ws("/", F.slice(parts, -3, 3)).alias("locator"), "content")
    if scopes is not None:
        rows = rows.join(scopes.select(F.col("munged").alias("folder"), "scope").dropDuplicates(["folder"]), "folder", "left")
        return rows.select(F.lit("claude").alias("provider"), F.coalesce("scope", "folder").alias("scope"), "locator", "content")
    return rows.select(F.lit("claude").alias("provider"), F.col("folder").alias("scope"), "locator", "content")


def session_projects(spark: SparkSession, path: str) -> DataFrame:
    """Each session of a ``history.jsonl`` with a project it was in, once; lines that are broken or lack either are left out."""
    lines = spark.read.schema("sessionId string, project string").option("mode", "PERMISSIVE").json(path)
    return lines.filter("sessionId is not null and project is not null").select(F.col("sessionId").alias("session"), "project").distinct()
