"""Joins of many rows with one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than 1/HOT_SHARE of all rows: at most HOT_SHARE keys are, whatever the input.
HOT_SHARE = 65_536


def attach(rows: DataFrame, values: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``values`` on ``key``, nulls being equal.

    ``values`` has one row a key; its ``weight`` is how many of ``rows`` have that key, and goes. Hot keys are
    broadcast, so their rows stay where they are; all others are shuffled, and none of them is large. Both tables are
    read twice, so they should be written ones.
    """
    total = values.agg(F.sum(weight)).first()[0] or 0
    mine = values.withColumnRenamed(key, "_other")
    same, often = F.col(key).eqNullSafe(F.col("_other")), F.col(weight) > F.lit(total // HOT_SHARE)
    hot, rest = F.broadcast(mine.filter(often).drop(weight)), mine.filter(~often).drop(weight)
    found = rows.join(hot, same).drop("_other")
    return found.unionByName(rows.join(hot.select("_other"), same, "left_anti").join(rest, same).drop("_other"))
