"""Differences between two row sets, in one grouped pass over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _side_counts(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    tagged = old.select(*columns, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        new.select(*columns, F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    return tagged.groupBy(*columns).agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))


def drift(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Each distinct row with ``status`` added, removed or unchanged.

    Order does not matter.  A row whose number of copies changed counts as added
    or removed, and ``change`` says by how many copies.
    """
    change = F.col("_new") - F.col("_old")
    status = F.when(change > 0, "added").when(change < 0, "removed").otherwise("unchanged")
    return _side_counts(old, new, columns).select(*columns, status.alias("status"), change.alias("change"))


def drift_summary(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Number of added, removed and unchanged rows, and whether the sets are equal."""
    rows = drift(old, new, columns)
    counted = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "unchanged")]
    equal = F.count_if(F.col("status") != "unchanged") == 0
    return rows.agg(*counted, equal.alias("equal"))


def symmetric_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that occur exactly once in both sides taken together."""
    return _side_counts(left, right, columns).filter(F.col("_old") + F.col("_new") == 1).select(*columns)
