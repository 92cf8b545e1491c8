"""Hourly heuristic metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.timetokens import in_window

METRIC_PREFIX = "heuristics"


def heuristic_metrics(
    scores: DataFrame, datacenter: str, window: tuple[int, int] | None = None, prefix: str = METRIC_PREFIX
) -> DataFrame:
    """Distinct clients per production heuristic and time stamp.

    ``ts`` is in whole seconds; the window is closed at both ends.
    """
    seen = scores.filter(F.col("group_ids").like("%production%"))
    if window:
        seen = seen.filter(in_window("ts", window, closed=True))
    path = F.concat(F.lit(f"{prefix}."), F.col("heuristic_name"), F.lit(f".{datacenter}"))
    return seen.groupBy(path.alias("path"), F.substring(F.col("ts").cast("string"), 1, 10).alias("ts")).agg(
        F.count_distinct("client_id").alias("count_ips")
    ).select("path", "count_ips", "ts")


def sorted_metrics(points: DataFrame) -> DataFrame:
    return points.orderBy("ts", "path")
