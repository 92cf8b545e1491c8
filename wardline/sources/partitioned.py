"""Tables laid out by day and hour, and readings that open the asked hours only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
PLACE = ("day", "slot")


def place(ts: Column | str, width: int = 1) -> dict[str, Column]:
    """The partition of an epoch-millisecond time: its day, and its slot of ``width`` hours counted from the epoch."""
    if 24 % width:
        raise ValueError("a day must be cut into whole slots")
    ms = F.col(ts) if isinstance(ts, str) else ts
    return {"day": F.floor(ms / (24 * HOUR_MS)).cast("int"), "slot": F.floor(ms / (width * HOUR_MS)).cast("int")}


def write_by_hour(df: DataFrame, path: str, ts: str = "ts", width: int = 1, mode: str = "errorifexists") -> None:
    """Write ``df`` in one folder for each slot of ``width`` hours.

    Rows of a slot are brought together before they are written, so a slot is
    few files; one that is large is split between tasks by adaptive execution.
    """
    rows = df.withColumns(place(ts, width)).hint("rebalance", *PLACE)
    rows.write.mode(mode).partitionBy(*PLACE).parquet(path)


def read_by_hour(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table with its columns ``day`` and ``slot``; ``schema`` has the other columns."""
    return spark.read.schema(f"{schema}, day int, slot int").parquet(path)


def in_window(table: DataFrame, window: tuple[int, int], ts: str = "ts", width: int = 1) -> DataFrame:
    """Rows of a half-open window; folders beside it are not listed in the plan."""
    low, high = window
    inside = F.lit(True)
    for name, size in zip(PLACE, (24 * HOUR_MS, width * HOUR_MS), strict=True):
        inside = inside & (F.col(name) >= low // size) & (F.col(name) <= (high - 1) // size)
    return table.where(inside & (F.col(ts) >= low) & (F.col(ts) < high)).drop(*PLACE)


def in_hours(table: DataFrame, hours: DataFrame, ts: str = "ts", column: str = "hour", width: int = 1) -> DataFrame:
    """Rows of the listed hours (``column`` of ``hours``: epoch milliseconds of their starts).

    The list is known only when the query runs: it prunes the folders then.  It
    has one row an hour at most, so it is small for any period.
    """
    at = F.col(column)
    asked = hours.select(*[c.alias(n) for n, c in place(at, width).items()], F.floor(at / HOUR_MS).alias("at_")).distinct()
    # Always true; Spark prunes by a list only if a comparison shows that it is a selection.
    asked = asked.where(F.col("at_") >= F.col("day") * 24)
    rows = table.withColumn("at_", F.floor(F.col(ts) / HOUR_MS))
    return rows.join(F.broadcast(asked), [*PLACE, "at_"], "left_semi").drop(*PLACE, "at_")
