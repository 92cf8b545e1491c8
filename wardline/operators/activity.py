"""Counting per address and activity profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.timetokens import DAY_MS


def count_by(df: DataFrame, *keys: str, out: str = "count") -> DataFrame:
    """Rows per key over any number of input files (partial, then final counts)."""
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def active_days(df: DataFrame, ip: str = "ip", ts: str = "ts") -> DataFrame:
    """Per address the active days, and the inactive days between the first and last."""
    day = F.floor(F.col(ts) / DAY_MS).cast("bigint")
    days = df.select(ip, day.alias("_day")).distinct()
    span = F.max("_day") - F.min("_day") + 1
    active = F.count("*")
    return days.groupBy(ip).agg(active.alias("num_days"), (span - active).alias("days_gap"))


def activity_profile(df: DataFrame, ip: str = "ip", ts: str = "ts") -> DataFrame:
    """Number of addresses per pair of active days and gap days."""
    return active_days(df, ip, ts).groupBy("num_days", "days_gap").agg(F.count("*").alias("num_ips"))


def first_row_per(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Given columns of the first row per key in the given order.

    A minimum over one struct, so rows are reduced before the exchange.
    """
    rest = [c for c in columns if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in columns])


def distinct_share(df: DataFrame, item: str, groups: list[str]) -> DataFrame:
    """``(kind, value, items)``: number of distinct items per value of each group column."""
    kinds: list[Column] = [F.struct(F.lit(g).alias("kind"), F.col(g).alias("value")) for g in groups]
    single = df.select(item, *groups).distinct()
    return (
        single.select(F.explode(F.array(*kinds)).alias("k"))
        .groupBy("k.kind", "k.value")
        .agg(F.count("*").alias("items"))
    )
