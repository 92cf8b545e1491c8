"""Login activity per address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.timetokens import in_window
from wardline.operators.search import keep_listed
from wardline.operators.sketches import LG_K
from wardline.operators.skew import LIST_ITEMS, chunk_pairs, distinct_pairs, pair_counts


def _seen(logins: DataFrame, window: tuple[int, int] | None, ips: list | DataFrame | None) -> DataFrame:
    seen = logins.filter(F.col("ip").isNotNull())
    seen = seen.filter(in_window("ts", window)) if window else seen
    return seen if ips is None else keep_listed(seen, "ip", ips)


def login_counts(
    logins: DataFrame,
    window: tuple[int, int] | None = None,
    ips: list | DataFrame | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Distinct hosts and distinct mail hashes per address.

    ``approximate`` counts by sketches of bounded size: one aggregation without
    an exchange of every host and mail, for a relative error of about 0.8 %.
    """

    def distinct(column: str) -> Column:
        return F.hll_sketch_estimate(F.hll_sketch_agg(column, LG_K)) if approximate else F.count_distinct(column)

    return _seen(logins, window, ips).groupBy("ip").agg(
        distinct("host").alias("count_hosts"), distinct("email_hash").alias("count_emails")
    )


def login_profile(
    logins: DataFrame,
    window: tuple[int, int] | None = None,
    ips: list | DataFrame | None = None,
    list_items: int = LIST_ITEMS,
) -> DataFrame:
    """Counts per address and the sorted host list.

    A list of up to ``list_items`` hosts is one row with ``list_part`` 0; a longer
    one goes on in further rows of the same address.  Host counts and lists come
    from the same distinct pairs.
    """
    seen = _seen(logins, window, ips)
    pairs = distinct_pairs(seen, ["ip"], "host")
    hosts = pair_counts(pairs, ["ip"], "count_hosts")
    emails = seen.groupBy("ip").agg(F.count_distinct("email_hash").alias("count_emails"))
    lists = chunk_pairs(pairs, ["ip"], "host", "host_collection", "list_part", list_items)
    return emails.join(hosts, "ip", "left").join(lists, "ip", "left").select(
        "ip",
        F.coalesce("count_hosts", F.lit(0)).alias("count_hosts"),
        "count_emails",
        F.coalesce("host_collection", F.array().cast("array<string>")).alias("host_collection"),
        F.coalesce("list_part", F.lit(0)).alias("list_part"),
    )


def login_totals(counts: DataFrame) -> DataFrame:
    """Sums of the per-address counts; a host seen from two addresses counts twice."""
    return counts.agg(F.sum("count_hosts").alias("hosts"), F.sum("count_emails").alias("emails"))
