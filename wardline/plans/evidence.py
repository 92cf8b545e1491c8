"""Evidence behind detected attacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.ranges import enrich
from wardline.operators.search import keep_listed
from wardline.operators.skew import LIST_ITEMS, chunked_lists


def gather_evidence(
    scores: DataFrame,
    properties: DataFrame,
    host_stats: DataFrame,
    networks: DataFrame,
    hours: DataFrame | list | None = None,
    ips: DataFrame | list | None = None,
    list_items: int = LIST_ITEMS,
) -> DataFrame:
    """Scores of production heuristics with evidence, hosts and network owner.

    The hour list restricts all three inputs before they are joined.  Hosts of an
    event are a sorted list, cut into further rows (``list_part``) when very long.
    """

    def in_hours(df: DataFrame) -> DataFrame:
        return df if hours is None else keep_listed(df, "ts", hours, small=False)

    wanted = in_hours(scores).filter(
        ~F.col("heuristic_name").like("%Score%") & F.col("group_ids").like("%production%")
    )
    if ips is not None:
        wanted = keep_listed(wanted, "client_id", ips)
    hosts = chunked_lists(in_hours(host_stats), ["id", "ts"], "host", "hosts", "list_part", list_items)
    joined = (
        wanted.select("id", "ts", F.col("client_id").alias("ip"), "heuristic_name", "score")
        .join(in_hours(properties).select("id", "ts", "key", "value"), ["id", "ts"])
        .join(hosts, ["id", "ts"], "left")
    )
    owners = networks.select("lo", "prefix_len", "company", "domain")
    addresses = wanted.select(F.col("client_id").alias("ip")).distinct()
    return enrich(joined, owners, addresses=addresses).select(
        "ip", "company", "domain", "heuristic_name", "score", "key", "value", "hosts",
        F.coalesce("list_part", F.lit(0)).alias("list_part"), "ts",
    )
