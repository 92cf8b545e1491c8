"""Reputation of addresses over four captured feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import feeds
from wardline.functions.ip import reverse_octets

# Columns of the result file.
RESULT_HEADER = (
    "IP",
    "IP-VOID-RESULTS",
    "PROJECT-HONEYPOT-RESULTS",
    "BAD-IPS-RESULTS",
    "STOP-FORUM-SPAM",
)


def _latest(feed: DataFrame, key: str, body: str, result: Column, out: str) -> DataFrame:
    """One result per key: of the last capture if there is a capture time."""
    if "captured_at" in feed.columns:
        one = feed.groupBy(key).agg(F.max(F.struct("captured_at", body)).alias("_m")).select(key, f"_m.{body}")
    else:
        one = feed.groupBy(key).agg(F.max(body).alias(body))
    return one.select(key, result.alias(out))


def consolidate(
    addresses: DataFrame, scans: DataFrame, threats: DataFrame, categories: DataFrame, spam: DataFrame
) -> DataFrame:
    """Each address with one result per feed, ``Not Listed`` by default.

    Feeds hold ``(ip, body)`` captures; the threat feed holds ``(reversed_ip,
    body)`` with the answer address as body.
    """
    ips = addresses.select("ip")
    threat = _latest(threats, "reversed_ip", "body", feeds.threat_result("body"), "threat")
    joined = (
        ips.withColumn("reversed_ip", reverse_octets("ip"))
        .join(_latest(scans, "ip", "body", feeds.scan_result("body"), "scan"), "ip", "left")
        .join(_latest(categories, "ip", "body", feeds.category_result("body"), "category"), "ip", "left")
        .join(_latest(spam, "ip", "body", feeds.spam_result("body"), "spam"), "ip", "left")
        .join(threat, "reversed_ip", "left")
    )
    results = [F.coalesce(c, F.lit(feeds.NOT_LISTED)).alias(c) for c in ("scan", "threat", "category", "spam")]
    return joined.select("ip", *results)


def as_result_file(consolidated: DataFrame) -> DataFrame:
    """Columns renamed to the header of the result file."""
    return consolidated.select("ip", "scan", "threat", "category", "spam").toDF(*RESULT_HEADER)
