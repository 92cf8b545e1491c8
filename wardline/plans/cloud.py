"""Cloud ranges: drift of published lists and membership of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.ip import address_bounds
from wardline.operators.diff import drift, drift_summary
from wardline.operators.ranges import membership
from wardline.sources.readers import cloud_prefixes, published_prefixes


def as_ranges(entries: DataFrame, column: str = "value") -> DataFrame:
    """Addresses, CIDR blocks and ranges in text form as lo and hi; others dropped."""
    bounds = entries.select(address_bounds(column).alias("b"))
    return bounds.filter(F.col("b").isNotNull()).select("b.lo", "b.hi")


def range_drift(published: DataFrame, provider: DataFrame, service: str | None = "EC2") -> DataFrame:
    """Prefixes added to, removed from or kept in the published list."""
    return drift(published_prefixes(published), cloud_prefixes(provider, service=service), ["prefix"])


def range_drift_summary(published: DataFrame, provider: DataFrame, service: str | None = "EC2") -> DataFrame:
    return drift_summary(published_prefixes(published), cloud_prefixes(provider, service=service), ["prefix"])


def cloud_membership(addresses: DataFrame, entries: DataFrame, ip: str = "ip", column: str = "value", unique: bool = False) -> DataFrame:
    """Every address row labelled IN or NOT IN."""
    labelled = membership(addresses, as_ranges(entries, column), ip, unique)
    label = F.when(F.col("in_set"), "IN").otherwise("NOT IN")
    return labelled.withColumn("label", label).drop("in_set")
