"""Include resolution and range extraction over captured TXT records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tokens(txt: str) -> Column:
    return F.explode(F.split(F.col(txt), " "))


def include_targets(records: DataFrame, name: str = "name", txt: str = "txt") -> DataFrame:
    """``(name, target)`` for every include token."""
    tokens = records.select(F.col(name).alias("name"), _tokens(txt).alias("token"))
    target = F.split_part("token", F.lit(":"), F.lit(2))
    return tokens.filter(F.col("token").contains("include")).select("name", target.alias("target")).distinct()


def resolve_includes(records: DataFrame, root: str | None = None, name: str = "name", txt: str = "txt") -> DataFrame:
    """Address tokens reached through one level of includes, per root name."""
    targets = include_targets(records, name, txt)
    if root is not None:
        targets = targets.filter(F.col("name") == root)
    addresses = (
        records.select(F.rtrim(F.col(name), F.lit(".")).alias("target"), _tokens(txt).alias("token"))
        .filter(F.col("token").contains("ip"))
        .distinct()
    )
    return targets.withColumn("target", F.rtrim("target", F.lit("."))).join(addresses, "target").select(
        "name", "target", "token"
    )
