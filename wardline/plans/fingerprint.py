"""TCP fingerprints to link type, signature text and operating system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import tcp
from wardline.operators.signatures import match_signatures


def _decoded(df: DataFrame, fp: str) -> DataFrame:
    """Add the decoded struct.  The explode keeps later filters on its fields from
    being pushed down as further copies of the decoding."""
    return df.withColumn("decoded", F.explode(F.array(tcp.decode(fp))))


def decode_fingerprints(df: DataFrame, fp: str = "fp") -> DataFrame:
    """Every row with its decoded fields, link type and both signature texts."""
    d = F.col("decoded")
    return _decoded(df, fp).select(
        *df.columns,
        d["ip_version"].alias("ip_version"),
        d["ttl"].alias("ttl"),
        d["distance"].alias("distance"),
        d["initial_ttl"].alias("initial_ttl"),
        d["window"].alias("window"),
        d["mss"].alias("mss"),
        d["scale"].alias("scale"),
        d["quirk_meanings"].alias("quirk_meanings"),
        (d["mss"] + 40).alias("mtu"),
        tcp.mtu_type(d["mss"] + 40).alias("link_type"),
        tcp.raw_signature(d).alias("raw_signature"),
        tcp.general_signature(d).alias("general_signature"),
    )


def operating_systems(df: DataFrame, fp: str = "fp", strict: bool = False) -> DataFrame:
    """One row per input row and fitting system signature."""
    return match_signatures(_decoded(df, fp), "decoded", strict).drop("decoded")
