"""JSON configuration from address lists, in documents of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.ip import long_to_ip
from wardline.operators.ranges import merge_ranges, split_by_bucket

LIST_ENTRIES = 1000


def score_override(ranges: DataFrame, content: str = "Other") -> DataFrame:
    """``{ip: {content: 0}, ...}``, one document per /24 that occurs.

    The documents have no address in common, so together they are the whole.
    Ranges are merged first and cut at /24 borders, so what is exchanged is one
    row per piece and not per address.
    """
    pieces = split_by_bucket(merge_ranges(ranges.select("lo", "hi")))
    in_blocks = pieces.withColumn("block", F.explode(F.sequence(F.shiftright("lo", 8), F.shiftright("hi", 8))))
    first = F.shiftleft("block", 8)
    addresses = F.sequence(F.greatest(F.col("lo"), first), F.least(F.col("hi"), first + 255))
    by_block = in_blocks.groupBy("block").agg(F.array_sort(F.flatten(F.collect_list(addresses))).alias("addresses"))
    entry = F.create_map(F.lit(content), F.lit(0))
    named = F.map_from_entries(F.transform("addresses", lambda a: F.struct(long_to_ip(a), entry)))
    return by_block.select(long_to_ip(first).alias("first_ip"), F.to_json(named).alias("document"))


def whitelist(codes: DataFrame, entries: DataFrame, heuristic: str, list_entries: int = LIST_ENTRIES) -> DataFrame:
    """``{heuristic: {code: [entry, ...]}}``: every code with the whole entry list.

    The list is first packed into parts of about ``list_entries`` by hash.  Codes
    are repeated once per part number and meet their part by equality, so the
    rows made are codes times parts and the work is spread over the parts.
    """
    listed = entries.select("entry").distinct()
    parts = listed.agg(F.greatest(F.ceil(F.count("*") / list_entries), F.lit(1)).cast("int").alias("n")).scalar()
    key = F.conv(F.substring(F.md5("entry"), 1, 8), 16, 10).cast("bigint")
    packed = (
        listed.withColumn("part", F.pmod(key, parts).cast("int"))
        .groupBy("part")
        .agg(F.array_sort(F.collect_list("entry")).alias("list"))
    )
    placed = codes.select("code").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    document = F.to_json(F.create_map(F.lit(heuristic), F.create_map("code", "list")))
    return placed.join(packed, "part").select("code", "part", document.alias("document"))
