"""Value lists that stay bounded when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Longest list put into one row; a longer list continues in further rows.
LIST_ITEMS = 10_000


def chunked_lists(
    df: DataFrame, keys: list[str], value: str, out: str, part: str, list_items: int = LIST_ITEMS
) -> DataFrame:
    """Sorted distinct values per key as arrays of bounded length.

    A key with up to ``list_items`` values gives one row with ``part = 0``.  A
    larger one is cut by value hash into rows of about half that length, so no
    task ever holds a whole hot list and nothing is dropped.
    """
    return chunk_pairs(distinct_pairs(df, keys, value), keys, value, out, part, list_items)


def distinct_pairs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, value).filter(F.col(value).isNotNull()).distinct()


def chunk_pairs(
    pairs: DataFrame, keys: list[str], value: str, out: str, part: str, list_items: int = LIST_ITEMS
) -> DataFrame:
    """:func:`chunked_lists` on pairs that are distinct already."""
    # A hash stands for the key, NULL included.  Should two keys share a hash, the
    # smaller one is merely cut as well.
    parts = F.ceil(F.col("_n") / (list_items / 2))
    sizes = pair_counts(pairs, keys, "_n").filter(F.col("_n") > list_items)
    large = sizes.select(F.xxhash64(*keys).alias("_key"), parts.alias("_parts"))
    one_each = large.groupBy("_key").agg(F.max("_parts").alias("_parts"))
    tagged = pairs.withColumn("_key", F.xxhash64(*keys)).join(one_each, "_key", "left")
    chunk = F.coalesce(F.pmod(F.xxhash64(value), F.col("_parts")), F.lit(0)).cast("int")
    # Grouping without the hash makes Spark exchange by key and part, so the parts
    # of a hot list go to different tasks.
    lists = tagged.withColumn(part, chunk).groupBy(*keys, part)
    return lists.agg(F.array_sort(F.collect_list(value)).alias(out))


def pair_counts(pairs: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Number of distinct values per key."""
    return pairs.groupBy(*keys).agg(F.count("*").alias(out))
