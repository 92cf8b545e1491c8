"""Address tokens as users type them: listing them and finding them in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.ip import address_bounds, long_to_ip
from wardline.operators.ranges import expand, merge_ranges
from wardline.operators.rows import read_numbered_lines
from wardline.operators.search import search_lines, with_lines
from wardline.plans.cloud import as_ranges
from wardline.sources.readers import is_archive, read_archive_lines


def tokens_frame(spark: SparkSession, tokens: list[str]) -> DataFrame:
    """A short list of tokens (addresses, CIDR blocks, ranges) as one column."""
    return spark.createDataFrame([(t,) for t in tokens], "value string")


def list_addresses(tokens: DataFrame, column: str = "value") -> DataFrame:
    """Every distinct address of the tokens; unusable tokens give none."""
    merged = merge_ranges(as_ranges(tokens, column))
    return expand(merged).select(long_to_ip("address").alias("ip"))


def unusable_tokens(tokens: DataFrame, column: str = "value") -> DataFrame:
    """Tokens that are no address, block or range."""
    return tokens.filter(address_bounds(column).isNull())


def search_files(spark: SparkSession, path: str, tokens: DataFrame, column: str = "value") -> DataFrame:
    """``(path, line_no, ip, line)`` for listed addresses in text files or archives."""
    lines = read_archive_lines(spark, path) if is_archive(path) else read_numbered_lines(spark, path).drop("row_no")
    keys = ["path", "line_no"]
    hits = search_lines(lines, list_addresses(tokens, column), keys)
    return with_lines(hits, lines, keys).select("path", "line_no", "ip", F.col("line"))
