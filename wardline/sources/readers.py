"""Readers for result files, logs, lists, JSON documents and archives."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.archives import MEMBER, SUFFIXES, read_archives

# Logger messages that a warehouse client mixes into its output.
NOISE_MESSAGES = (
    "Unable to load native-hadoop library for your platform...",
    "WARN: The method class org.apache.commons.logging.impl.SLF4JLogFactory#release() was invoked.",
    "WARN: Please see http://www.slf4j.org/codes.html#release for an explanation.",
)



def read_tsv(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """Tab-separated file with a header; every column is text.

    ``quoted=False`` reads result files whose values may hold bare quotes.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("escape", '"')
    return reader.option("quote", '"' if quoted else "").csv(path)


def read_space_log(spark: SparkSession, path: str, width: int = 73) -> DataFrame:
    """Space-separated log with quoted fields as ``_c0``, ``_c1``, ...

    The width is given, so a short first line does not decide it; missing fields
    are NULL and further ones are ignored.
    """
    schema = ", ".join(f"_c{i} string" for i in range(width))
    return spark.read.schema(schema).csv(path, sep=" ", quote='"', escape='"')


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One value per line, trailing white space removed, as column ``value``."""
    return spark.read.text(path).select(F.rtrim(F.col("value"), F.lit(" \t\r\n")).alias("value"))


def read_table(source: SparkSession | DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """A warehouse table by name, only the columns asked for."""
    df = source.table(name)
    return df.select(*columns) if columns else df


CLOUD_SCHEMA = "prefixes array<struct<service: string, ip_prefix: string>>"
PUBLISHED_SCHEMA = "list array<string>"


def cloud_prefixes(documents: DataFrame, text: str = "value", service: str | None = "EC2") -> DataFrame:
    """Prefixes of a provider's range document, one row each, for one service."""
    entries = documents.select(F.inline(F.from_json(F.col(text), CLOUD_SCHEMA)["prefixes"]))
    if service is not None:
        entries = entries.filter(F.col("service") == service)
    return entries.select(F.col("ip_prefix").alias("prefix"))


def published_prefixes(documents: DataFrame, text: str = "value") -> DataFrame:
    """Prefixes of a published list document."""
    return documents.select(F.explode(F.from_json(F.col(text), PUBLISHED_SCHEMA)["list"]).alias("prefix"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, one row per file, as column ``value``."""
    return spark.read.text(path, wholetext=True)


def is_noise(line: Column | str) -> Column:
    c = F.col(line) if isinstance(line, str) else line
    found = F.lit(False)
    for message in NOISE_MESSAGES:
        found = found | c.contains(message)
    return found


def drop_noise(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines without the known logger messages."""
    return lines.filter(~is_noise(line))


def keep_tabbed(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines that hold a tab, that is, data rows."""
    return lines.filter(F.col(line).contains("\t"))


def read_archive_lines(spark: SparkSession, path: str, member_text: str = MEMBER) -> DataFrame:
    """Lines of archives as ``(path, line_no, line)``, see ``read_archives``."""
    return read_archives(spark, path, member_text).drop("member")


def is_archive(path: str) -> bool:
    return os.path.splitext(path)[1] in SUFFIXES
