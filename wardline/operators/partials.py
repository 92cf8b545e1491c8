"""Counts per key that are kept per file, so that only new files are read.

Each run counts the files that no earlier run has counted, and those that have
changed since, file by file.  A run's counts are written first and the list of
its files last; counts without such a list belong to a run that failed and are
left out.  The total is the sum of each file's latest counts: it is the same
whether the files came in one run or in many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_KIND = "path string, modificationTime timestamp, length bigint, run bigint"


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length) of the files below a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", "modificationTime", "length")


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(path)


def counted_files(spark: SparkSession, store: str) -> DataFrame:
    """The latest listing of every file counted so far."""
    rows = _stored(spark, f"{store}/files", FILE_KIND)
    latest = rows.groupBy("path").agg(F.max(F.struct("run", "modificationTime", "length")).alias("last"))
    return latest.select("path", "last.*")


def update_counts(
    spark: SparkSession, path: str, store: str, key: str, read: Callable[[list[str]], DataFrame], pattern: str = "*"
) -> list[str]:
    """Count the files below ``path`` that are new or have changed; returns them.

    ``read`` opens a list of files as rows with the column ``key``.
    """
    known = counted_files(spark, store)
    fresh = list_files(spark, path, pattern).join(known, ["path", "modificationTime", "length"], "left_anti")
    # The names of a folder's files are on the driver in any case, to plan the reading.
    rows = [tuple(r) for r in fresh.select("path", "modificationTime", "length").collect()]
    if not rows:
        return []
    run = (_stored(spark, f"{store}/files", FILE_KIND).agg(F.max("run")).first()[0] or 0) + 1
    names = [r[0] for r in rows]
    counts = read(names).groupBy(F.col("_metadata.file_path").alias("path"), F.col(key).cast("string").alias("key"))
    # A run that failed here before left counts under the same number; they are replaced.
    counts.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{store}/counts/run={run}")
    listing = spark.createDataFrame(rows, "path string, modificationTime timestamp, length bigint")
    listing.write.mode("overwrite").parquet(f"{store}/files/run={run}")
    return names


def total_counts(spark: SparkSession, store: str) -> DataFrame:
    """(key, n) over all files counted so far."""
    counts = _stored(spark, f"{store}/counts", "path string, key string, n bigint, run bigint")
    latest = counted_files(spark, store).select("path", "run")
    return counts.join(latest, ["path", "run"]).groupBy("key").agg(F.sum("n").alias("n"))
