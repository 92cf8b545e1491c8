"""Approximate distinct counts from stored, mergeable sketches.

Events are reduced once to a HyperLogLog sketch for each hour and key.  Sketches
merge: those of any hours give the distinct count of the whole window, and the
same hour merged twice changes nothing.  A store of sketches is partitioned by
day, so a window reads the days it touches and no events at all.

An hour's sketches are written under the load they came from.  A repeated load
replaces its own files, and hours that arrive in several loads are merged when
they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
# Relative standard error of about 0.8 %; a sketch takes some 8 KB at most.
LG_K = 14
STORE_COLUMNS = ("hour", "sketch", "n", "load_id", "day")


def hourly_sketches(events: DataFrame, keys: list[str], value: str, ts: str = "ts", lg_k: int = LG_K) -> DataFrame:
    """(keys, hour, sketch, n): the distinct values of every key and hour, and its rows; null values do not count.

    ``ts`` is in epoch milliseconds; ``hour`` is the hour's start.
    """
    hour = (F.floor(F.col(ts) / HOUR_MS) * HOUR_MS).cast("bigint")
    return events.groupBy(*keys, hour.alias("hour")).agg(
        F.hll_sketch_agg(F.col(value).cast("string"), lg_k).alias("sketch"), F.count("*").alias("n")
    )


def store_sketches(sketches: DataFrame, path: str, load_id: str) -> None:
    """Write one load's hours; the same load again replaces them."""
    spark = sketches.sparkSession
    rows = sketches.withColumns({"load_id": F.lit(load_id), "day": (F.floor(F.col("hour") / DAY_MS)).cast("int")})
    # One file a day and load: the tasks that hold rows of a day send them on together.
    rows = rows.repartition("day")
    writer = rows.write.mode("overwrite").partitionBy("load_id", "day").option("partitionOverwriteMode", "dynamic")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/load_id={_escaped(spark, load_id)}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # Days that the load has no more go too.
    if store.exists(folder):
        store.delete(folder, True)
    writer.parquet(path)


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def read_sketches(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """The store as a table; ``keys`` are its key columns with their types."""
    return spark.read.schema(f"{keys}, hour bigint, sketch binary, n bigint, load_id string, day int").parquet(path)


def _whole_hours(window: tuple[int, int]) -> None:
    if any(bound % HOUR_MS for bound in window):
        raise ValueError("sketches answer windows of whole hours")


def stored_window(stored: DataFrame, window: tuple[int, int]) -> DataFrame:
    """The stored rows of a half-open window of whole hours; other days are not read."""
    _whole_hours(window)
    low, high = window
    days = (F.col("day") >= low // DAY_MS) & (F.col("day") <= (high - 1) // DAY_MS)
    return stored.where(days & (F.col("hour") >= low) & (F.col("hour") < high))


def distinct_count(sketch: Column) -> Column:
    """Distinct values of a group's sketches together."""
    return F.hll_sketch_estimate(F.hll_union_agg(sketch)).cast("bigint")


def window_counts(stored: DataFrame, window: tuple[int, int], keys: list[str]) -> DataFrame:
    """(keys, n, about): rows and distinct values of any of the stored keys over a window.

    ``keys`` may be fewer than those the sketches were made for, none included:
    sketches merge over what is left out, and a value counts once.
    """
    rows = stored_window(stored, window)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), distinct_count(F.col("sketch")).alias("about"))


def compact(stored: DataFrame) -> DataFrame:
    """One row for each key and hour, however many loads brought it."""
    keys = [c for c in stored.columns if c not in STORE_COLUMNS]
    return stored.groupBy(*keys, "hour").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))
