"""Hourly heuristic metrics over a stream."""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.plans.metrics import METRIC_PREFIX

HOUR = "1 hour"


def hourly_clients(
    scores: DataFrame, datacenter: str, at: str = "at", delay: str = HOUR, prefix: str = METRIC_PREFIX
) -> DataFrame:
    """Distinct clients per production heuristic and hour of a stream.

    Repeats of a client within an hour are removed first, by a state that the
    watermark clears, so the count is exact and its state is spread over clients
    and not held per heuristic.  An hour is emitted once it is ``delay`` old.
    """
    seen = scores.filter(F.col("group_ids").like("%production%")).withWatermark(at, delay)
    once = seen.select(F.window(at, HOUR).alias("hour"), "heuristic_name", "client_id").dropDuplicates()
    counted = once.groupBy(F.window(F.window_time("hour"), HOUR).alias("hour"), "heuristic_name").agg(
        F.count("client_id").alias("count_ips")
    )
    path = F.concat(F.lit(f"{prefix}."), F.col("heuristic_name"), F.lit(f".{datacenter}"))
    return counted.select(path.alias("path"), "count_ips", F.unix_seconds("hour.start").alias("ts"))


FIRST_SEEN = "path string, ts bigint, client_id string, batch bigint, day int"


class HourlyCounts:
    """A stream's exact hourly client counts, open hours and late rows included.

    Each micro-batch keeps the clients that it meets first in an hour, and sends
    their numbers on; a point's value is the sum over the batches.  Earlier
    clients are looked up in the days that the batch touches only: the store is
    partitioned by batch and day.  A batch writes its own folder and reads only
    those of earlier batches, so a batch that is run again after a failure writes
    the same rows once more and counts nothing twice.  There is no watermark:
    a row counts however late it is.
    """

    def __init__(self, folder: str, datacenter: str, at: str = "at", prefix: str = METRIC_PREFIX):
        self.folder, self.datacenter, self.at, self.prefix = folder.rstrip("/"), datacenter, at, prefix

    def seen(self, spark: SparkSession) -> DataFrame:
        """First sightings: the client of a path and hour, and the batch that met it."""
        path = f"{self.folder}/clients"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], FIRST_SEEN)
        return spark.read.schema(FIRST_SEEN).parquet(path)

    def add(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch: ``rows`` has the stream's columns."""
        spark = rows.sparkSession
        name = F.concat(F.lit(f"{self.prefix}."), F.col("heuristic_name"), F.lit(f".{self.datacenter}"))
        second = F.unix_seconds(F.col(self.at))
        hour, day = (F.floor(second / width).cast("bigint") for width in (3600, 86400))
        met = rows.filter(F.col("group_ids").like("%production%") & F.col(self.at).isNotNull()).select(
            name.alias("path"), (hour * 3600).alias("ts"), F.col("client_id").cast("string").alias("client_id"), day.cast("int").alias("day")
        )
        # The days of a batch are few; they prune the store's partitions.
        met = met.distinct().persist(StorageLevel.DISK_ONLY)
        try:
            days = [r[0] for r in met.select("day").distinct().collect()]
            earlier = self.seen(spark).filter((F.col("batch") < batch) & F.col("day").isin(days)).drop("batch")
            same = [F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("path", "ts", "client_id")]
            fresh = met.alias("m").join(earlier.alias("e"), functools.reduce(Column.__and__, same), "left_anti")
            fresh.write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/clients/batch={batch}")
        finally:
            met.unpersist()

    def start(self, scores: DataFrame, state: str, available_now: bool = True) -> StreamingQuery:
        writer = scores.writeStream.foreachBatch(self.add).option("checkpointLocation", state)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def points(self, spark: SparkSession) -> DataFrame:
        """(path, count_ips, ts) of all hours so far; clients without a name add nothing to a count."""
        return self.seen(spark).groupBy("path", "ts").agg(F.count("client_id").alias("count_ips")).select("path", "count_ips", "ts")


def write_points(points: DataFrame, folder: str, state: str, available_now: bool = True) -> StreamingQuery:
    """Append metric points to parquet files, exactly once."""
    writer = points.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(folder)
