"""Tables that are replaced and appended to without ever losing their rows.

A replacement is written beside the table, checked, and then takes its name in
two renames; until then nothing has happened to the old rows.  Should the
session end between the two, ``recover`` gives the old table its name back.  An
append goes under a load id: the rows of one load are one partition, so a load
that is repeated replaces its own earlier rows and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardline.operators.infer import same_layout

LOAD = "load_id"
_NEW, _OLD = "__new_", "__old"


class LoadError(Exception):
    """A load that was refused; the table is as it was."""


def _run(spark: SparkSession, text: str, **names: str) -> None:
    spark.sql(text, args=names)


def drop(spark: SparkSession, table: str) -> None:
    _run(spark, "DROP TABLE IF EXISTS IDENTIFIER(:name)", name=table)


def rename(spark: SparkSession, table: str, name: str) -> None:
    # The new name cannot be an argument; it is quoted part by part instead.
    quoted = ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))
    _run(spark, f"ALTER TABLE IDENTIFIER(:name) RENAME TO {quoted}", name=table)


def recover(spark: SparkSession, table: str) -> bool:
    """Finish or undo a replacement that was cut off; whether there was one."""
    exists, old = spark.catalog.tableExists(table), spark.catalog.tableExists(table + _OLD)
    if old and exists:
        drop(spark, table + _OLD)
    elif old:
        rename(spark, table + _OLD, table)
    return old


def create(df: DataFrame, table: str) -> None:
    """Write a new table; it gets its name once all rows are there."""
    spark = df.sparkSession
    recover(spark, table)
    if spark.catalog.tableExists(table):
        raise LoadError(f"table {table} exists")
    aside = _written_aside(df, table)
    rename(spark, aside, table)


def _written_aside(df: DataFrame, table: str) -> str:
    """The rows under a name of their own, counted while they are written and read back to be checked."""
    spark = df.sparkSession
    aside = f"{table}{_NEW}{uuid.uuid4().hex[:12]}"
    # The rows are counted on their way to the files, without a second run of the plan.
    seen = Observation(f"rows-{aside}")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.saveAsTable(aside)
        stored = spark.table(aside)
        if stored.count() != seen.get["n"]:
            raise LoadError(f"{stored.count()} of {seen.get['n']} rows were written for {table}")
        return aside
    except BaseException:
        drop(spark, aside)
        raise


def replace(df: DataFrame, table: str, same: bool = False) -> None:
    """Put ``df`` in the place of a table's rows; with ``same`` only under the same layout.

    ``df`` may read the table itself.  A failure at any point leaves the old rows.
    """
    spark = df.sparkSession
    recover(spark, table)
    if not spark.catalog.tableExists(table):
        create(df, table)
        return
    if same and not same_layout(spark.table(table).schema, df.schema):
        raise LoadError(f"table {table} has a different layout")
    aside = _written_aside(df, table)
    try:
        rename(spark, table, table + _OLD)
        rename(spark, aside, table)
    except BaseException:
        recover(spark, table)
        drop(spark, aside)
        raise
    drop(spark, table + _OLD)


def append(df: DataFrame, table: str, load_id: str) -> None:
    """Add the rows of one load; the same load again replaces its own rows only.

    The table is created on first use, partitioned by ``load_id``.
    """
    spark = df.sparkSession
    recover(spark, table)
    if LOAD in df.columns:
        raise LoadError(f"the rows have a column {LOAD}")
    rows = df.withColumn(LOAD, F.lit(load_id))
    if not spark.catalog.tableExists(table):
        # Partitions of a renamed table would keep their old places, so it starts out empty under its own name.
        rows.limit(0).write.partitionBy(LOAD).saveAsTable(table)
    stored = spark.table(table)
    if stored.columns != rows.columns or not same_layout(stored.schema, rows.schema):
        raise LoadError(f"table {table} has other columns")
    # Written aside and moved when the job is committed: the load's partition alone is replaced, and only by whole rows.
    seen = Observation(f"load-{uuid.uuid4().hex}")
    with _settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(table, overwrite=True)
    if not seen.get["n"]:
        quoted = load_id.replace("\\", "\\\\").replace("'", "\\'")
        _run(spark, f"ALTER TABLE IDENTIFIER(:name) DROP IF EXISTS PARTITION ({LOAD} = '{quoted}')", name=table)


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def loads(spark: SparkSession, table: str) -> DataFrame:
    """(load_id, n): the rows of each load."""
    return spark.table(table).groupBy(LOAD).agg(F.count("*").alias("n"))
