"""Writers for delimited files, metric points and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.infer import same_layout
from wardline.operators.rows import number_rows, split_rows
from wardline.sources import tables

ON_CONFLICT = ("append", "overwrite", "rename", "error")


# White space at either end belongs to the value.
KEEP_SPACE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_quoted_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated with a header, every value quoted, ``\\`` as escape."""
    df.write.mode(mode).csv(path, sep="\t", header=True, quoteAll=True, escape="\\", **KEEP_SPACE)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated with a header, quotes only where needed."""
    df.write.mode(mode).csv(path, sep="\t", header=True, escape='"', emptyValue="", **KEEP_SPACE)


def metric_lines(points: DataFrame, prefix: str | None = None) -> DataFrame:
    """``path value ts`` lines from three columns, only paths holding the prefix."""
    if prefix is not None:
        points = points.filter(F.col(points.columns[0]).contains(prefix))
    return points.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in points.columns]).alias("value"))


def write_metrics(points: DataFrame, path: str, prefix: str | None = None, mode: str = "errorifexists") -> None:
    metric_lines(points, prefix).write.mode(mode).text(path)


def write_split(df: DataFrame, order: str, path: str, files: int = 8, mode: str = "errorifexists") -> None:
    """Cut rows into about ``files`` folders in row order, each file with a header.

    A part is one file when it is small and several files in name order when it
    is large, so that no task writes a whole part of a large input.
    """
    ordered = split_rows(df, order, files).repartitionByRange("row_no").sortWithinPartitions("part", "row_no")
    ordered.drop("row_no").write.mode(mode).partitionBy("part").csv(path, sep="\t", header=True)


def tag_rows(df: DataFrame, tag: str | Column, column: str = "query_file") -> DataFrame:
    """Mark every row with the query it came from."""
    return df.withColumn(column, F.lit(tag))


def with_row_ids(df: DataFrame, order: str, out: str = "id") -> DataFrame:
    """A dense id from 1, placed first."""
    numbered = number_rows(df, order, out)
    return numbered.select(out, *df.columns)


def save_table(df: DataFrame, table: str, on_conflict: str = "error", new_name: str | None = None) -> str:
    """Create a table, or settle a clash with an existing one; returns its name.

    ``append`` needs the same layout (positions, types and names), ``overwrite``
    replaces the table and leaves the old one as it is if anything fails,
    ``rename`` writes to ``new_name``.
    """
    if on_conflict not in ON_CONFLICT:
        raise ValueError(f"on_conflict must be one of {ON_CONFLICT}")
    spark = df.sparkSession
    tables.recover(spark, table)
    if not spark.catalog.tableExists(table):
        tables.create(df, table)
        return table
    if on_conflict == "error":
        raise ValueError(f"table {table} exists")
    if on_conflict == "rename":
        if not new_name or new_name == table:
            raise ValueError("rename needs a different new_name")
        return save_table(df, new_name, "error")
    if on_conflict == "overwrite":
        tables.replace(df, table)
        return table
    if not same_layout(spark.table(table).schema, df.schema):
        raise ValueError(f"table {table} has a different layout; overwrite or rename")
    if spark.table(table).columns != df.columns:
        raise ValueError(f"table {table} has other column names; overwrite or rename")
    df.write.mode("append").saveAsTable(table)
    return table


def drop_table(df: DataFrame, table: str) -> None:
    tables.drop(df.sparkSession, table)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict, mode: str = "append") -> None:
    """Send rows to a database; connection properties are the caller's."""
    df.write.jdbc(url, table, mode=mode, properties=properties)
