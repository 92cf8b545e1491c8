"""Typed load of delimited lines into a table."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import infer
from wardline.sources.readers import read_tsv
from wardline.sources.records import read_records
from wardline.sources.writers import save_table, with_row_ids


def typed_lines(
    lines: DataFrame, header: list[str], order: str, line: str = "line", loader_types: list[str] | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Typed rows, rejected lines and loader types of numbered data lines.

    Types are voted on by all accepted rows unless they are given.
    """
    parsed = infer.parse_lines(lines.select(order, line), header, line)
    good = infer.accepted(parsed)
    columns = [f"_f{i}" for i in range(len(header))]
    types = loader_types or infer.infer_types(good, header, columns, order)
    return infer.typed_rows(good, header, columns, types, [order]), infer.rejected(parsed), types


def tsv_records(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, DataFrame]:
    """Header, data records (row_no, line) and unusable records (path, record_no, problem) of files with a header each."""
    records = read_records(spark, path)
    first_lines = records.filter(F.col("record_no") == 1).select("record").distinct().limit(2).collect()
    if len(first_lines) > 1:
        raise ValueError("the files have different headers")
    if not first_lines or first_lines[0][0] is None:
        raise ValueError("the files have no header")
    header = read_tsv(spark, path).columns
    if "\n" in first_lines[0][0]:
        header = next(csv.reader(io.StringIO(first_lines[0][0], newline=""), delimiter="\t"))
    data = records.filter(F.col("record_no") > 1)
    sound = data.filter(F.col("problem").isNull()).select("row_no", F.col("record").alias("line"))
    return header, sound, data.filter(F.col("problem").isNotNull()).select("path", "record_no", "problem")


def load_tsv(
    spark: SparkSession, path: str, table: str, on_conflict: str = "error", new_name: str | None = None
) -> str:
    """Read files with a header each, infer types, add row ids and save a table.

    Quoted values may hold line breaks.  All files must have the same header.
    Rows appended to a table get ids after its largest one.
    """
    header, lines, _ = tsv_records(spark, path)
    typed, _, _ = typed_lines(lines, header, "row_no")
    loaded = with_row_ids(typed, "row_no").drop("row_no")
    if on_conflict == "append" and spark.catalog.tableExists(table) and "id" in spark.table(table).columns:
        last = spark.table(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        loaded = loaded.withColumn("id", F.col("id") + last)
    return save_table(loaded, table, on_conflict, new_name)
