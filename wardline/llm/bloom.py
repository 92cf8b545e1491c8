"""Bounded Bloom filters as small tables of 64-cell words.

A filter has a fixed number of cells, so its broadcast has a fixed bound
(2**25 cells: at most 2**19 rows).  It only spares shuffles: rows that it lets
through are joined exactly afterwards, so a full filter costs time, not
correctness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 25


def _cells(value: Column, cells: int) -> list[Column]:
    """The cells of one value, one for each of two hash functions."""
    return [F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(cells)) for seed in (1, 2)]


def filter_words(values: DataFrame, cells: int = CELLS, at_least: int = 1) -> DataFrame:
    """(word, mask) of a table with one column: a bit for each cell that ``at_least`` rows fall into."""
    cell = F.explode(F.array_distinct(F.array(*_cells(F.col(values.columns[0]), cells))))
    full = values.select(cell.alias("cell"))
    if at_least > 1:
        full = full.groupBy("cell").count().where(F.col("count") >= at_least)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))
    return full.groupBy(F.floor(F.col("cell") / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("mask"))


def with_suspicion(rows: DataFrame, value: Column, words: DataFrame, cells: int = CELLS) -> DataFrame:
    """Add ``suspect``: all cells of the row's value are marked.  ``rows`` is not shuffled."""
    marks = []
    for k, cell in enumerate(_cells(value, cells)):
        side = words.select(F.col("word").alias(f"word{k}_"), F.col("mask").alias(f"mask{k}_"))
        rows = rows.withColumn(f"cell{k}_", cell).withColumn(f"word{k}_", F.floor(F.col(f"cell{k}_") / 64).cast("long"))
        rows = rows.join(F.broadcast(side), f"word{k}_", "left")
        marks.append(F.coalesce(F.getbit(F.col(f"mask{k}_"), (F.col(f"cell{k}_") % 64).cast("int")), F.lit(0)) == 1)
    extra = [f"{n}{k}_" for n in ("cell", "word", "mask") for k in range(len(marks))]
    return rows.withColumn("suspect", marks[0] & marks[1]).drop(*extra)


def rows_in(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids`` (one column, staged); few others are shuffled."""
    name = ids.columns[0]
    rows = df.select(F.struct("*").alias("row"), df[id_col].cast("long").alias("id_"))
    found = with_suspicion(rows, F.col("id_"), filter_words(ids)).where("suspect")
    return found.join(ids.select(F.col(name).alias("id_")).distinct(), "id_", "left_semi").select("row.*")


def rows_not_in(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is not in ``ids`` (one column, staged); most pass without a shuffle."""
    name = ids.columns[0]
    rows = df.select(F.struct("*").alias("row"), df[id_col].cast("long").alias("id_"))
    rows = with_suspicion(rows, F.col("id_"), filter_words(ids))
    checked = rows.where("suspect").join(ids.select(F.col(name).alias("id_")).distinct(), "id_", "left_anti")
    return rows.where("not suspect").select("row").union(checked.select("row")).select("row.*")
