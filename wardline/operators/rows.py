"""Dense row numbers without a single sorting task, and what builds on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.operators.search import SMALL_KEYS

BLOCK_BITS = 20
FILE_COUNT = 8


def _offsets(counts: DataFrame, bits: int, shift: int) -> DataFrame:
    """``(block, before)``: rows in all blocks that come earlier.

    Blocks are numbers that share their upper bits with ``2**bits`` siblings at
    most, so each window holds a bounded number of small rows; the rows before
    all siblings come from the same step on the parents.
    """
    if shift >= 64:
        siblings = Window.partitionBy(F.lit(0))
        parents = None
    else:
        siblings = Window.partitionBy("parent")
        counts = counts.withColumn("parent", F.shiftright("block", bits))
        totals = counts.groupBy(F.col("parent").alias("block")).agg(F.sum("n").alias("n"))
        parents = _offsets(totals, bits, shift + bits).withColumnsRenamed({"block": "parent", "before": "base"})
    earlier = F.sum("n").over(siblings.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    local = counts.withColumn("before", F.coalesce(earlier, F.lit(0)))
    if parents is None:
        return local.select("block", "before")
    return local.join(parents, "parent").select("block", (F.col("before") + F.col("base")).alias("before"))


def number_rows(df: DataFrame, order: str, out: str = "row_no", bits: int = BLOCK_BITS) -> DataFrame:
    """Dense 1-based numbers in the order of a unique integer column; NULL comes first.

    Rows are numbered inside blocks of ``2**bits`` consecutive values, which hold
    at most that many rows, and each block starts after the rows of all earlier
    blocks.  Works for dense and for sparse values.
    """
    block = F.shiftright(F.col(order).cast("bigint"), bits)
    blocked = df.withColumn("block", F.coalesce(block, F.lit(-(1 << (63 - bits)) - 1)))
    counts = blocked.groupBy("block").agg(F.count("*").alias("n"))
    within = F.row_number().over(Window.partitionBy("block").orderBy(order))
    return (
        blocked.withColumn("within", within)
        .join(_offsets(counts, bits, 2 * bits), "block")
        .select(*df.columns, (F.col("before") + F.col("within")).alias(out))
    )


def split_number(row_no: Column | str, total_lines: Column, files: int = FILE_COUNT) -> Column:
    """File (1-based) of each data line when a file of ``total_lines`` lines,
    header included, is cut into about ``files`` parts.  The first part is one
    line shorter and a remainder makes further parts."""
    c = F.col(row_no) if isinstance(row_no, str) else row_no
    size = F.greatest(F.floor(total_lines / files), F.lit(1))
    return (1 + F.floor(c / size)).cast("int")


def split_rows(df: DataFrame, order: str, files: int = FILE_COUNT, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``row_no`` and the ``part`` each row is written to."""
    numbered = number_rows(df, order, "row_no", bits)
    total = df.agg((F.count("*") + 1).alias("n")).scalar()
    return numbered.withColumn("part", split_number("row_no", total, files))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(path, line_no, row_no, line)``.

    ``line_no`` counts from 1 in each file, ``row_no`` through all files in path
    order.  Lines are counted per file block; a block starts after the lines of
    the blocks before it, and a file after the files before it, so the windows
    hold one small row per block of a file and per file.  Ids grow inside a
    block, so the distance to the block's first id is the position in it, and
    the split of files into tasks is the same for both readings.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    blocks = lines.groupBy("path", "_block").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_file = F.sum("_rows").over(earlier.partitionBy("path").orderBy("_block"))
    in_all = F.sum("_lines").over(earlier.partitionBy(F.lit(0)).orderBy("path"))
    files = blocks.groupBy("path").agg(F.sum("_rows").alias("_lines"))
    bases = files.select("path", F.coalesce(in_all, F.lit(0)).alias("_base"))
    starts = blocks.withColumn("_before", F.coalesce(in_file, F.lit(0))).join(bases, "path").drop("_rows")
    line_no = F.col("_before") + F.col("_id") - F.col("_first") + 1
    # The file listing bounds the number of blocks: each reading task takes whole
    # files and at most one further cut.  Lines are then joined where they are.
    if len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= SMALL_KEYS:
        starts = F.broadcast(starts)
    return lines.join(starts, ["path", "_block"]).select(
        "path", line_no.alias("line_no"), (F.col("_base") + line_no).alias("row_no"), "line"
    )
