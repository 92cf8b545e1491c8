"""Delimited files whose quoted values may hold line breaks, read in parallel.

Whether a line starts a record depends on all quotes before it in its file.  A
line is therefore taken as a move between two states, outside and inside a
quoted value: for either state before it, the state after it.  Moves compose in
any grouping, so each block of a file is first reduced to one move; the moves of
a file's blocks, a handful of small rows, give the state at each block's start;
and then every block puts its records together by itself.  Only the pieces of
records that run across a block's border are exchanged.

Quotes follow the rules of common delimited files: a quote opens a value only
at the value's start; inside, two quotes (or, with ``escape``, the escape
character and a quote) stand for one; what follows the closing quote up to the
separator is taken as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.operators.search import SMALL_KEYS

# A record beyond this is not put together: a quote that is never closed would
# otherwise gather the rest of its file.
RECORD_BYTES = 64 << 20

_BLOCKS = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("after_out", pa.bool_()), ("after_in", pa.bool_()), ("records_out", pa.int64()), ("records_in", pa.int64())]
)
_PIECES = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("record_no", pa.int64()), ("starts", pa.bool_()), ("ends", pa.bool_()), ("size", pa.int64()), ("text", pa.string())]
)
_BLOCK_KIND = "path string, block long, after_out boolean, after_in boolean, records_out long, records_in long"
_START_KIND = "path string, block long, inside boolean, before long"
_PIECE_KIND = "path string, block long, record_no long, starts boolean, ends boolean, size long, text string"


def _patterns(sep: str, escape: str) -> tuple[str, str]:
    """Regular expressions for lines that end inside a quoted value: begun outside, and begun inside.

    All repeats are possessive: one pass over the line, without recursion.
    """
    s, e = re.escape(sep), re.escape(escape)
    body = '[^"]*+(?:""[^"]*+)*+' if escape == '"' else rf'[^"{e}]*+(?:{e}(?:[\s\S]|\z)[^"{e}]*+)*+'
    opened = rf'(?:(?:[^"{s}][^{s}]*+|"{body}"[^{s}]*+|){s})*+"{body}\z'
    return rf"\A{opened}", rf'\A{body}(?:\z|"[^{s}]*+(?:{s}{opened}))'


def line_moves(line: Column, sep: str = "\t", escape: str = '"') -> tuple[Column, Column]:
    """Whether the line ends inside a quoted value, had it begun outside, and had it begun inside one."""
    quoted = line.contains('"')
    outside, inside = _patterns(sep, escape)
    return quoted & line.rlike(outside), ~quoted | line.rlike(inside)


def _states(after_out: np.ndarray, after_in: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """The state before each line, and after the last one, for the state before the first."""
    fixed, swaps = after_out == after_in, np.cumsum(after_out & ~after_in)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    # The last line that decides the state alone, turned over by the swaps since then.
    after = np.where(last >= 0, after_out[last], inside) ^ ((swaps - np.where(last >= 0, swaps[last], 0)) % 2 == 1)
    return np.concatenate([[inside], after[:-1]]), bool(after[-1])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Slices of the batches that belong to one block."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        path, block = batch.column("path"), batch.column("block")
        changes = pc.or_(pc.not_equal(path.slice(1), path.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
        cuts = [0, *(np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield (path[a].as_py(), block[a].as_py()), batch.slice(a, b - a)


def _flags(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("after_out", "after_in")]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _block_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: its move, and the records that start in it for either state before it."""
    key, state, counts, out = None, [False, True], [0, 0], []
    for own, batch in _by_block(batches):
        if key != own:
            if key:
                out.append((*key, *state, *counts))
            key, state, counts = own, [False, True], [0, 0]
        flags = _flags(batch)
        for k in (0, 1):
            before, state[k] = _states(*flags, state[k])
            counts[k] += int((~before).sum())
    if key:
        out.append((*key, *state, *counts))
    yield _batch(out, _BLOCKS)


def _block_starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each block of one file and the records that start before it."""
    inside, before, out = False, 0, []
    for row in blocks.sort_values("block").itertuples(index=False):
        out.append((row.path, row.block, inside, before))
        before += row.records_in if inside else row.records_out
        inside = row.after_in if inside else row.after_out
    return pd.DataFrame(out, columns=["path", "block", "inside", "before"])


class _Open:
    """A record, or its part in this block, that goes on; beyond ``most`` bytes its text is let go."""

    def __init__(self, number: int, starts: bool, most: int):
        self.number, self.starts, self.most = number, starts, most
        self.lines, self.size = [], 0

    def add(self, lines: list[str], size: int) -> None:
        self.size += size
        if self.size > self.most:
            self.lines.clear()
        else:
            self.lines.extend(lines)

    def row(self, key: tuple[str, int], ends: bool) -> tuple:
        return (*key, self.number, self.starts, ends, self.size, "\n".join(self.lines) if self.size <= self.most else None)


def _pieces(most: int):
    """Records, and the pieces of records at a block's borders, of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, number, going = None, False, 0, None
        for own, batch in _by_block(batches):
            rows: list[tuple] = []
            if key != own:
                if going:
                    rows.append(going.row(key, False))
                key, inside, number = own, batch.column("inside")[0].as_py(), batch.column("before")[0].as_py()
                going = _Open(number, False, most) if inside else None
            after_out, after_in = _flags(batch)
            before, inside = _states(after_out, after_in, inside)
            after = np.append(before[1:], inside)
            lines = batch.column("line")
            sizes = pc.add(pc.binary_length(lines).cast(pa.int64()), 1).to_numpy(zero_copy_only=False)
            numbers = number + np.cumsum(~before)
            number = int(numbers[-1])
            # Records of one line, most of all, are passed on without touching their text.
            alone = ~before & ~after & (sizes <= most)
            if alone.any():
                some = pa.array(np.flatnonzero(alone))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key[0]] * len(some), pa.string()), pa.array([key[1]] * len(some), pa.int64()),
                        pa.array(numbers[alone], pa.int64()), pa.array([True] * len(some)), pa.array([True] * len(some)),
                        pa.array(sizes[alone], pa.int64()), lines.take(some).cast(pa.string()),
                    ],
                    schema=_PIECES,
                )
            rest = np.flatnonzero(~alone)
            for part in np.split(rest, np.flatnonzero((np.diff(rest) > 1) | (np.diff(numbers[rest]) > 0)) + 1) if len(rest) else ():
                if not before[part[0]]:
                    going = _Open(int(numbers[part[0]]), True, most)
                going.add(lines.slice(int(part[0]), len(part)).to_pylist(), int(sizes[part].sum()))
                if not after[part[-1]]:
                    rows.append(going.row(key, True))
                    going = None
            if rows:
                yield _batch(rows, _PIECES)
        if going:
            yield _batch([going.row(key, False)], _PIECES)

    return run


def read_records(spark: SparkSession, path: str, sep: str = "\t", escape: str = '"', most: int = RECORD_BYTES) -> DataFrame:
    """(path, record_no, row_no, record, problem) of all records of text files.

    ``record_no`` counts from 1 in each file, ``row_no`` through all files in
    path order.  ``record`` is the record's text with its line breaks, less one
    carriage return at its end; ``problem`` is null, ``open quote`` for a file's
    last record when its quote is never closed, or ``too long`` for a record of
    more than ``most`` bytes, whose text is left out (null).  An empty file
    has no records.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    after_out, after_in = line_moves(F.col("line"), sep, escape)
    moved = lines.withColumns({"after_out": after_out, "after_in": after_in})
    blocks = moved.select("path", "block", "after_out", "after_in").mapInArrow(_block_moves, _BLOCK_KIND)
    starts = blocks.groupBy("path").applyInPandas(_block_starts, _START_KIND)
    # The file listing bounds the number of blocks: each reading task takes whole
    # files and at most one further cut.  Lines are then joined where they are.
    if len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= SMALL_KEYS:
        starts = F.broadcast(starts)
        placed = moved.join(starts, ["path", "block"])
    else:
        order = moved.withColumn("at", F.monotonically_increasing_id()).join(starts, ["path", "block"])
        placed = order.repartition("path", "block").sortWithinPartitions("path", "block", "at")
    pieces = placed.select("path", "block", "inside", "before", "after_out", "after_in", "line").mapInArrow(_pieces(most), _PIECE_KIND)

    whole = pieces.where("starts and ends").select("path", "record_no", F.col("text").alias("record"), F.lit(True).alias("closed"), "size")
    cut = pieces.where("not (starts and ends)")
    totals = cut.groupBy("path", "record_no").agg(F.sum("size").alias("size"), F.bool_or("ends").alias("closed"))
    parts = cut.select("path", "record_no", "block", "text").join(totals.where(F.col("size") <= most), ["path", "record_no"])
    joined = parts.groupBy("path", "record_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("record")
    )
    # A record that runs on has the number of the block it started in.
    joined = totals.join(joined, ["path", "record_no"], "left").select("path", "record_no", "record", "closed", "size")
    records = whole.union(joined)

    ends = blocks.join(starts, ["path", "block"]).groupBy("path").agg(
        F.max(F.col("before") + F.when(F.col("inside"), F.col("records_in")).otherwise(F.col("records_out"))).alias("records")
    )
    earlier = F.sum("records").over(Window.partitionBy(F.lit(0)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    bases = ends.select("path", F.coalesce(earlier, F.lit(0)).alias("base"))
    problem = F.when(F.col("size") > most, "too long").when(~F.col("closed"), "open quote")
    return records.join(bases, "path").select(
        "path", "record_no", (F.col("base") + F.col("record_no")).alias("row_no"),
        F.when(F.col("size") <= most, F.regexp_replace("record", r"\r\z", "")).alias("record"), problem.alias("problem"),
    )
