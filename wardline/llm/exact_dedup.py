"""Exact duplicates of texts, by two passes with a Bloom filter.

Texts are equal when they are identical after every white-space character is
deleted.  The first pass counts, in a Bloom filter's cells, how many texts
fall into each; the second lets every row pass whose cells show one text only,
and shuffles just the others, to be grouped by their whole hash.  The filter
has a fixed number of cells, so its broadcast is bounded; when a corpus fills
it, more rows are shuffled and the result stays the same.

Cases: null text counts as empty, and all empty texts are one group.  Ties in
length go to the smallest id, a null id after all others; of rows that repeat
an id and a text, one stays.  Empty tables give empty results.  Other columns
are carried along and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.bloom import CELLS, filter_words, with_suspicion
from wardline.llm.common import staged, text_of

WHITE_CHARS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normal_text(text: Column) -> Column:
    """The text without white space."""
    for char in WHITE_CHARS:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def _rank(row_id: Column, last: Column) -> Column:
    """Orders the rows of a group; the greatest stays."""
    smallest = F.when(row_id.isNotNull(), F.bitwise_not(row_id))
    return F.struct(F.col("n_chars_"), row_id.isNotNull(), smallest, last)


def exact_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_of(df, text_col)
    rows = df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.char_length(text).alias("n_chars_"),
        F.unhex(F.sha2(normal_text(text).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_"),
    )
    rows = staged(rows, "exact-digests")
    marked = staged(filter_words(rows.select("digest"), cells, at_least=2), "exact-filter")
    rows = with_suspicion(rows, F.col("digest"), marked, cells)
    suspects = rows.where("suspect")
    best = suspects.groupBy("digest").agg(
        F.max_by(F.struct("doc_id", "row_"), _rank(F.col("doc_id"), -F.col("row_"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    # Written first, so that a text of very many rows is a join key that can be split.
    best = staged(best, "exact-best")
    grouped = suspects.join(best, "digest").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_") == F.col("best.row_")).alias("kept"), "digest"
    )
    alone = rows.where("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    return grouped.union(alone).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows that the filter clears are never shuffled; of the others one row per
    text and task is.
    """
    text = text_of(df, text_col)
    digest = F.unhex(F.sha2(normal_text(text).cast("binary"), 256))
    marked = staged(filter_words(df.select(digest.alias("digest")), cells, at_least=2), "exact-filter")
    rows = df.select(F.struct("*").alias("row"), digest.alias("digest"), F.char_length(text).alias("n_chars_"))
    rows = with_suspicion(rows, F.col("digest"), marked, cells)
    row_id = F.col("row")[id_col].cast("long")
    last = F.xxhash64(F.to_json("row"))
    best = rows.where("suspect").groupBy("digest").agg(F.max_by("row", _rank(row_id, last)).alias("row"))
    return best.select("row").union(rows.where("not suspect").select("row")).select("row.*")
