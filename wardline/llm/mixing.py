"""Mixing sources to target weights.

Sizes are words.  Sources in code-point order (null last) take the weights in
turn; the targets share out all words, but stop at ``max_repeats`` times a
source's own words, and what is left over is shared again by weight among the
others, until none is above (computed in one sorted pass over the sources).
Every document has a hash-random key; within its source, the documents in key
order fill the target: whole epochs first, then up to the word at which the
running sum of sizes reaches the target.

The running sums are distributed: a source's keys fall into 65,536 ranges,
the sums of the ranges are added up per source, and only the one range that
holds the cut is put in order.  The table of sources (a row per source) is
small, as their weights are set by hand, and is the only thing sorted as a
whole.

Cases: null text has size 0; a null source is a source of its own.  Rows that
repeat an id and a text at the cut share the words that are left.  A null id
is keyed like an empty one.  Empty tables give empty results; other columns
may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import WHITE, hash_key, staged, text_of, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
KEY_BITS = 60
RANGE_BITS = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long")
    named = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    none = F.lit(0).cast("long")
    ranked = (
        named.withColumn("left_", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(earlier), none))
        .withColumn("weight_", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(earlier), none))
        .withColumn("place_", F.row_number().over(by_ratio))
        .withColumn("open_", F.col("cap") * F.col("weight_") >= F.col("weight") * F.col("left_"))
    )
    # From the first source that stays below its cap on, all share what is left.
    first = F.min(F.when(F.col("open_"), F.struct("place_", "left_", "weight_"))).over(everyone)
    ranked = ranked.withColumn("first_", first)
    shared = (F.col("weight") * F.col("first_.left_")).cast("double") / F.col("first_.weight_").cast("double")
    target = F.when(F.col("place_") < F.col("first_.place_"), F.col("cap").cast("double")).otherwise(shared)
    return ranked.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: source_size, target, epochs, and where the last epoch is cut.

    ``sized`` has source, key, doc_id, digest and size.  ``cut_`` is the
    (key, doc_id, digest) at which the target is reached, ``cut_words`` the
    words that each row there gives.
    """
    targets = source_targets(sized.select("source", "size"), weights, max_repeats)
    budget = F.floor("target").cast("long")
    some = F.greatest(F.col("source_size"), F.lit(1).cast("long"))
    targets = staged(
        targets.withColumn("epochs", F.call_function("div", budget, some)).withColumn("rest", F.pmod(budget, some)), "mix-targets"
    )
    part = F.shiftright("key", KEY_BITS - RANGE_BITS)
    parts = sized.groupBy("source", part.alias("part_")).agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before_", F.coalesce(F.sum("part_size").over(before), F.lit(0).cast("long")))
    goal = targets.select(F.col("source").alias("source_"), "rest")
    cut_part = parts.join(goal, F.col("source").eqNullSafe(F.col("source_"))).where(
        (F.col("before_") <= F.col("rest")) & (F.col("rest") < F.col("before_") + F.col("part_size"))
    )
    cut_part = cut_part.select("source_", F.col("part_").alias("cut_part"), "before_", "rest")
    inside = sized.join(cut_part, F.col("source").eqNullSafe(F.col("source_")) & (part == F.col("cut_part")))
    # Rows that repeat one id and text are one step of the running sum.
    steps = inside.groupBy("source_", "key", "doc_id", "digest", "before_", "rest").agg(
        F.sum("size").alias("step"), F.count(F.lit(1)).alias("copies")
    )
    order = Window.partitionBy("source_").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("at_", F.col("before_") + F.coalesce(F.sum("step").over(order), F.lit(0).cast("long")))
    cut = steps.where((F.col("at_") <= F.col("rest")) & (F.col("rest") < F.col("at_") + F.col("step"))).select(
        "source_",
        F.struct("key", "doc_id", "digest").alias("cut_"),
        F.call_function("div", F.col("rest") - F.col("at_"), F.col("copies")).alias("cut_words"),
    )
    return targets.drop("rest").join(cut, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


def _taken(size: Column) -> Column:
    """Words taken by a row that has been joined with its source's plan."""
    here = F.struct("key", "doc_id", "digest")
    last = F.when(here < F.col("cut_"), size).when(here == F.col("cut_"), F.col("cut_words")).otherwise(0)
    return F.col("epochs") * size + F.coalesce(last, F.lit(0)).cast("long")


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = text_of(df, text_col)
    return [
        df[source_col].cast("string").alias("source"),
        hash_key(df[id_col]).alias("key"),
        F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"),
        df[id_col].isNull().alias("no_id"),
        F.xxhash64(text).alias("digest"),
        word_count(text).alias("size"),
    ]


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))


def mix_sizes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per row of ``df``: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sized = staged(df.select(*_sized(df, id_col, text_col, source_col)), "mix-sizes")
    rows = _with_plan(sized, mix_plan(sized, weights, max_repeats))
    return rows.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "size", "source_size", "target", _taken(F.col("size")).alias("taken")
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of the white space after its first ``words`` words."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank_start = F.regexp_like(text, F.lit("^" + WHITE)).cast("long")
    return F.array_join(F.slice(pieces, F.lit(1), (words + blank_start).cast("int")), "")


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """The mixture: rows of ``df``, repeated for every epoch that takes them.

    The document at a source's cut is cut there too.  The table of sources is
    joined to the rows, so texts are not shuffled; documents without words are
    left out, as they add nothing.
    """
    columns = [c for c in df.columns]
    sized = staged(df.select(*_sized(df, id_col, text_col, source_col)), "mix-sizes")
    plan = staged(mix_plan(sized, weights, max_repeats), "mix-plan")
    rows = _with_plan(df.select(F.struct("*").alias("row"), *_sized(df, id_col, text_col, source_col)), plan)
    rest = _taken(F.col("size")) - F.col("epochs") * F.col("size")
    whole = F.when(F.col("size") > 0, F.array_repeat(F.lit(-1).cast("long"), (F.col("epochs") + (rest == F.col("size")).cast("long")).cast("int")))
    part = F.when((rest > 0) & (rest < F.col("size")), F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("row", F.explode(F.concat(F.coalesce(whole, F.array().cast("array<bigint>")), part)).alias("words_"))
    text = F.col("row")[text_col]
    out = F.when(F.col("words_") < 0, text).otherwise(first_words(text, F.col("words_")))
    return rows.select(*[out.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns])
