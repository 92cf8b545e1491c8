r"""Chat formatting into budgeted, turn-aligned windows.

A turn is written as ``### role: text</turn>`` and a line break.  In texts and
roles a backslash is doubled, ``</turn>`` becomes ``<\/turn>`` and ``##``
becomes ``#\#`` (in roles ``: `` becomes ``:\ ``), so that no control string is
left inside; dropping the first of every backslash and character pair undoes
this.

Sizes are words plus a fixed header cost.  Prefix sums of the sizes place each
turn of a conversation in a cell of a fixed stride; the turns that start in a
cell are the new turns of one window, except that a turn longer than the
stride has a window of its own.  The stride is half of what the budget leaves
after the leading system turn and the repeated history, so new turns,
history and system turn fit the budget unless a single turn or the system turn
is itself too long.  Every window repeats the leading system turn and those
earlier turns that lie within ``history`` words before it.  The loss mask
covers the assistants' texts among the new turns; repeated ones are masked.

Prefix sums are distributed: turns are summed within ranges of 4,096 turn
numbers, and the ranges' sums per conversation.

Cases: null texts and roles count as empty; a null conversation id is one
conversation; null turn numbers come first; rows that repeat a turn number are
ordered by role and text, and identical rows are all kept.  Empty tables give
empty results.  Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import text_of, word_count

BUDGET = 512
HISTORY = 96
HEADER = 3  # words that a turn's frame counts for
END = "</turn>"
TURN_BITS = 12
LEAST_STRIDE = 16


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("##"), F.lit("#\\#"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with the sum of the sizes before them; the leading system turn counts as nothing there."""
    body, who = text_of(df, text), text_of(df, role)
    rows = df.select(
        df[conv].cast("long").alias("conv_id"),
        df[turn].cast("long").alias("turn"),
        who.alias("role"),
        body.alias("text"),
        (word_count(body) + HEADER).alias("size"),
        F.xxhash64(body).alias("tie"),
    ).withColumn("part", F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 62)).cast("long")))
    order = ["turn", "role", "tie"]
    heads = rows.groupBy("conv_id").agg(
        F.min(F.struct("turn", "role", "tie")).alias("head"),
        F.min_by("size", F.struct("turn", "role", "tie")).alias("head_size"),
        F.min_by("text", F.struct("turn", "role", "tie")).alias("head_text"),
    )
    is_system = F.col("head.role") == "system"
    heads = heads.select(
        F.col("conv_id").alias("head_conv"),
        F.when(is_system, F.col("head_size")).otherwise(0).cast("long").alias("system_size"),
        F.when(is_system, F.col("head_text")).alias("system_text"),
    )
    sums = rows.groupBy("conv_id", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("sum_conv"), F.col("part").alias("sum_part"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_before")
    )
    in_part = Window.partitionBy("conv_id", "part").orderBy(*order)
    rows = rows.withColumn("nth", F.row_number().over(in_part))
    rows = rows.withColumn(
        "inside", F.coalesce(F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("sum_conv")) & (F.col("part") == F.col("sum_part")))
    rows = rows.join(heads, F.col("conv_id").eqNullSafe(F.col("head_conv")))
    passed = F.col("part_before") + F.col("inside")
    return rows.select(
        "conv_id",
        F.struct("part", "nth").alias("place"),
        "role",
        "text",
        "size",
        "system_size",
        "system_text",
        ((passed == 0) & F.col("system_text").isNotNull()).alias("leads"),
        F.greatest(passed - F.col("system_size"), F.lit(0)).cast("long").alias("before"),
    )


def chat_windows(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_turns, n_repeated, n_words, loss.

    ``window`` orders a conversation's windows, ``n_repeated`` counts the
    leading turns that an earlier window has shown, and ``loss`` lists the
    (start, stop) of the trained text in code points.
    """
    turns = _turns(df, conv, turn, role, text)
    spare = F.call_function("div", F.lit(budget - history).cast("long") - F.col("system_size"), F.lit(2).cast("long"))
    turns = turns.withColumn("stride", F.greatest(spare, F.lit(LEAST_STRIDE).cast("long")))
    cell = F.call_function("div", F.col("before"), F.col("stride"))
    long_one = (F.col("size") > F.col("stride")) & ~F.col("leads")
    turns = turns.withColumn("window", cell * 2 + long_one.cast("long"))
    new = turns.select("conv_id", "window", "place", "role", "text", "size", F.lit(2).alias("kind"))

    starts = turns.groupBy("conv_id", "window").agg(
        F.min("before").alias("start"), F.min("place").alias("first"), F.max("leads").alias("has_lead"), F.max("system_size").alias("system_size"), F.max("system_text").alias("system_text")
    )
    repeated_lead = starts.where("system_text is not null and not has_lead").select(
        "conv_id", "window", F.col("first").alias("place"), F.lit("system").alias("role"), F.col("system_text").alias("text"), F.col("system_size").alias("size"), F.lit(0).alias("kind")
    )

    # A turn may be history of windows that start at most `history` words after its own start.
    last = F.call_function("div", F.col("before") + history, F.col("stride"))
    past = turns.where("not leads").withColumn("cell", F.explode(F.sequence(cell, last)))
    later = starts.select(
        F.col("conv_id").alias("later_conv"), F.col("window").alias("later"), "start", "first", F.shiftright("window", 1).alias("later_cell")
    )
    past = past.join(
        later,
        F.col("conv_id").eqNullSafe(F.col("later_conv"))
        & (F.col("cell") == F.col("later_cell"))
        & (F.col("place") < F.col("first"))
        & (F.col("window") != F.col("later"))
        & (F.col("start") - F.col("before") <= history),
    ).select("conv_id", F.col("later").alias("window"), "place", "role", "text", "size", F.lit(1).alias("kind"))

    everything = new.union(repeated_lead).union(past)
    packed = everything.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("kind", "place", "role", "text", "size"))).alias("turns")
    )
    opening = lambda t: F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": "))
    written = F.transform(
        "turns",
        lambda t: F.struct(
            opening(t).alias("head"),
            escape(t["text"]).alias("body"),
            ((t["kind"] == 2) & (t["role"] == "assistant")).alias("trained"),
        ),
    )
    packed = packed.select(
        "conv_id",
        "window",
        F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["size"]).alias("n_words"),
        written.alias("written"),
    )
    tail = len(END) + 1
    spans = F.aggregate(
        "written",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda seen, t: F.struct(
            (seen["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + tail).alias("at"),
            F.when(
                t["trained"],
                F.concat(
                    seen["spans"],
                    F.array(
                        F.struct(
                            (seen["at"] + F.char_length(t["head"])).alias("start"),
                            (seen["at"] + F.char_length(t["head"]) + F.char_length(t["body"])).alias("stop"),
                        )
                    ),
                ),
            )
            .otherwise(seen["spans"])
            .alias("spans"),
        ),
    )
    return packed.select(
        "conv_id",
        "window",
        F.array_join(F.transform("written", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        "n_turns",
        "n_repeated",
        "n_words",
        spans["spans"].alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted windows alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    A digest over a whole conversation needs its text in one place, so this
    reader (unlike the formatter) gathers each conversation.
    """
    pieces = F.split("formatted", END + "\n")
    pieces = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    told = F.transform(
        pieces,
        lambda t: F.concat(
            unescape(F.regexp_extract(t, r"(?s)^### (.*?): ", 1)), F.lit("\n"), unescape(F.regexp_replace(t, r"(?s)^### .*?: ", "")), F.lit("\n")
        ),
    )
    trained = F.array_join(
        F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["stop"] - s["start"]))), ""
    )
    read = windows.select(
        "conv_id",
        "window",
        (F.col("n_turns") - F.col("n_repeated")).alias("new_turns"),
        F.array_join(told, "").alias("told"),
        trained.alias("trained"),
        F.char_length("formatted").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("new_turns").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "told", "trained"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    told_all = F.array_join(F.col("parts.told"), "")
    loss_all = F.array_join(F.col("parts.trained"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(told_all.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss_all).cast("long").alias("loss_chars"),
        F.sha2(loss_all.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
