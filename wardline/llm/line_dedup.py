"""Lines that are equal but for a few characters, by an edit join on windows that must be shared.

Equal lines are counted together first; two different lines are linked when
their edit distance is at most the number of edits that ``limits`` allows for
the shorter of them (none below 8 characters, one below 24, two from there).
A line that allows t edits has t + 1 windows, of which a line within t edits
must hold one unchanged: lengths are put into classes by their leading bits,
and the windows of a class lie side by side in its shortest line, those of the
first half counted from the line's start, the others from its end.  A window
with i before it on its side has moved by at most i, so it is entered at its
own place and i places further on: whichever of two lines is ahead has the
other's window there.  A line is entered in the class of its length, and in the
class below if a line of that class may be within its edits.  Pairs that meet
are verified with a banded, bit-parallel edit distance: one small bit vector
per number of errors holds the diagonals of the band that are reached, and one
step per character updates all of them.

All of it is DataFrame functions.  An entry that is exchanged holds a key, a
line's number and a sketch of its letter counts and length, which rejects most
pairs where they meet; its size does not depend on the line, and the number of
entries only on the limits.  Entries are exchanged once; those whose key no
other has go no further.  A window that many lines share would bring all their
pairs together: where a key has more than ``CROWD`` entries, a pair must in
addition share a window of the rest of the line, as it must if it is within the
limit, so such keys are joined on both, and on the exact length; this is
repeated up to ``ROUNDS`` times for keys with ``GROWTH`` times more entries each
time, after which nearly all of a line is shared.

Cases: null texts have no lines; lines without a character other than white
space are left out; other lines are compared as they are.  A line that occurs
in documents without an id only has a null doc_id.  Empty tables give empty
results.  Only id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.bloom import rows_in
from wardline.llm.common import discard, staged, text_of
from wardline.llm.components import components

LIMITS = ((8, 1), (24, 2))  # (characters of the shorter line at least, edits); shorter lines must be equal
MOST_EDITS = 7  # what an entry has room for
CROWD = 16
GROWTH = 16  # times as many entries may meet at a key of each further round
ROUNDS = 5
LEAP = 1 << 22  # longest step along what two lines share


def _limit(chars: Column, limits) -> Column:
    """The edits that a line of so many characters allows."""
    allowed = F.lit(0)
    for least, edits in sorted(limits):
        allowed = F.when(chars >= least, F.lit(edits)).otherwise(allowed)
    return allowed


def _grain(chars: Column) -> Column:
    """What a length's three leading bits count."""
    bits = F.floor(F.log2(chars + 0.5)).cast("int")
    return F.call_function("shiftleft", F.lit(1), F.greatest(bits - 2, F.lit(0)))


def _base(chars: Column, limits) -> Column:
    """The least length of the class of a length: its three leading bits, or the least that has its limit."""
    least_allowed = F.lit(0)
    for least, _ in sorted(limits):
        least_allowed = F.when(chars >= least, F.lit(least)).otherwise(least_allowed)
    return F.greatest(chars - chars % _grain(chars), least_allowed)


def _begins(chars: Column, limits) -> Column:
    """Whether a length is the least of its class."""
    return (chars % _grain(chars) == 0) | chars.isin([least for least, _ in limits])


def _windows(edits: int) -> list[tuple[int, int, int, int]]:
    """(number, windows before it on its side, whether its side is the end, move) of all substrings to look at."""
    sides = [(number, min(number, edits - number), int(2 * number > edits)) for number in range(edits + 1)]
    return [(number, before, end, move) for number, before, end in sides for move in range(before + 1)]


def _place(chars: Column, base: Column, edits: Column, before: Column, end: Column, move: Column) -> tuple[Column, Column]:
    """(start, size) of a window in a line of so many characters.

    The windows of a class of lengths fit into its shortest lines side by side,
    each with room for its moves.
    """
    room = F.call_function("div", edits * edits, F.lit(4))
    size = F.call_function("div", F.greatest(base - room, F.lit(0)), edits + 1).cast("int")
    ahead = before * size + F.call_function("div", before * (before - 1), F.lit(2)) + move
    return F.when(end == 1, F.greatest(chars - ahead - size, F.lit(0))).otherwise(ahead).cast("int"), size


def _entries(rows: DataFrame, limits, exact: bool) -> DataFrame:
    """A row per window and class of lengths of every line: key, tag, sketch and, if ``exact``, second sketch and line's id.

    ``rows`` holds (row, id, sketch, text, chars); if ``exact``, also ``more``,
    ``outer``, which goes into the key, and the ``edits`` of its pairs, and
    every length is a class.  A line that may be the longer of a pair is entered in the
    classes of shorter lines, too.  The tag packs the row's number, by how much
    the class is of shorter lines, the window's number and its move.
    """
    rows = rows.withColumn("less", F.explode(F.array(*[F.lit(less) for less in range(_most(limits) + 1)])))
    rows = rows.withColumn("length", F.col("chars") - F.col("less"))
    base, edits, fits = _class(F.col("length"), limits, exact)
    if not exact:  # each class once: a shorter length begins another one if the next length is the least of its own
        fits = fits & ((F.col("less") == 0) | _begins(F.col("length") + 1, limits))
    # One short expression for all, so that the generated code stays small enough to be compiled.
    rows = rows.where(fits & (edits >= F.col("less"))).withColumns({"base": base, "allowed": edits})
    names = ("number", "before", "end", "move")
    windows = F.lit(None)
    for edits in sorted({edits for _, edits in limits if edits}):
        listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, window)]) for window in _windows(edits)])
        windows = F.when(F.col("allowed") == edits, listed).otherwise(windows)
    rows = rows.withColumn("window", F.explode(windows))
    start, size = _place(F.col("chars"), F.col("base"), F.col("allowed"), *[F.col(f"window.{n}") for n in names[1:]])
    outer = ["outer"] if exact else []
    key = F.xxhash64(*outer, "base", "window.number", F.substring(F.col("text"), start + 1, size))
    tag = F.col("row") * 256 + F.col("less") * 32 + F.col("window.number") * 4 + F.col("window.move")
    return rows.select(key.alias("key"), tag.alias("tag"), "sketch", *(["more", "id"] if exact else []))


def _most(limits) -> int:
    return max((edits for _, edits in limits), default=0)


def _class(length: Column, limits, exact: bool) -> tuple[Column, Column, Column]:
    """(base, edits, whether there is one) of the class of a shorter line's length."""
    if exact:
        return length, F.col("edits"), length >= 0
    edits = _limit(length, limits)
    return _base(length, limits), edits, edits > 0


def _tag_row(tag: Column) -> Column:
    return F.shiftright(tag, 8)


def _tag_less(tag: Column) -> Column:
    return F.shiftright(tag, 5).bitwiseAND(F.lit(7).cast("long")).cast("int")


def _tag_number(tag: Column) -> Column:
    return F.shiftright(tag, 2).bitwiseAND(F.lit(7).cast("long")).cast("int")


def _tag_move(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(3).cast("long")).cast("int")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shared_start(a: Column, b: Column, from_end: bool = False) -> Column:
    """Number of characters that two strings have in common at their start (or end), up to ``2 * LEAP``."""
    room = F.least(F.char_length(a), F.char_length(b))

    def piece(text: Column, done: Column, more: Column) -> Column:
        return F.substring(text, F.char_length(text) - done - more + 1 if from_end else done + 1, more)

    def longer(done: Column, more: Column) -> Column:
        same = (done + more <= room) & (piece(a, done, more) == piece(b, done, more))
        return F.when(same, done + more).otherwise(done)

    steps = F.array(*[F.lit(1 << k) for k in range(LEAP.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), longer)


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most ``threshold``.

    What they share at their start and end is left out first.
    """
    near = F.abs(F.char_length(a) - F.char_length(b)) <= threshold

    def ends(tails: Column) -> Column:
        x, y = tails["a"], tails["b"]
        cut = lambda text, shared: F.substring(text, F.lit(1), F.char_length(text) - shared)
        return _let(_shared_start(x, y, from_end=True), lambda n: _let(F.struct(cut(x, n).alias("a"), cut(y, n).alias("b")), core))

    def core(middle: Column) -> Column:
        return _let(_padded(middle["a"], threshold), lambda padded: _banded(padded, middle["a"], middle["b"], threshold))

    def tails(n: Column) -> Column:
        rest = lambda text: F.substring(text, n + 1, F.char_length(text))
        return _let(F.struct(rest(a).alias("a"), rest(b).alias("b")), ends)

    return near & _let(_shared_start(a, b), tails)


def _padded(text: Column, threshold: int) -> Column:
    blank = F.array(*[F.lit("") for _ in range(threshold)]) if threshold else F.array().cast("array<string>")
    return F.concat(blank, F.split(text, ""), blank)


def _banded(padded: Column, a: Column, b: Column, threshold: int) -> Column:
    """Whether ``a``, also given as padded characters, is within the threshold of ``b``.

    Bit d + threshold of level e says that the characters of ``a`` up to j + d
    can be turned into the first j of ``b`` with at most e edits.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    equal = lambda c, j, k: F.when(F.get(padded, j + k) == c, 1 << k).otherwise(0)
    chars = F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, ""))
    masks = F.transform(chars, lambda c, j: sum((equal(c, j, k) for k in range(1, width)), equal(c, j, 0)).cast("long"))

    def step(state: Column, mask: Column) -> Column:
        level = lambda e: F.shiftright(state, e * width).bitwiseAND(F.lit(full).cast("long"))
        new, out = None, F.lit(0).cast("long")
        for e in range(threshold + 1):
            now = level(e).bitwiseAND(mask)
            if e:
                less = level(e - 1)
                now = now.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new, 1))
                now = now.bitwiseAND(F.lit(full).cast("long"))
            new = now
            out = out.bitwiseOR(F.shiftleft(new, e * width))
        return out

    start = 0
    for e in range(threshold + 1):
        start |= sum(1 << (threshold + d) for d in range(e + 1)) << (e * width)
    final = F.aggregate(masks, F.lit(start).cast("long"), step)
    place = F.char_length(a) - F.char_length(b) + (threshold + threshold * width)
    return F.getbit(final, F.greatest(place, F.lit(0)).cast("int")) == 1


# Letters that are common in many languages; one edit changes two counts by one at most.
COUNTED = " etaoinsrhldcumf"
SKETCHED = 8  # of them go into the sketch that every entry carries, four bits each
LONG_SKETCH = 12  # of them go into the sketches of further rounds, and all of these into a second one
ALSO_COUNTED = "cumfgpwybv012345"


def _counts(line: Column, counted: str = COUNTED) -> Column:
    return F.array(*[F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in counted])


def _differ(a: str, b: str) -> Column:
    """By how much two lines' counts differ."""
    each = [F.abs(F.col(a)[k] - F.col(b)[k]) for k in range(len(COUNTED))]
    return reduce(lambda x, y: x + y, each)


def _nibbles(counts: Column, letters: int) -> Column:
    each = [F.shiftleft((counts[k] % 16).cast("long"), 4 * k) for k in range(letters)]
    return reduce(lambda x, y: x.bitwiseOR(y), each)


def _sketch(counts: Column, chars: Column, letters: int) -> Column:
    """The counts of the first letters, modulo 16, and the length, modulo 65536, in one number."""
    return _nibbles(counts, letters).bitwiseOR(F.shiftleft((chars % 65536).cast("long"), 4 * LONG_SKETCH))


def _sketches_allow(edits: int, exact: bool) -> Column:
    """Whether by their sketches two lines may be within so many edits."""
    part = lambda c, k, full: F.shiftright(F.col(c), 4 * k).bitwiseAND(F.lit(full).cast("long"))
    apart = lambda c, k, full: F.abs(part(f"{c}_x", k, full) - part(f"{c}_y", k, full))
    length = apart("sketch", LONG_SKETCH, 65535)
    each = [apart("sketch", k, 15) for k in range(LONG_SKETCH if exact else SKETCHED)]
    counts = reduce(lambda x, y: x + y, [F.least(d, 16 - d) for d in each])
    if exact:  # of the second ones only how many counts differ, which takes little code
        other = F.col("more_x").bitwiseXOR(F.col("more_y"))
        other = other.bitwiseOR(F.shiftright(other, 2).bitwiseAND(F.lit(0x3333333333333333)))
        other = other.bitwiseOR(F.shiftright(other, 1)).bitwiseAND(F.lit(0x1111111111111111))
        counts = counts + F.bit_count(other)
    return (F.least(length, 65536 - length) <= edits) & (counts <= 2 * edits)


def _roles(tag: Column) -> Column:
    """Of a pair one must be the shorter line (1), and one must hold the window in its own place (2)."""
    return F.when(_tag_less(tag) == 0, 1).otherwise(0).bitwiseOR(F.when(_tag_move(tag) == 0, 2).otherwise(0))


def _met(entries: DataFrame) -> DataFrame:
    """The entries whose key others have that they may pair with, and how many have it."""
    same_key = Window.partitionBy("key")
    counted = entries.withColumns({"n": F.count(F.lit(1)).over(same_key), "roles": F.bit_or(_roles(F.col("tag"))).over(same_key)})
    return counted.where("n > 1 and roles = 3")


def _pairs(met: DataFrame, edits: int, exact: bool) -> DataFrame:
    """(a, b) of the lines that meet at a key and whose sketches allow a link."""
    sides = [met.select(*[F.col(c).alias(f"{c}_{n}") for c in met.columns]) for n in "xy"]
    x, y = [F.col(f"id_{n}") if exact else _tag_row(F.col(f"tag_{n}")) for n in "xy"]
    fits = _roles(F.col("tag_x")).bitwiseOR(_roles(F.col("tag_y"))) == 3
    near = _sketches_allow(edits, exact)
    pairs = sides[0].join(sides[1], (F.col("key_x") == F.col("key_y")) & (x < y) & fits & near)
    return pairs.select(x.alias("a"), y.alias("b"))


def _rests(hot: DataFrame, rows: DataFrame, limits, exact: bool) -> DataFrame:
    """What is left of the lines of entries without their windows, as rows of a further round."""
    tag, chars = F.col("tag"), F.col("chars")
    number = _tag_number(tag)
    base, edits, _ = _class(chars - _tag_less(tag), limits, exact)
    start, size = _place(chars, base, edits, F.least(number, edits - number), (2 * number > edits).cast("int"), _tag_move(tag))
    known = hot.select("key", "tag", _tag_row(tag).alias("row")).join(rows.drop("sketch", "more", "outer"), "row")
    placed = known.select("id", "key", "text", edits.alias("edits"), start.alias("start"), size.alias("size"))
    rest = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("start")),
        F.substring(F.col("text"), F.col("start") + F.col("size") + 1, F.char_length("text")),
    )
    rests = placed.select("id", F.col("key").alias("outer"), "edits", rest.alias("text"))
    chars = F.char_length("text")
    sketch = _let(_counts(F.col("text")), lambda counts: _sketch(counts, chars, LONG_SKETCH))
    more = _let(_counts(F.col("text"), ALSO_COUNTED), lambda counts: _nibbles(counts, len(ALSO_COUNTED)))
    return rests.select(F.monotonically_increasing_id().alias("row"), "*", chars.alias("chars"), sketch.alias("sketch"), more.alias("more"))


def candidates(lines: DataFrame, limits=LIMITS, crowd: int = CROWD, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(a, b) with a < b, ids of the lines (id, line, chars, sketch) that share a window and whose sketches are alike.

    Also (id, line, chars) of all lines that share a window with any other.
    """
    rows = lines.select(F.col("id").alias("row"), "id", "sketch", F.col("line").alias("text"), "chars")
    found = texts = None
    for turn in range(rounds + 1):
        exact = turn > 0
        entries = _entries(rows, limits, exact)
        met = staged(_met(entries), "line-meets")
        if texts is None:
            ids = staged(met.select(_tag_row(F.col("tag")).alias("id")).distinct(), "line-ids")
            texts = staged(rows_in(lines.select("id", "line", "chars"), "id", ids), "line-texts")
            rows = texts.select(F.col("id").alias("row"), "id", F.col("line").alias("text"), "chars")
        # A pair in a crowd shares more windows with every round, and would meet again at each choice of them.
        most = crowd * GROWTH**turn
        hot = met.where(F.col("n") > most)
        last = turn == rounds or hot.isEmpty()
        few = met if last else met.where(F.col("n") <= most)
        pairs = staged(_pairs(few.drop("n", "roles"), _most(limits), exact).distinct(), "line-pairs")
        found = pairs if found is None else found.union(pairs)
        if last:
            return found.distinct(), texts
        # Pairs at a crowded key must share a window of what is left of their lines, too.
        rests = staged(_rests(hot, rows, limits, exact), "line-rests")
        discard(met)
        if exact:
            discard(rows)
        rows = rests


def edit_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: tuple[tuple[int, int], ...] = LIMITS
) -> DataFrame:
    """One row per distinct line.

    doc_id (the smallest with the line), line_sha256, n_copies (its
    occurrences), n_links (other lines within the edits that the shorter line
    allows), class_doc_id and class_sha256 (of the first line, by document and
    digest, that can be reached by links), kept (whether it is that line).
    ``limits`` lists (least number of characters, edits), the edits rising.
    """
    if any(not 0 <= edits <= MOST_EDITS for _, edits in limits) or [e for _, e in sorted(limits)] != sorted(e for _, e in limits):
        raise ValueError(f"limits must allow longer lines no fewer edits, and {MOST_EDITS} at most: {limits}")
    line = F.explode(F.split(text_of(df, text_col), "\n"))
    found = df.select(df[id_col].cast("long").alias("doc_id"), line.alias("line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    lines = found.groupBy("line").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
    lines = lines.select("*", F.char_length("line").alias("chars"), F.sha2(F.col("line").cast("binary"), 256).alias("sha"))
    lines = lines.withColumn("sketch", _sketch(_counts(F.col("line")), F.col("chars"), SKETCHED))
    lines = staged(lines.withColumn("id", F.monotonically_increasing_id()), "lines")

    pairs, texts = candidates(lines, limits)
    pairs = staged(pairs, "line-pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = staged(texts.join(ends, "id", "left_semi").withColumn("counts", _counts(F.col("line"))), "line-ends")
    both = pairs.join(texts.toDF("a", "line_a", "chars_a", "counts_a"), "a").join(texts.toDF("b", "line_b", "chars_b", "counts_b"), "b")
    # Letter counts reject more pairs at once.
    allowed = _limit(F.least("chars_a", "chars_b"), limits)
    alike = _differ("counts_a", "counts_b") <= 2 * allowed
    linked_by = F.lit(False)
    for edits in sorted({edits for _, edits in limits if edits}):
        linked_by = F.when(allowed == edits, within(F.col("line_a"), F.col("line_b"), edits)).otherwise(linked_by)
    links = staged(both.where(alike & linked_by).select("a", "b"), "line-links")

    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    classes = components(links).toDF("id", "component")
    linked = lines.select("id", "doc_id", "sha").join(classes, "id").join(degrees, "id")
    linked = staged(linked, "line-linked")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "sha")
    firsts = linked.groupBy("component").agg(F.min(order).alias("first"))
    linked = linked.join(firsts, "component").select("id", "n_links", F.col("first.doc_id").alias("class_doc"), F.col("first.sha").alias("class_sha"))
    out = lines.drop("line", "chars", "sketch").join(linked, "id", "left")
    alone = F.col("class_sha").isNull()
    return out.select(
        "doc_id",
        F.col("sha").alias("line_sha256"),
        "n_copies",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_doc")).alias("class_doc_id"),
        F.coalesce("class_sha", "sha").alias("class_sha256"),
        (alone | (F.col("class_sha") == F.col("sha"))).alias("kept"),
    )


def drop_similar_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: tuple[tuple[int, int], ...] = LIMITS
) -> DataFrame:
    """The rows of ``df`` with each class of lines kept only once: the first line of the first document.

    Blank lines stay.  A document whose lines all go keeps an empty text.
    """
    classes = staged(edit_classes(df, id_col, text_col, limits).select("line_sha256", "doc_id", "kept"), "line-classes")
    rows = staged(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_id")), "line-rows")
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    lines = rows.select("row_id", F.col("row")[id_col].cast("long").alias("here"), F.posexplode(F.split(text, "\n")).alias("nth", "line"))
    lines = lines.withColumn("line_sha256", F.sha2(F.col("line").cast("binary"), 256)).join(classes, "line_sha256", "left")
    first = F.row_number().over(Window.partitionBy("row_id", "line_sha256").orderBy("nth")) == 1
    mine = F.col("kept") & F.col("here").eqNullSafe(F.col("doc_id"))
    lines = lines.withColumn("stays", F.col("kept").isNull() | (mine & first)).where("stays")
    texts = lines.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("nth", "line"))).alias("kept_lines"))
    joined = rows.join(texts.select("row_id", F.array_join(F.col("kept_lines.line"), "\n").alias("new_text")), "row_id", "left")
    new = F.when(F.col("row")[text_col].isNotNull(), F.coalesce("new_text", F.lit("")))
    return joined.select(*[new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
