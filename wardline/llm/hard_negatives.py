"""Hard-negative mining by Kronecker-packed inner products.

Every component x becomes the integer floor(256 x).  A row's score for an
anchor is their integer inner product; higher scores come first, ties by the
smaller id.  An anchor's positives are its best other rows of the same label;
its hard negatives for a positive are the best rows of another label whose
score lies in a band of shares of the positive's score.

The products are computed packed: the components of several candidates, made
non-negative by a bias, are laid into separated fields of one wide integer, so
that one multiplication by an anchor's component advances all of them, and the
sums of a field never reach the next one.  The field's width follows from the
largest components of the block at hand, and the biases are taken off the
unpacked sums exactly.  Rows with large components go into Python's integers of
any width, the others into 63 bits.

Anchors and candidates are dealt into blocks of bounded size by their row
number, so neither a hot label nor a repeated id makes a large task.  Two
passes over the blocks: positives (within a label), then negatives (all rows),
for which a block sends on no more rows than are asked for, of each anchor and
score.

Cases: rows with a null label, a null vector or a null or non-finite component
take no part.  Vectors of different lengths are multiplied as if the shorter
one went on with zeros.  Repeated rows and repeated ids are rows of their own,
and a row is never its own positive; rows without an id come last in ties.
Scores beyond 63 bits are held there.  An anchor without positives, or a
positive without rows in its band, gives no row; nor does an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import staged

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# Shares, in hundredths, of a positive's score between which a negative's lies.
BAND = (30, 90)
ANCHOR_BLOCK = 256
CANDIDATE_BLOCK = 1 << 13
# Components, either sign, and lengths that the 63-bit fields always hold.
NARROW, LENGTH = 1 << 20, 1 << 20
MOST = (1 << 63) - 1
WIDE_BITS = 2048


def packed_products(anchors: np.ndarray, candidates: np.ndarray, bits: int = 63) -> np.ndarray:
    """Exact inner products, anchors by candidates, of two integer matrices.

    ``bits`` is the room of one wide integer; a field that needs more has an
    integer of its own, which only Python's integers (dtype object) can hold.
    """
    (n, width), m = anchors.shape, len(candidates)
    if not n or not m or not width:
        return np.zeros((n, m), anchors.dtype)
    low_a, low_c = anchors.min(), candidates.min()
    biased_a, biased_c = anchors - low_a, candidates - low_c
    field = max(1, (width * int(biased_a.max()) * int(biased_c.max())).bit_length())
    per = max(1, bits // field)
    slots = np.zeros((-(-m // per) * per, width), candidates.dtype)
    slots[:m] = biased_c
    slots = slots.reshape(-1, per, width)
    wide = slots[:, 0]
    for k in range(1, per):
        wide = wide + (slots[:, k] << (k * field))
    sums = biased_a @ wide.T
    fields = np.stack([(sums >> (k * field)) & ((1 << field) - 1) for k in range(per)], axis=2).reshape(n, -1)[:, :m]
    # The sum of (a - low_a)(c - low_c), less all of it but the sum of a c.
    return fields + low_c * anchors.sum(axis=1)[:, None] + low_a * candidates.sum(axis=1)[None, :] - width * low_a * low_c


def _parts(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(256 x) of all components, as doubles that hold it exactly; rows filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for k, vector in enumerate(vectors):
        out[k, : len(vector)] = vector
    # The scale is a power of two, so only the largest doubles lose anything: they are held.
    return np.floor(np.clip(out, -1e300, 1e300) * SCALE)


def scores(anchors: pd.Series, candidates: pd.Series) -> np.ndarray:
    """Scores of all candidates for each anchor, as 64-bit integers."""
    width = max((len(v) for side in (anchors, candidates) for v in side), default=0)
    a, c = _parts(anchors, width), _parts(candidates, width)
    out = np.zeros((len(a), len(c)), np.int64)
    wide_a, wide_c = (np.abs(side).max(axis=1, initial=0) >= (NARROW if width < LENGTH else 0) for side in (a, c))
    for rows, left in ((np.flatnonzero(wide_a == w), w) for w in (False, True)):
        for columns, right in ((np.flatnonzero(wide_c == w), w) for w in (False, True)):
            if not len(rows) or not len(columns):
                continue
            if not left and not right:
                out[np.ix_(rows, columns)] = packed_products(a[rows].astype(np.int64), c[columns].astype(np.int64))
                continue
            exact = [np.array([[int(x) for x in v] for v in side], object).reshape(len(side), width) for side in (a[rows], c[columns])]
            found = packed_products(*exact, WIDE_BITS)
            out[np.ix_(rows, columns)] = np.clip(found, -MOST, MOST).astype(np.int64)
    return out


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """By id, those without one last; equal ids by row number."""
    return rows.sort_values(["no_id", "vec_id", "row_no"], kind="stable", ignore_index=True)


def _told(keys: list[tuple], rows: pd.DataFrame, places: list[int], found: list[int], names: list[str]) -> pd.DataFrame:
    out = rows.loc[places, ["no_id", "vec_id", "row_no"]].reset_index(drop=True)
    for k, name in enumerate(names):
        out[name] = np.array([key[k] for key in keys], np.int64)
    return out.assign(score=np.array(found, np.int64))[[*names, "no_id", "vec_id", "row_no", "score"]]


def _positives(most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(rows)
        keys, places, found = [], [], []
        if len(anchors) and len(rows):
            table = scores(anchors["vector"], rows["vector"])
            numbers = rows["row_no"].to_numpy()
            for k, own in enumerate(anchors["row_no"]):
                usable = np.flatnonzero(numbers != own)
                best = usable[np.argsort(-table[k, usable], kind="stable")][:most]
                keys += [(own,)] * len(best)
                places += best.tolist()
                found += table[k, best].tolist()
        return _told(keys, rows, places, found, ["anchor"])

    return run


def _negatives(most: int, band: tuple[int, int]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(rows)
        keys, places, found = [], [], []
        if len(anchors) and len(rows):
            table = scores(anchors["vector"], rows["vector"])
            labels = rows["label"].to_numpy()
            for k, (own, label, wanted) in enumerate(zip(anchors["row_no"], anchors["label"], anchors["wanted"], strict=True)):
                others = np.flatnonzero(labels != label)
                others = others[np.argsort(-table[k, others], kind="stable")]
                falling = -table[k, others]
                for score in wanted:
                    low, high = -((-band[0] * int(score)) // 100), band[1] * int(score) // 100
                    first = np.searchsorted(falling, -high, "left")
                    last = min(np.searchsorted(falling, -low, "right"), first + most)
                    best = others[first:last]
                    keys += [(own, score)] * len(best)
                    places += best.tolist()
                    found += table[k, best].tolist()
        return _told(keys, rows, places, found, ["anchor", "wanted"])

    return run


def _dealt(anchors: DataFrame, rows: DataFrame, per: list[str], anchor_block: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the blocks of the key they belong to, copied to every block of the other side."""
    blocks = [F.ceil(F.count("*") / most).cast("int").alias(n) for n, most in (("anchor_blocks", anchor_block), ("row_blocks", block))]
    sizes = [side.groupBy(*per).agg(n) for side, n in zip((anchors, rows), blocks, strict=True)]
    if per:
        sizes = staged(sizes[0].join(sizes[1], per), "negatives-blocks")
    else:
        whole = [F.lit(max(1, side.first()[0])) for side in sizes]

    def spread(side: DataFrame, own: str, other: str) -> DataFrame:
        side = side.join(sizes, per) if per else side.withColumns({"anchor_blocks": whole[0], "row_blocks": whole[1]})
        side = side.withColumn(own, F.pmod(F.xxhash64("row_no"), F.col(f"{own}s")).cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("anchor_blocks", "row_blocks")

    return spread(anchors, "anchor_block", "row_block"), spread(rows, "row_block", "anchor_block")


def _met(sides: tuple[DataFrame, DataFrame], per: list[str], fn: Callable, schema: str) -> DataFrame:
    anchors, rows = (side.groupBy(*per, "anchor_block", "row_block") for side in sides)
    return anchors.cogroup(rows).applyInPandas(fn, schema)


def _ranked(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` best rows of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "no_id", "vec_id", "row_no")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
    anchor_block: int = ANCHOR_BLOCK, block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    ``is_anchor`` and ``label`` are columns of ``df``; a null ``is_anchor`` is false.
    """
    vector = df[vector_col]
    if not isinstance(df.schema[vector_col].dataType.elementType, (T.FloatType, T.DoubleType)):
        vector = vector.cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clean = df.where(label.isNotNull() & vector.isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row_no"),
        F.coalesce(df[id_col].cast("long"), F.lit(0).cast("long")).alias("vec_id"),
        df[id_col].isNull().alias("no_id"),
        label.cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        vector.alias("vector"),
    )
    clean = staged(clean, "negatives-rows")
    # Columns of their own, as both sides come from one table.
    anchors = clean.where("is_anchor").select(*[F.col(c).alias(c) for c in ("row_no", "label", "vector")])
    rows = clean.drop("is_anchor")

    inside = _dealt(anchors, rows, ["label"], anchor_block, block)
    found = _met(inside, ["label"], _positives(positives), "anchor long, no_id boolean, vec_id long, row_no long, score long")
    chosen = staged(_ranked(found, ["anchor"], positives), "negatives-positives")

    wanted = chosen.groupBy("anchor").agg(F.collect_set("score").alias("wanted"))
    asking = anchors.join(wanted, F.col("row_no") == F.col("anchor")).select("row_no", "label", "vector", "wanted")
    across = _dealt(asking, rows, [], anchor_block, block)
    kind = "anchor long, wanted long, no_id boolean, vec_id long, row_no long, score long"
    found = _ranked(_met(across, [], _negatives(negatives, band), kind), ["anchor", "wanted"], negatives)

    names = clean.select(F.col("row_no").alias("anchor"), F.when(~F.col("no_id"), F.col("vec_id")).alias("anchor_id"))
    pairs = chosen.select(
        "anchor", F.when(~F.col("no_id"), F.col("vec_id")).alias("positive_id"), F.col("score").alias("wanted")
    ).join(names, "anchor")
    return pairs.join(found, ["anchor", "wanted"]).select(
        "anchor_id", "positive_id", "rank", F.when(~F.col("no_id"), F.col("vec_id")).alias("negative_id"),
        F.col("wanted").alias("positive_score"), F.col("score").alias("negative_score"),
    )
