"""How the sources of a language differ in their words: a recount through minimal perfect hashes.

The first pass counts, exactly, in how many documents of a language each term
occurs, and keeps the frequent ones.  The kept terms are cut into shards by
their hash, and each shard gets a minimal perfect hash: levels of bits at which
most of the remaining terms have a cell to themselves; the rank of its bit is a
term's slot.  The keys are stored in slot order, and a lookup compares them, so
that a term that was not kept is never counted.  The hashes are broadcast,
``ROUND_BYTES`` at a time, and the second pass over the texts increments dense
arrays of slots, one for each group and shard.  These are added up in groups of
bounded size.

A term's share in a group is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), with
N the group's kept terms in all and V the number of terms the language keeps;
all of it is done in integers.  Two tables come out as one: ``pair`` rows with
the sum of |p - q| over all kept terms, for each other source of a language,
and ``term`` rows with p - q against the language as a whole, where it is
positive and the group has the term, for the first ranks only.

Sources are compared in blocks, shard by shard; nothing is gathered per
language.

Cases: null text, language or source count as empty.  Terms are runs of ASCII
letters and all characters beyond ASCII; only A-Z are lower-cased.  A group
without terms still has its pairs; a language without kept terms has pairs of
value 0.  Repeated rows count each time.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import staged, text_of
from wardline.llm.wordhash import small_batches

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SMOOTHING = 5
SCALE_STEPS = 3  # the scale of shares is 1000 to this power
SHARD_TERMS = 1 << 10
ROUND_BYTES = 32 << 20
# Counts kept in one task before they are sent on, and terms of the first pass.
OPEN_SLOTS, OPEN_TERMS = 1 << 22, 1 << 20
SUMMED = 256
SOURCE_BLOCK = 256
MOST_LEVELS = 24

# Every byte that is not part of a term becomes a space, A-Z become lower case.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


# ---------------------------------------------------------------- first pass


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents with the term, added up within a task."""
    found: dict[str, Counter] = defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            terms = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())],
                names=["lang", "term", "n"],
            )
        found.clear()

    for whole in batches:
        for batch in small_batches([whole], "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found[lang].update(set(terms_of(text)))
            if sum(map(len, found.values())) > OPEN_TERMS:
                yield from told()
    yield from told()


# ---------------------------------------------------------------- perfect hashes


def term_hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in terms), np.uint64, len(terms))


def _cells(hashes: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    value = hashes ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((value ^ (value >> np.uint64(31))) % np.asarray(sizes, np.uint64)).astype(np.int64)


def build_hash(terms: list[bytes]) -> tuple[list[int], np.ndarray, list[bytes]]:
    """(size of each level, all levels' cells, terms in slot order) for distinct terms.

    A level has a cell for each term that is left; terms alone in their cell
    take it, and the others go on.  Terms that no level parts (equal hashes)
    follow after the last slot.
    """
    hashes, left = term_hashes(terms), np.arange(len(terms))
    sizes, marks, order = [], [], []
    while len(left) and len(sizes) < MOST_LEVELS:
        size = max(8, 2 * len(left))
        cells = _cells(hashes[left], len(sizes), size)
        taken = np.bincount(cells, minlength=size) == 1
        alone = taken[cells]
        order.extend(left[alone][np.argsort(cells[alone])].tolist())
        sizes.append(size)
        marks.append(taken)
        left = left[~alone]
    order.extend(left.tolist())
    return sizes, np.concatenate(marks) if marks else np.zeros(0, bool), [terms[k] for k in order]


class ShardedHash:
    """The perfect hashes of many shards, looked up together.

    ``slots`` are numbered through all shards; ``starts`` has the first slot of
    each shard.
    """

    def __init__(self, shards: list[tuple[list[int], np.ndarray, list[bytes]]]):
        counts = [len(keys) for _, _, keys in shards]
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        levels = max((len(sizes) for sizes, _, _ in shards), default=0)
        self.sizes = np.ones((levels, len(shards)), np.int64)
        self.bases = np.zeros((levels, len(shards)), np.int64)
        self.ranks = np.zeros(len(shards), np.int64)
        marks, at, rank = [np.zeros(1, bool)], 1, 0
        for k, (sizes, cells, _) in enumerate(shards):
            self.ranks[k] = rank
            for level, size in enumerate(sizes):
                self.sizes[level, k], self.bases[level, k] = size, at
                at += size
            marks.append(cells)
            rank += int(cells.sum())
        self.marks = np.concatenate(marks)
        self.before = np.cumsum(self.marks) - self.marks
        self.keys = np.empty(int(self.starts[-1]), object)
        self.keys[:] = [key for _, _, keys in shards for key in keys]
        # Slots beyond a shard's marked cells: terms with equal hashes.
        self.rest = {
            (k, key): int(self.starts[k]) + place
            for k, (_, cells, keys) in enumerate(shards)
            for place, key in enumerate(keys[int(cells.sum()) :], int(cells.sum()))
        }

    def slots(self, terms: list[bytes], hashes: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """The slot of each term in its shard; -1 for terms that the shard does not hold."""
        out = np.full(len(terms), -1, np.int64)
        left = np.arange(len(terms))
        for level in range(len(self.sizes)):
            own = shards[left]
            # A shard without this level has the one cell 0, which is never marked.
            cells = self.bases[level, own] + _cells(hashes[left], level, self.sizes[level, own])
            hit = self.marks[cells]
            place = self.before[cells[hit]] - self.ranks[own[hit]] + self.starts[own[hit]]
            out[left[hit]] = place
            left = left[~hit]
        seen = np.empty(len(terms), object)
        seen[:] = terms
        found = out >= 0
        found[found] = self.keys[out[found]] == seen[found]
        out[~found] = -1
        for k in np.flatnonzero(~found) if self.rest else ():
            out[k] = self.rest.get((int(shards[k]), terms[k]), -1)
        return out


def shard_of(hashes: np.ndarray, shards: np.ndarray | int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.asarray(shards, np.uint64)).astype(np.int64)


def _shards(table: pa.Table) -> pa.Table:
    """Row (lang, shard, sizes, cells, keys) of one shard's terms."""
    terms = sorted(table.column("term").cast(pa.binary()).to_pylist())
    sizes, marks, keys = build_hash(terms)
    return pa.table(
        {
            "lang": table.column("lang").slice(0, 1),
            "shard": table.column("shard").slice(0, 1),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "cells": pa.array([np.packbits(marks).tobytes()], pa.binary()),
            "keys": pa.array([keys], pa.list_(pa.binary())),
        }
    )


_SHARD_KIND = "lang string, shard int, sizes array<long>, cells binary, keys array<binary>"


def _with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = term_hashes(batch.column("term").cast(pa.binary()).to_pylist())
        shards = shard_of(hashes, batch.column("shards").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("term"), pa.array(shards.astype(np.int32))], names=["lang", "term", "shard"]
        )


# ---------------------------------------------------------------- second pass


class _Lookup:
    """The shards of one round by language, ready for lookups."""

    def __init__(self, rows: list[tuple], counts: dict[str, int]):
        self.rows, self.counts, self.made = rows, counts, {}

    def of(self, lang: str) -> tuple[ShardedHash, np.ndarray, list[int]] | None:
        """(hashes, place of each shard of the language among them or -1, their shard numbers)."""
        if lang not in self.made:
            own = [row for row in self.rows if row[0] == lang]
            places = np.full(self.counts.get(lang, 0), -1, np.int64)
            shards = []
            for k, (_, shard, sizes, cells, keys) in enumerate(own):
                shards.append((sizes, np.unpackbits(np.frombuffer(cells, np.uint8))[: sum(sizes)].astype(bool), keys))
                places[shard] = k
            self.made[lang] = (ShardedHash(shards), places, [row[1] for row in own]) if own else None
        return self.made[lang]


def _recount(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, source, shard, part, counts): dense counts of every group that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(*shared.value)
        dense: dict[tuple[str, str], np.ndarray] = {}
        part = TaskContext.get().partitionId()

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                hashed, _, numbers = lookup.of(lang)
                pieces = np.split(counts, hashed.starts[1:-1])
                some = [k for k, piece in enumerate(pieces) if piece.any()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()),
                        pa.array([source] * len(some), pa.string()),
                        pa.array([numbers[k] for k in some], pa.int32()),
                        pa.array([part] * len(some), pa.int64()),
                        pa.array([pieces[k].tobytes() for k in some], pa.binary()),
                    ],
                    names=["lang", "source", "shard", "part", "counts"],
                )
            dense.clear()

        for whole in batches:
            for batch in small_batches([whole], "text", 8 << 20):
                groups: dict[tuple[str, str], list[bytes]] = defaultdict(list)
                columns = (batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())
                for lang, source, text in zip(*columns, strict=True):
                    groups[lang, source].append(text)
                met: dict[str, dict[bytes, int]] = {}
                for (lang, source), texts in groups.items():
                    made = lookup.of(lang)
                    if made is None:
                        continue
                    hashed, places, _ = made
                    counts = Counter(terms_of(b" ".join(texts)))
                    # Slots of the terms that the batch has not met yet in this language.
                    known = met.setdefault(lang, {})
                    fresh = [t for t in counts if t not in known]
                    if fresh:
                        hashes = term_hashes(fresh)
                        shards = places[shard_of(hashes, len(places))]
                        slots = np.full(len(fresh), -1, np.int64)
                        here = np.flatnonzero(shards >= 0)
                        slots[here] = hashed.slots([fresh[k] for k in here], hashes[here], shards[here])
                        known.update(zip(fresh, slots.tolist(), strict=True))
                    slots = np.fromiter((known[t] for t in counts), np.int64, len(counts))
                    amounts = np.fromiter(counts.values(), np.int64, len(counts))
                    if (lang, source) not in dense:
                        dense[lang, source] = np.zeros(len(hashed.keys), np.int64)
                    dense[lang, source][slots[slots >= 0]] += amounts[slots >= 0]
                if sum(map(len, dense.values())) > OPEN_SLOTS:
                    yield from told()
        yield from told()

    return run


_COUNT_KIND = "lang string, source string, shard int, part long, counts binary"


def _added(table: pa.Table) -> pa.Table:
    """The sum of a bounded group's arrays, as its first row."""
    first = table.slice(0, 1)
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return first.set_column(first.schema.get_field_index("counts"), "counts", pa.array([total.tobytes()], pa.binary()))


def _sums(counts: DataFrame, parts: int) -> DataFrame:
    """Arrays of (lang, source, shard) added up over ``part``, some ``SUMMED`` rows at a time."""
    while True:
        parts = -(-parts // SUMMED)
        grouped = counts.withColumn("part", F.floor(F.col("part") / SUMMED).cast("long")).groupBy("lang", "source", "shard", "part")
        counts = grouped.applyInArrow(_added, _COUNT_KIND)
        if parts <= 1:
            return counts


# ---------------------------------------------------------------- shares


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (n + 5 v)), by long division, which stays within 64 bits."""
    whole, rest = n + SMOOTHING * v, counts.astype(np.int64) + SMOOTHING
    out = rest // whole
    rest = rest % whole
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _pairs(table: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over one shard, for the sources of two blocks (or one)."""
    low, high = table["low"].iloc[0], table["high"].iloc[0]
    left, right = (table[table["block"] == b].sort_values("number") for b in (low, high))
    a, b = (
        np.stack([shares(np.frombuffer(c, np.int64), n, v) for c, n, v in zip(side["counts"], side["n"], side["v"], strict=True)])
        for side in (left, right)
    )
    out = []
    for k, (number, source) in enumerate(zip(left["number"], left["source"], strict=True)):
        sums = np.abs(b - a[k]).sum(axis=1)
        rest = np.flatnonzero(right["number"].to_numpy() > number) if low == high else np.arange(len(right))
        out += [(table["lang"].iloc[0], source, right["source"].iloc[j], int(sums[j])) for j in rest]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def _rising(most: int):
    """Terms of a group whose share is above the language's: the first ``most`` of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], np.int64)
                gain = shares(counts, row["n"], row["v"]) - shares(np.frombuffer(row["total"], np.int64), row["all_n"], row["v"])
                some = np.flatnonzero((counts > 0) & (gain > 0))
                best = sorted(some.tolist(), key=lambda k: (-gain[k], row["keys"][k]))[:most]
                out += [(row["lang"], row["source"], row["keys"][k].decode(), int(gain[k])) for k in best]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "item", "value"])

    return run


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents of a language; ``docs`` is (lang, source, text)."""
    counts = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def dense_counts(docs: DataFrame, hashes: DataFrame, languages: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, shard, part, counts) of all groups, summed; one pass over ``docs`` for each round of shards."""
    spark = docs.sparkSession
    width = F.aggregate("keys", F.lit(64).cast("long"), lambda total, key: total + F.octet_length(key) + 48)
    size, most = hashes.agg(F.coalesce(F.sum(width), F.lit(0)), F.count("*")).first()
    rounds = max(1, min(most, -(-size // round_bytes)))
    counts = {r["lang"]: r["shards"] for r in languages.select("lang", "shards").collect()}
    sums = None
    for number in range(rounds):
        own = hashes.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(rounds)) == number)
        rows = [(r["lang"], r["shard"], list(r["sizes"]), bytes(r["cells"]), [bytes(k) for k in r["keys"]]) for r in own.toLocalIterator()]
        shared = spark.sparkContext.broadcast((rows, counts))
        found = docs.mapInArrow(_recount(shared), _COUNT_KIND)
        part = staged(_sums(found, docs.rdd.getNumPartitions()), "audit-counts")
        sums = part if sums is None else sums.union(part)
    return sums


def source_divergence(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, round_bytes: int = ROUND_BYTES, source_block: int = SOURCE_BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): the ``pair`` and ``term`` rows of every group."""
    docs = df.select(text_of(df, lang_col).alias("lang"), text_of(df, source_col).alias("source"), text_of(df, text_col).alias("text"))
    terms = staged(kept_terms(docs, least), "audit-terms")

    # One row for each group and language: few, as the result has all pairs of a language's sources.
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = docs.select("lang", "source").distinct().withColumn("number", F.row_number().over(by_name) - 1)
    groups = staged(groups.withColumn("block", F.floor(F.col("number") / source_block).cast("int")), "audit-groups")
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    languages = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks")).join(kept, "lang", "left")
    languages = languages.withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    languages = staged(languages.withColumn("shards", F.greatest(F.ceil(F.col("v") / shard_terms), F.lit(1)).cast("int")), "audit-languages")

    placed = terms.join(languages.select("lang", "shards"), "lang").mapInArrow(_with_shard, "lang string, term string, shard int")
    hashes = staged(placed.groupBy("lang", "shard").applyInArrow(_shards, _SHARD_KIND), "audit-hashes")
    counts = dense_counts(docs, hashes, languages, round_bytes)

    # Every group has an array for every shard of its language; groups without a term there have zeros.
    shards = languages.select("lang", "v", "blocks", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    shards = shards.join(hashes.select("lang", "shard", "keys"), ["lang", "shard"], "left")
    shards = shards.withColumn("slots", F.when(F.col("keys").isNull(), 0).otherwise(F.size("keys")))
    shards = staged(shards, "audit-shards")
    empty = F.unhex(F.repeat(F.lit("00"), F.col("slots") * 8))
    grid = groups.join(shards.drop("keys"), "lang").join(counts.drop("part"), ["lang", "source", "shard"], "left")
    grid = grid.withColumn("counts", F.coalesce("counts", empty)).mapInArrow(
        _with_amount,
        "lang string, source string, number int, block int, v long, blocks int, shard int, counts binary, amount long",
    )
    grid = staged(grid, "audit-grid")
    sizes = staged(grid.groupBy("lang", "source").agg(F.sum("amount").alias("n")), "audit-sizes")
    full = staged(grid.join(sizes, ["lang", "source"]), "audit-full")

    other = full.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
    met = other.select("lang", "source", "number", "block", "shard", "low", "high", "v", "n", "counts")
    sums = met.groupBy("lang", "shard", "low", "high").applyInPandas(_pairs, "lang string, a string, b string, value long")
    sums = staged(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "audit-pairs")
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))

    # A language's own counts: its groups', added up like a group's parts.
    totals = full.select("lang", F.lit("").alias("source"), "shard", F.col("number").cast("long").alias("part"), "counts")
    most = groups.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
    totals = _sums(totals, most).select("lang", "shard", F.col("counts").alias("total"))
    sized = sizes.groupBy("lang").agg(F.sum("n").alias("all_n"))
    rising = full.where("amount > 0").join(totals, ["lang", "shard"]).join(sized, "lang").join(shards.select("lang", "shard", "keys"), ["lang", "shard"])
    rising = rising.select("lang", "source", "v", "n", "all_n", "counts", "total", "keys")
    found = rising.mapInArrow(_rising(top), "lang string, source string, item string, value long")

    both = pairs.withColumn("part", F.lit("pair")).unionByName(found.withColumn("part", F.lit("term")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("part").eqNullSafe("pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _with_amount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the sum of each row's counts."""
    names = ("lang", "source", "number", "block", "v", "blocks", "shard", "counts")
    for batch in batches:
        amounts = [int(np.frombuffer(x, np.int64).sum()) for x in batch.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(amounts, pa.int64())], names=[*names, "amount"])
