"""URL filters: exact list membership by a cascade of Bloom filters.

A cascade answers whether a key of a known universe is listed, without a join.
Its first level holds the listed keys; the second those other keys of the
universe that the first lets through; the third the listed keys that the second
lets through; and so on, until a level lets nothing through by mistake.  A key
belongs to the side at which it is first turned away, so for every key of the
universe the answer is exact.  The universe is complete: it holds every key
that the corpus asks for.  Only distinct keys are exchanged to build it; the
rows themselves are never shuffled.

A url asks for few keys: its host's last labels, for each number of labels that
a list has, with the first characters of its path, for each length that a list
has.  A rule (host, path) fits its host and all subdomains, if the url's path
starts with the rule's; the longest fitting rule decides.  Where none fits, the
list of blocked domains decides in the same way: block if the host or one of
its parents is listed, else allow.

Levels are built by Spark as tables of 64-cell words.  Listed keys are cut into
slices by their hash, so that a slice's filters stay within ``SLICE_KEYS`` keys;
one slice is broadcast at a time, and the rows are marked slice by slice
without an exchange.

Cases: a null url, or one without ``://``, has an empty host and path, which no
key fits: the verdict is allow.  Only A-Z are lower-cased.  A key that is both
allowed and blocked is blocked.  Empty lists allow everything.  Repeated rows,
null ids and further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Cells a key and hash functions: about one mistake in 100 first, one in 40 later.
FIRST_LEVEL, LATER_LEVEL = (10, 7), (8, 5)
# Listed keys of one slice: its levels take some 16 MB.
SLICE_KEYS = 1 << 23
# Levels shrink a hundredfold; only keys with equal 128-bit hashes could go on for so long.
MOST_LEVELS = 40
SEEDS = {"left": 1, "right": 2}

Rule = tuple[str, str, str]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host to the next ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def cells(left: np.ndarray, right: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
    """The cells (keys by hashes) of keys with the given two hashes at a level."""
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    a, b = _mixed(left.view(np.uint64) ^ seed), _mixed(right.view(np.uint64) + seed) | np.uint64(1)
    steps = np.arange(hashes, dtype=np.uint64)
    return ((a[:, None] + steps * b[:, None]) % np.uint64(size)).astype(np.int64)


# A level is (number of cells, hash functions, its cells as 64-bit words).
Level = tuple[int, int, np.ndarray]


def lets_through(level: Level, number: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    size, hashes, words = level
    found = cells(left, right, number, size, hashes)
    return ((words[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)


def listed(levels: list[Level], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: those turned away first by a level of the other keys."""
    out = np.zeros(len(left), bool)
    open_ = np.arange(len(left))
    for k, level in enumerate(levels):
        through = lets_through(level, k, left[open_], right[open_])
        out[open_[~through]] = k % 2 == 1
        open_ = open_[through]
    # What every level lets through belongs to the side that the last one holds.
    out[open_] = len(levels) % 2 == 1
    return out


def _level_words(keys: DataFrame, level: int, size: int, hashes: int) -> np.ndarray:
    """The filter of a table of key hashes, put together word by word; its size is bounded by its slice."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = cells(batch["left"].to_numpy(np.int64), batch["right"].to_numpy(np.int64), level, size, hashes).ravel()
            masks = np.uint64(1) << (found & 63).astype(np.uint64)
            yield pd.DataFrame({"word": found >> 6, "mask": masks.view(np.int64)})

    words = keys.mapInPandas(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros((size + 63) // 64, np.uint64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def _passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[lets_through(shared.value, number, batch["left"].to_numpy(np.int64), batch["right"].to_numpy(np.int64))]

    return keys.mapInPandas(keep, "left long, right long")


def build_cascade(universe: DataFrame) -> list[Level]:
    """The levels for a table (left, right, listed) of distinct key hashes."""
    keys = {True: universe.where("listed").select("left", "right"), False: universe.where("not listed").select("left", "right")}
    levels: list[Level] = []
    side, count = True, keys[True].count()
    while count:
        if len(levels) == MOST_LEVELS:
            raise ValueError("a listed and another key have equal hashes")
        per_key, hashes = LATER_LEVEL if levels else FIRST_LEVEL
        size = max(64, per_key * count)
        level = (size, hashes, _level_words(keys[side], len(levels), size, hashes))
        side = not side
        keys[side] = staged(_passing(keys[side], level, len(levels)), "cascade-keys")
        levels.append(level)
        count = keys[side].count()
    return levels


def _hash_with(seed: int) -> Callable[[Column], Column]:
    return lambda key: F.xxhash64(key, F.lit(seed))


def _hashes(key: Column) -> list[Column]:
    return [_hash_with(seed)(key).alias(name) for name, seed in SEEDS.items()]


def with_listed(rows: DataFrame, keys: str, lists: dict[str, DataFrame], slice_keys: int = SLICE_KEYS) -> DataFrame:
    """Replace the array column ``keys`` by arrays of the keys that each list holds, in the array's order.

    ``lists`` are tables of one text column by the name of the column they make;
    ``keys`` is an array of text.  The rows are not shuffled.
    """
    asked = staged(rows.select(F.explode(keys).alias("key")).distinct().select("key", *_hashes(F.col("key"))), "cascade-universe")
    for name, table in lists.items():
        held = staged(table.toDF("key").where("key is not null").distinct(), f"cascade-{name}")
        slices = max(1, -(-held.count() // slice_keys))
        universe = asked.join(held.withColumn("held", F.lit(True)), "key", "left")
        universe = universe.select("left", "right", F.coalesce("held", F.lit(False)).alias("listed"))
        universe = staged(universe, "cascade-sides")
        rows = rows.withColumn(name, F.array().cast("array<string>"))
        for number in range(slices):
            levels = build_cascade(universe.where(F.pmod("left", F.lit(slices)) == number))
            if levels:
                rows = _marked(rows, keys, name, levels, slices, number)
                # The marked rows are written, so that one slice's filters are in memory at a time.
                rows = staged(rows, "cascade-rows") if slices > 1 else rows
    return rows.drop(keys)


def _marked(rows: DataFrame, keys: str, name: str, levels: list[Level], slices: int, number: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("array<boolean>")
    def member(left: pd.Series, right: pd.Series) -> pd.Series:
        counts = left.map(len).to_numpy()
        a, b = (np.concatenate([np.asarray(x, np.int64) for x in side] or [np.empty(0, np.int64)]) for side in (left, right))
        found = np.zeros(len(a), bool)
        own = a % slices == number
        found[own] = listed(shared.value, a[own], b[own])
        return pd.Series(np.split(found, np.cumsum(counts)[:-1]) if len(counts) else [], dtype=object)

    marks = member(*[F.transform(keys, _hash_with(seed)) for seed in SEEDS.values()])
    rows = rows.withColumn("marks_", marks)
    hits = F.transform(F.filter(F.arrays_zip(F.col(keys).alias("key"), F.col("marks_").alias("hit")), lambda x: x["hit"]), lambda x: x["key"])
    # Keys that one url asks for twice are told once; later slices add to earlier ones.
    return rows.withColumn(name, F.array_distinct(F.concat(name, hits))).drop("marks_")


def asked_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a url for lists whose keys have these numbers of labels and lengths of paths, longest first."""
    keys = [F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)) for labels, length in shapes]
    found = F.array_distinct(F.array(*keys)) if keys else F.array().cast("array<string>")
    return F.when(host != "", found).otherwise(F.array().cast("array<string>"))


def _shape(host: str, path: str) -> tuple[int, int]:
    return host.count(".") + 1, len(path)


def url_verdicts(
    pages: DataFrame, rules: list[Rule], blocked: DataFrame, id_col: str = "page_id", url_col: str = "url",
    slice_keys: int = SLICE_KEYS,
) -> DataFrame:
    """(id, host, path, rule, listed, verdict) of every row.

    ``rules`` are (host, path, allow or block); ``blocked`` is a table with one
    column of domains.  ``rule`` is the fitting rule, ``listed`` the longest
    fitting domain, both null where there is none.
    """
    spark: SparkSession = pages.sparkSession
    rules = [(lower, path, verdict) for host, path, verdict in rules if (lower := host.translate(str.maketrans(UPPER, LOWER)))]
    shapes = sorted({_shape(host, path) for host, path, _ in rules})
    blocked = blocked.select(lower_ascii(F.col(blocked.columns[0]).cast("string")).alias("key")).where("key <> ''")
    # Few numbers: domains have some 127 labels at most.
    labels = [r[0] for r in blocked.select((F.length("key") - F.length(F.replace("key", F.lit("."))) + 1).alias("n")).distinct().collect()]
    shapes = sorted({*shapes, *((n, 0) for n in labels)})
    rows = pages.select(pages[id_col].alias(id_col), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    rows = rows.withColumn("keys_", asked_keys(F.col("host"), F.col("path"), shapes))
    sides = {
        f"{verdict}_": spark.createDataFrame([(host + path,) for host, path, v in rules if v == verdict], "key string")
        for verdict in ("allow", "block")
    }
    found = with_listed(rows, "keys_", {**sides, "listed_": blocked}, slice_keys)
    longest = {name: _longest(F.col(f"{name}_")) for name in ("allow", "block", "listed")}
    # At equal length only one and the same key can fit, or one of an equally long host and path; blocks win.
    blocks = F.coalesce(F.length(longest["block"]), F.lit(-1)) >= F.coalesce(F.length(longest["allow"]), F.lit(-1))
    rule = F.when(blocks, longest["block"]).otherwise(longest["allow"])
    verdict = F.when(rule.isNotNull(), F.when(blocks, "block").otherwise("allow"))
    verdict = F.coalesce(verdict, F.when(longest["listed"].isNotNull(), "block").otherwise("allow"))
    return found.select(id_col, "host", "path", rule.alias("rule"), longest["listed"].alias("listed"), verdict.alias("verdict"))


def _longest(keys: Column) -> Column:
    """The longest text of an array, by code points; the first of equally long ones; null of none."""
    return F.aggregate(
        keys, F.lit(None).cast("string"), lambda best, key: F.when(best.isNull() | (F.length(key) > F.length(best)), key).otherwise(best)
    )
