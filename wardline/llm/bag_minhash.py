"""Near duplicates by BagMinHash signatures of word shingles.

A document is the multiset of its five-word shingles (of all its words, if it
has fewer); the similarity of two is the weighted Jaccard index, the sum of
the smaller counts over the sum of the larger.

Signatures: a shingle of count w owns, for every unit below w, a Poisson
process of rate one, whose points fall on random components; a component keeps
its earliest point.  Two documents then agree in a component with a
probability equal to their similarity.  The processes are generated in a
hierarchy over the counts, [0, 1), [1, 2), [2, 4), [4, 8) ...: one process per
level with the level's rate, whose points are split among its units by a
further random number, so a count of w costs about log2 w processes.  Points
are only drawn up to the time by which all components are taken; where one is
not, the time is extended.

Bands of the signature are joined.  First, in every bucket (documents with an
equal band) the smallest document is compared with the others, so a bucket of
copies costs as many comparisons as it has members.  Buckets that are then one
component are done.  Documents that share one of the other buckets, directly
or through others, form a group; the members of a group are spread over blocks
of bounded text, and every two blocks are compared in one task, but for pairs
that are in one component already.  A comparison counts the shingles of both
texts; a block gives back only links that join components.  So no link that
could join two components is left out, nothing is capped, and pairs are never
written out.  Documents with the same multiset are first reduced to one.

Cases: null and empty texts have no shingles and are alike to nothing; a null
id is alike to nothing; rows that share an id are one document.  Empty tables
give empty results.  Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import wordhash as wh
from wardline.llm.bloom import rows_in
from wardline.llm.common import staged, text_of
from wardline.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 26
BAND_ROWS = 5
BLOCK_BYTES = 1 << 20  # of text
TILE = 256  # documents whose shingles are compared at once
COLUMNS = 8192  # shingles of a tile at once
_GOLD = 0x9E3779B97F4A7C15


def shingles(words: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of each document's distinct shingles, sorted."""
    docs = len(before) - 1
    sizes = np.diff(before)
    hashes = wh.sequence_hashes(words, length)
    owner = np.repeat(np.arange(docs), np.maximum(sizes - length + 1, 0))
    first = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(before, before[1:], strict=False) if b - a >= length] or [np.empty(0, np.int64)])
    few = np.flatnonzero((sizes > 0) & (sizes < length))
    whole = [wh.sequence_hashes(words[before[d] : before[d + 1]], int(sizes[d]))[0] for d in few]
    values = np.concatenate([hashes[first], np.array(whole, np.uint64)])
    owner = np.concatenate([owner, few])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], values[at], np.diff(np.append(at, len(values)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(owner: np.ndarray, values: np.ndarray, counts: np.ndarray, docs: int, m: int) -> np.ndarray:
    """(docs, m) earliest points; infinite where a document has no shingle."""
    sig = np.full(docs * m, np.inf)
    weight = np.bincount(owner, counts, docs)
    # Levels 0, 1, 2 ... cover the units [0, 1), [1, 2), [2, 4) ...
    levels = np.ceil(np.log2(counts)).astype(np.int64) + 1 if len(counts) else counts
    row = np.repeat(np.arange(len(values)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    rate = np.maximum(low, 1)
    seed = wh.mix(values[row] + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    doc, top = owner[row], counts[row]
    time, drawn = np.zeros(len(row)), np.zeros(len(row), np.uint64)
    limit = np.divide(m * (math.log(m) + 3), weight, out=np.zeros(docs), where=weight > 0)
    active = np.arange(len(row))
    while True:
        while len(active):  # the next point of every process that has not passed its limit
            drawn[active] += np.uint64(1)
            state = wh.mix(seed[active] + drawn[active] * np.uint64(_GOLD))
            time[active] -= np.log(_uniform(state)) / rate[active]
            split = wh.mix(state ^ np.uint64(0xA0761D6478BD642F))
            place = doc[active] * m + (split % np.uint64(m)).astype(np.int64)
            unit = low[active] + (_uniform(wh.mix(split)) * rate[active]).astype(np.int64)
            ours = unit < top[active]
            np.minimum.at(sig, place[ours], time[active][ours])
            active = active[time[active] <= limit[doc[active]]]
        # Settled once the latest component's earliest point is within the limit.
        worst = sig.reshape(docs, m).max(axis=1)
        unsettled = (worst > limit) & (weight > 0)
        if not unsettled.any():
            return sig.reshape(docs, m)
        limit = np.where(unsettled, np.where(np.isfinite(worst), worst, limit * 1.7), limit)
        active = np.flatnonzero(unsettled[doc] & (time <= limit[doc]))


def similarity(ours: tuple, theirs: tuple, docs: int) -> np.ndarray:
    """Weighted Jaccard index of every row's two multisets, as ``shingles`` gives them."""
    owner, values, counts = (np.concatenate([a, b]) for a, b in zip(ours, theirs, strict=True))
    order = np.lexsort((values, owner))
    owner, values, counts = owner[order], values[order], counts[order]
    twin = np.flatnonzero((owner[1:] == owner[:-1]) & (values[1:] == values[:-1]))
    shared = np.bincount(owner[twin], np.minimum(counts[twin], counts[twin + 1]), docs)
    union = np.bincount(owner, counts, docs) - shared
    return np.divide(shared, union, out=np.zeros(docs), where=union > 0)


def _text_shingles(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, before = wh.word_hashes(*wh.text_bytes(column))
    return shingles(words, before, length)


def _profiles(length: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.small_batches(batches, "text"):
            docs = batch.num_rows
            owner, values, counts = _text_shingles(batch.column("text"), length)
            sig = signatures(owner, values, counts, docs, bands * rows)
            keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD) + np.zeros((docs, 1), np.uint64)
            for k in range(rows):
                keys = wh.mix(keys + sig.reshape(docs, bands, rows)[:, :, k].view(np.uint64) * np.uint64(2 * k + 3))
            bags = []
            for salt in (1, 2):
                each = wh.mix(values + np.uint64(salt)) * counts.astype(np.uint64)
                sums = np.zeros(docs, np.uint64)
                np.add.at(sums, owner, each)
                bags.append(pa.array(sums.view(np.int64)))
            total = np.bincount(owner, counts, docs).astype(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(docs + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *bags, pa.array(total), lists], names=["doc_id", "bag1", "bag2", "total", "bands"]
            )

    return run


def _alike(length: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.small_batches(batches, "text_a", 1 << 20):
            ours, theirs = (_text_shingles(batch.column(c), length) for c in ("text_a", "text_b"))
            near = similarity(ours, theirs, batch.num_rows) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, length: int, threshold: float) -> DataFrame:
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.mapInArrow(_alike(length, threshold), "a long, b long").distinct()


def _features(column: pa.Array, length: int) -> list[np.ndarray]:
    """Per text, its shingles as a sorted set: the n-th of a kind is a feature of its own."""
    owner, values, counts = _text_shingles(column, length)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    each = wh.mix(np.repeat(values, counts) + nth.astype(np.uint64) * np.uint64(_GOLD))
    cuts = np.searchsorted(np.repeat(owner, counts), np.arange(1, len(column)))
    return [np.sort(f) for f in np.split(each, cuts)] if len(column) else []


def _shared_counts(ours: list[np.ndarray], theirs: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of features that two documents share."""
    out = np.zeros((len(ours), len(theirs)), np.float32)
    known = np.intersect1d(np.concatenate(ours), np.concatenate(theirs))
    for at in range(0, len(known), COLUMNS):
        part = known[at : at + COLUMNS]
        sides = []
        for side in (ours, theirs):
            lengths = [len(f) for f in side]
            flat = np.concatenate(side)
            place = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[place] == flat
            matrix = np.zeros((len(side), len(part)), np.float32)
            matrix[np.repeat(np.arange(len(side)), lengths)[hit], place[hit]] = 1.0
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out


def joining_links(ids: np.ndarray, comps: np.ndarray, blocks: tuple[np.ndarray, np.ndarray], features: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between two blocks (rows of ``ids``) that join components, as a spanning forest."""
    root = {int(c): int(c) for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    sizes = np.array([len(f) for f in features])
    links = []
    # Rows in order of component: tiles within one component are skipped.
    tiles = [[rows[at : at + TILE] for at in range(0, len(rows), TILE)] for rows in (b[np.argsort(comps[b], kind="stable")] for b in blocks)]
    for a in tiles[0]:
        for b in tiles[1]:
            if len({find(int(c)) for c in comps[np.concatenate([a, b])]}) == 1:
                continue
            shared = _shared_counts([features[k] for k in a], [features[k] for k in b])
            union = sizes[a][:, None] + sizes[b][None, :] - shared
            for i, j in zip(*np.nonzero(shared >= threshold * union), strict=True):
                x, y = find(int(comps[a[i]])), find(int(comps[b[j]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(ids[a[i]]), int(ids[b[j]])))
    return links


def _compare_blocks(length: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for k in range(batch.num_rows):
                entries = batch.column("members")[k].values
                ids, comps, block = (entries.field(c).to_numpy() for c in ("doc", "comp", "block"))
                features = _features(entries.field("text"), length)
                low, high = batch.column("low")[k].as_py(), batch.column("high")[k].as_py()
                links += joining_links(ids, comps, (np.flatnonzero(block == low), np.flatnonzero(block == high)), features, threshold)
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def bucket_links(members: DataFrame, texts: DataFrame, length: int, threshold: float) -> DataFrame:
    """Verified links (a, b) that join all components of documents that share a bucket.

    ``members`` is (bucket, doc), ``texts`` is (doc, text).
    """
    leaders = members.groupBy("bucket").agg(F.min("doc").alias("a"))
    pairs = members.join(staged(leaders, "near-leaders"), "bucket").where("a < doc")
    pairs = staged(pairs.select("a", F.col("doc").alias("b")).distinct(), "near-pairs")
    links = staged(_verified(pairs, texts, length, threshold), "near-links")
    comps = staged(components(links).toDF("doc", "comp"), "near-components")
    waiting = members.join(comps, "doc", "left").select("bucket", "doc", F.coalesce("comp", "doc").alias("comp"))
    waiting = staged(waiting, "near-waiting")
    mixed = waiting.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("doc").alias("first")).where("x < y")
    waiting = staged(waiting.join(staged(mixed.select("bucket", "first"), "near-mixed"), "bucket"), "near-waiting")
    groups = components(waiting.select("first", "doc").distinct()).toDF("doc", "group")
    rows = waiting.select("doc", "comp").distinct().join(groups, "doc").join(texts, "doc")
    rows = staged(rows, "near-groups")
    sizes = rows.groupBy("group").agg(F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES).cast("int").alias("blocks"))
    rows = rows.join(staged(sizes, "near-sizes"), "group")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    packed = rows.groupBy("group", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")).agg(
        F.collect_list(F.struct("doc", "comp", "block", "text")).alias("members")
    )
    more = packed.select("low", "high", "members").mapInArrow(_compare_blocks(length, threshold), "a long, b long")
    return links.union(staged(more, "near-links"))


def near_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, threshold: float = THRESHOLD,
    bands: int = BANDS, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id (the smallest id of its class), kept (doc_id = class_id)."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    kind = "doc_id long, bag1 long, bag2 long, total long, bands array<long>"
    profiles = staged(docs.mapInArrow(_profiles(length, bands, band_rows), kind), "near-profiles")
    usable = profiles.where("doc_id is not null and total > 0")
    # Documents with one multiset are one node, named by the smallest id.
    bags = usable.groupBy("bag1", "bag2", "total").agg(F.min(F.struct("doc_id", "bands")).alias("least"))
    bags = staged(bags.select("bag1", "bag2", "total", F.col("least.doc_id").alias("node"), F.col("least.bands").alias("bands")), "near-bags")
    spread = bags.select(F.col("node").alias("doc"), F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y")
    members = staged(spread.join(buckets.select("bucket"), "bucket").select("bucket", "doc"), "near-members")
    texts = staged(rows_in(docs, "doc_id", members.select("doc").distinct()).toDF("doc", "text"), "near-texts")
    links = bucket_links(members, texts, length, threshold)
    # An id with several rows belongs to several multisets; they are linked too.
    named = usable.join(bags.drop("bands"), ["bag1", "bag2", "total"])
    own = named.where("node < doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    classes = components(links.union(own)).toDF("id_", "class_")
    out = profiles.select("doc_id").join(classes, F.col("doc_id") == F.col("id_"), "left")
    out = out.select("doc_id", F.coalesce("class_", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
