"""Repeated passages, by relative Lempel-Ziv factors against an index of all documents.

A window is ``WINDOW`` consecutive words of one document.  A word is removed
when it lies in a window that also starts in a document with a smaller id.

The reference is every document, indexed in blocks by anchor: of the word
runs inside a window the one with the least hash is its anchor, so equal
windows share theirs.  A document need only be parsed against the blocks of
those of its anchors that other documents have too; all its windows at such
anchors are looked up there, which gives each the smallest document that holds
it, and where.  Windows that go on in one such document are a candidate.

Where a stretch of windows has several candidates, each is extended to both
sides, word by word, against the blocks of its document's text, and so is
checked every candidate of fewer than ``SURE`` windows.  The parse is greedy:
of the candidates that hold the words from here on, a factor takes the longest,
and the next factor starts at the first window that reaches beyond it, so no
match that straddles a factor's end is lost.  The factors' words are the
duplicate spans.  Candidates are the smallest documents of their windows; a
document that is the smallest of none is not looked at, though it might hold a
longer match.  That changes where a factor ends, never which words are removed.

Only hashes travel (64 bits each for anchor and window), texts only of
documents that share an anchor, and words only of candidates to extend, each
up to the end of its stretch.  Counts and minima are combined before each
exchange and written first; a passage that a third of all documents hold is a
skewed join key that adaptive execution splits.  Documents equal word for word
are parsed once.

Cases: null and empty texts have no words; a null id is never smaller than
another and has nothing removed; rows that repeat an id are no copies of each
other, and a candidate in such rows may be extended in any of them.  Empty tables give empty results.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import wordhash as wh
from wardline.llm.bloom import filter_words, rows_in, with_suspicion
from wardline.llm.common import staged, text_of

WINDOW = 50
GRAM = 12  # words of an anchor
BLOCK = 256  # words of a block of a document's text
SURE = 3  # windows one after another in the same document that need no look at their words
LEFT, RIGHT, WITHIN = 0, 1, 2
EMPTY = hashlib.sha256(b"").hexdigest()


def window_anchors(words: np.ndarray, before: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchor position, anchor hash) of every window that lies in one document.

    The least run decides, by the top bits of its hash and then by place, so
    the choice depends on the window's words alone.
    """
    n = len(words) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, np.empty(0, np.uint64)
    hashes = wh.sequence_hashes(words, gram)
    place_bits = np.uint64(max(len(hashes), 1).bit_length())
    key = (hashes >> place_bits << place_bits) | np.arange(len(hashes), dtype=np.uint64)
    wide, span = 1, window - gram + 1
    while wide * 2 <= span:
        key = np.minimum(key[:-wide], key[wide:])
        wide *= 2
    if wide < span:
        key = np.minimum(key[: len(key) - (span - wide)], key[span - wide :])
    place = (key & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    ends = np.searchsorted(before, np.arange(n), "right")  # the document after the one of each start
    inside = np.arange(n) + window <= before[np.minimum(ends, len(before) - 1)]
    starts = np.flatnonzero(inside)
    return starts, place[starts], hashes[place[starts]]


def _profiles(window: int, gram: int):
    """Per document: number of words, digest of its words, its distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.small_batches(batches, "text"):
            data, bounds = wh.text_bytes(batch.column("text"))
            words, before = wh.word_hashes(data, bounds)
            starts, place, anchor = window_anchors(words, before, window, gram)
            doc = np.searchsorted(before, starts, "right") - 1
            new = np.ones(len(starts), bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
            counts = np.bincount(doc[new], minlength=batch.num_rows)
            raw = data.tobytes()
            digests = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            anchors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchor[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "digest")), pa.array(np.diff(before)), pa.array(digests, pa.string()), anchors],
                names=["doc_id", "digest", "n_words", "words_sha256", "anchors"],
            )

    return run


def _windows(window: int, gram: int):
    """Per document with shared anchors: the windows at those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.small_batches(batches, "text"):
            data, bounds = wh.text_bytes(batch.column("text"))
            words, before = wh.word_hashes(data, bounds)
            starts, _, anchor = window_anchors(words, before, window, gram)
            doc = np.searchsorted(before, starts, "right") - 1
            shared = batch.column("anchors")
            lists = [shared[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in range(batch.num_rows)]
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            hit = np.zeros(len(starts), bool)
            for k, known in enumerate(lists):
                hit[edges[k] : edges[k + 1]] = np.isin(anchor[edges[k] : edges[k + 1]], known)
            hashes = wh.sequence_hashes(words, window)
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            content = wh.mix(hashes[starts[hit]] ^ anchor[hit])
            order = np.lexsort((content, doc[hit]))
            first = np.ones(len(order), bool)
            first[order[1:]] = (np.diff(content[order]) != 0) | (np.diff(doc[hit][order]) != 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[doc[hit]], pa.int64()),
                    pa.array(rows[doc[hit]], pa.int64()),
                    pa.array((starts[hit] - before[doc[hit]]).astype(np.int32)),
                    pa.array(content.view(np.int64)),
                    pa.array(first),
                ],
                names=["doc_id", "row", "at", "content", "first"],
            )

    return run


class Run(NamedTuple):
    """Windows start..last of a document that go on in ``source`` from its word ``source_at``."""

    start: int
    last: int
    source: int
    source_at: int


def candidate_runs(at: np.ndarray, found: np.ndarray, found_at: np.ndarray) -> list[Run]:
    """The runs of the windows found; ``at`` is sorted and without repeats."""
    if not len(at):
        return []
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(found) != 0) | (np.diff(found_at) != 1)) + 1
    firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]]) - 1
    return [Run(int(at[a]), int(at[b]), int(found[a]), int(found_at[a])) for a, b in zip(firsts, lasts, strict=True)]


def pieces_to_compare(runs: list[Run], words: list[bytes], window: int, block: int) -> Iterator[tuple]:
    """(run, side, number, source, block, first word in the block, words) of what must be compared with the source.

    A stretch is runs without a gap between them.  Alone in its stretch, a run
    cannot go on: the next window would have been found.
    """
    a = 0
    while a < len(runs):
        b = a + 1
        while b < len(runs) and runs[b].start == runs[b - 1].last + 1:
            b += 1
        low, high = runs[a].start, runs[b - 1].last + window
        for k in range(a, b):
            start, last, source, source_at = runs[k]
            shift = source_at - start
            ranges = [(LEFT, max(low, -shift), start), (RIGHT, last + window, high)] if b - a > 1 else []
            if last - start + 1 < SURE:
                ranges.append((WITHIN, start, last + window))
            for side, begin, end in ranges:
                if begin >= end:
                    continue
                cuts = range((begin + shift) // block, (end + shift - 1) // block + 1)
                for number, at in enumerate(reversed(cuts) if side == LEFT else cuts):
                    left, right = max(begin, at * block - shift), min(end, (at + 1) * block - shift)
                    yield k, side, number, source, at, left + shift - at * block, b" ".join(words[left:right])
        a = b


def extents(runs: list[Run], compared: list[tuple[int, int, int, int, bool]], window: int) -> list[tuple[int, int, int]]:
    """(begin, end, source) of every run, extended by what agreed; compared: (run, side, number, words that agree, all do)."""
    agreed: dict[tuple[int, int], dict[int, tuple[int, bool]]] = {}
    for run, side, number, matched, whole in compared:
        had = agreed.setdefault((run, side), {})
        had[number] = max(had.get(number, (0, False)), (matched, whole))

    def reach(run: int, side: int) -> int:
        total, number, had = 0, 0, agreed.get((run, side), {})
        while number in had:
            total += had[number][0]
            if not had[number][1]:
                break
            number += 1
        return total

    out = []
    for k, (start, last, source, _) in enumerate(runs):
        begin, end = start, last + window
        if last - start + 1 < SURE and reach(k, WITHIN) < end - start:
            continue  # equal hashes of different words
        out.append((begin - reach(k, LEFT), end + reach(k, RIGHT), source))
    return out


def greedy_factors(spans: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int]]:
    """(start, number of words, document) of the greedy parse; spans: (begin, end, document), of ``window`` words or more."""
    spans, out = sorted(spans), []
    at, k, best = 0, 0, (0, 0)
    while True:
        while k < len(spans) and spans[k][0] <= at:
            best = max(best, (spans[k][1], -spans[k][2]))  # the longest, then the smallest document
            k += 1
        if best[0] - at >= window:
            out.append((at, best[0] - at, -best[1]))
            at = best[0] - window + 1  # the first window that reaches beyond the factor
        elif k < len(spans):
            at = spans[k][0]
        else:
            return out


def _result(row: int, words: list[bytes], factors: list[tuple[int, int, int]]) -> dict:
    drop = np.zeros(len(words), bool)
    for start, length, _ in factors:
        drop[start : start + length] = True
    kept = b" ".join([words[k] for k in np.flatnonzero(~drop)]).decode()
    starts, lengths, sources = ([f[k] for f in factors] for k in range(3))
    return {"row": row, "n_removed": int(drop.sum()), "kept": kept, "starts": starts, "lengths": lengths, "sources": sources}


_RESULT = [
    ("row", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("sources", pa.list_(pa.int64())),
]
_RESULT_TYPE = "row long, n_removed long, kept string, starts array<int>, lengths array<int>, sources array<long>"
_PIECE = ("run", "side", "number", "source", "block", "off", "words")
_PARSE = pa.schema([
    *_RESULT, ("text", pa.string()), ("lasts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())),
    ("run", pa.int32()), ("side", pa.int32()), ("number", pa.int32()), ("source", pa.int64()),
    ("block", pa.int32()), ("off", pa.int32()), ("words", pa.string()),
])
_PARSE_TYPE = (
    f"{_RESULT_TYPE}, text string, lasts array<int>, places array<int>, run int, side int, number int, source long, "
    "block int, off int, words string"
)


def _runs(window: int, block: int):
    """Documents with windows found elsewhere: their parse, or, where words must be compared, runs, text and pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.small_batches(batches, "text"):
            out, size = [], 0
            for row, text, hits in zip(batch.column("row"), batch.column("text"), batch.column("hits"), strict=True):
                at, found, found_at = (hits.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                at, order = np.unique(at, return_index=True)
                runs = candidate_runs(at, found[order], found_at[order])
                row, words = row.as_py(), text.as_py().encode().split()
                is_open = False
                for piece in pieces_to_compare(runs, words, window, block):
                    is_open = True
                    out.append({"row": row, **dict(zip(_PIECE, (*piece[:-1], piece[-1].decode()), strict=True))})
                    size += len(piece[-1])
                    if size > 1 << 22:  # written as they come, however many a document has
                        yield pa.RecordBatch.from_pylist(out, _PARSE)
                        out, size = [], 0
                if is_open:
                    starts, lasts, sources, places = (list(column) for column in zip(*runs, strict=True))
                    out.append({"row": row, "text": text.as_py(), "starts": starts, "lasts": lasts, "sources": sources, "places": places})
                else:
                    out.append(_result(row, words, greedy_factors(extents(runs, [], window), window)))
            yield pa.RecordBatch.from_pylist(out, _PARSE)

    return run


def _blocks(block: int):
    """The words of documents in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.small_batches(batches, "text"):
            ids, places, words = [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                split = text.as_py().encode().split()
                for k, at in enumerate(range(0, len(split), block)):
                    ids.append(doc_id.as_py())
                    places.append(k)
                    words.append(b" ".join(split[at : at + block]).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(words, pa.string())], names=["source", "block", "held"]
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of a piece agree with its source, from the piece's inner end on."""
    for batch in batches:
        matched, whole = [], []
        for words, held, off, side in zip(*(batch.column(c).to_pylist() for c in ("words", "held", "off", "side")), strict=True):
            mine = words.encode().split()
            other = held.encode().split()[off : off + len(mine)]
            n = len(mine)
            if mine != other:
                pairs = zip(reversed(mine), reversed(other), strict=False) if side == LEFT else zip(mine, other, strict=False)
                n = next((k for k, (a, b) in enumerate(pairs) if a != b), len(other))
            matched.append(n)
            whole.append(n == len(mine))
        columns = [*(batch.column(c) for c in ("row", "run", "side", "number")), pa.array(matched, pa.int32()), pa.array(whole, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "run", "side", "number", "matched", "whole"])


def _finish(window: int):
    """The parse of documents whose runs have been compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.small_batches(batches, "text"):
            out = []
            for entry in batch.to_pylist():
                runs = [Run(*values) for values in zip(entry["starts"], entry["lasts"], entry["sources"], entry["places"], strict=True)]
                compared = [tuple(c.values()) for c in entry["compared"] or []]
                factors = greedy_factors(extents(runs, compared, window), window)
                out.append(_result(entry["row"], entry["text"].encode().split(), factors))
            yield pa.RecordBatch.from_pylist(out, pa.schema(_RESULT))

    return run


def _parse(texts: DataFrame, hits: DataFrame, window: int, block: int) -> DataFrame:
    """The greedy parse of every text with hits."""
    first = texts.select("row", "text").join(hits, "row").mapInArrow(_runs(window, block), _PARSE_TYPE)
    first = staged(first, "passage-runs")
    names = [name for name, _ in _RESULT]
    closed = first.where("n_removed is not null").select(*names)
    pieces = first.where("side is not null").select("row", *_PIECE)
    sources = staged(pieces.select("source").distinct(), "passage-sources")
    held = rows_in(texts.select("doc_id", "text"), "doc_id", sources).mapInArrow(_blocks(block), "source long, block int, held string")
    # Written first, so that a source of very many documents is a join key that can be split.
    held = staged(held, "passage-blocks")
    compared = pieces.join(held, ["source", "block"]).select("row", "run", "side", "number", "off", "words", "held")
    compared = compared.mapInArrow(_compare, "row long, run int, side int, number int, matched int, whole boolean")
    compared = compared.groupBy("row").agg(F.collect_list(F.struct("run", "side", "number", "matched", "whole")).alias("compared"))
    still = first.where("text is not null").select("row", "text", "starts", "lasts", "sources", "places")
    return closed.union(still.join(compared, "row", "left").mapInArrow(_finish(window), _RESULT_TYPE))


def _parsed(df: DataFrame, id_col: str, text_col: str, window: int, gram: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, word-for-word copies, parsed documents)."""
    text = text_of(df, text_col)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    profiles = rows.mapInArrow(
        _profiles(window, gram), "doc_id long, digest long, n_words long, words_sha256 string, anchors array<long>"
    )
    profiles = staged(profiles.withColumn("row", F.monotonically_increasing_id()), "passage-profiles")
    whole = profiles.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # Of documents equal word for word, the smallest id stands for all.
    groups = whole.groupBy("words_sha256").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    copied = staged(groups.where("first_id < last_id").drop("last_id"), "passage-copies")
    originals = whole.join(copied, "words_sha256", "left").where("first_id is null or first_id = doc_id")
    anchors = originals.select("doc_id", "row", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    # Written first, so that an anchor of very many documents is a join key that can be split.
    shared = staged(shared.select("anchor"), "passage-shared")
    lists = anchors.select("row", "anchor").join(shared, "anchor")
    lists = lists.groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    lists = staged(lists.join(profiles.select("row", "doc_id", "digest"), "row"), "passage-anchors")
    # One exchange of texts, of few documents but those that share an anchor.
    lists = lists.dropDuplicates(["doc_id", "digest"])
    held = with_suspicion(rows, F.col("doc_id"), filter_words(lists.select("doc_id"))).where("suspect").drop("suspect")
    texts = staged(held.join(lists, ["doc_id", "digest"]), "passage-texts")
    windows = texts.mapInArrow(_windows(window, gram), "doc_id long, row long, at int, content long, first boolean")
    index = windows.where("first").groupBy("content").agg(
        F.min("doc_id").alias("found"), F.max("doc_id").alias("end"), F.min_by("at", "doc_id").alias("found_at")
    )
    # Written first, so that a passage of very many documents is a join key that can be split.
    index = staged(index.where("found < end").drop("end"), "passage-index")
    hits = windows.drop("first").join(index, "content").where("found < doc_id")
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("at", "found", "found_at")).alias("hits"))
    parsed = _parse(texts, hits, window, block)
    # Rows that repeat an id and a text share the first one's parse.
    named = lists.select("row", "doc_id", "digest").join(parsed.dropDuplicates(["row"]), "row").drop("row")
    return profiles, copied, named


def duplicate_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK
) -> DataFrame:
    """The duplicate spans: doc_id, start, length (words), source_id (a smaller document that holds them)."""
    profiles, copied, parsed = _parsed(df, id_col, text_col, window, gram, block)
    spans = parsed.select("doc_id", F.explode(F.arrays_zip("starts", "lengths", "sources")).alias("f"))
    spans = spans.select("doc_id", F.col("f.starts").alias("start"), F.col("f.lengths").alias("length"), F.col("f.sources").alias("source_id"))
    copies = profiles.join(copied, "words_sha256").where("first_id < doc_id")
    copies = copies.select("doc_id", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length"), F.col("first_id").alias("source_id"))
    return spans.union(copies)


def remove_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, kept_sha256, kept.

    ``kept`` is the words that stay, joined by one space, where some were
    removed, and null where the document stays as it is.
    """
    profiles, copied, parsed = _parsed(df, id_col, text_col, window, gram, block)
    changed = parsed.select("doc_id", "digest", "n_removed", "kept", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    rows = profiles.drop("anchors", "row").join(copied, "words_sha256", "left").join(changed, ["doc_id", "digest"], "left")
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
