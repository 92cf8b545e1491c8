"""Word hashes of whole Arrow batches, with numpy.

Words are runs of bytes other than ASCII white space.  A word's hash is a
polynomial over a table of random numbers for its bytes, modulo 2**64; hashes
of word sequences are polynomials over those.  Both come from running sums, so
a batch needs a few passes over its bytes and none over Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_STEP = 1 << 16  # bytes or words whose powers are kept


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _STEP + 1), _powers(_INVERSE, _STEP + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _spans_sum(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomials over values[start:stop]; the spans are sorted, and none but single long ones exceed _STEP."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        upto = max(int(np.searchsorted(stops, base + _STEP, "right")), done + 1)
        last = int(stops[upto - 1])
        if last - base > _STEP:  # one span longer than the kept powers
            total = np.uint64(0)
            for at in range(int(base), last, _STEP):
                part = values[at : min(at + _STEP, last)]
                total = total * _UP[-1] + (part * _UP[: len(part)]).sum(dtype=np.uint64)
            out[done] = total
        else:
            sums = np.zeros(last - base + 1, np.uint64)
            np.cumsum(values[base:last] * _UP[: last - base], out=sums[1:])
            a, b = starts[done:upto] - base, stops[done:upto] - base
            out[done:upto] = (sums[b] - sums[a]) * _DOWN[a]
        done = upto
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of values[start:stop]; the spans are sorted and do not overlap."""
    return mix(_spans_sum(values, starts, stops) + (stops - starts).astype(np.uint64))


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words; entry i starts at word i."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    starts = np.arange(n)
    return mix(_spans_sum(words, starts, starts + length))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text) of texts data[bounds[i]:bounds[i + 1]]."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    solid = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(_BYTES[data], starts, stops), np.searchsorted(starts, bounds)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) // most) if len(sizes) else sizes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column, null as empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]
