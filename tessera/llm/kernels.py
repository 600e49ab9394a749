"""Vectorised kernels that several text operators share: rolling hashes, minimizer runs, Arrow access."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None) if sys.platform == "linux" else None
if hasattr(_libc, "mallopt"):
    # M_MMAP_THRESHOLD and M_TRIM_THRESHOLD: large freed arrays go back to the system, so that workers stay small
    _libc.mallopt(-3, 4 << 20)
    _libc.mallopt(-1, 64 << 20)



def release() -> None:
    """Gives memory that a task is done with back to the system: workers are used again, by tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(work: Callable, *after: Callable[[], None]) -> Callable:
    """``work`` over a task's batches, and ``release`` (and ``after``) at its end."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            for f in after:
                f()
            release()

    return run


def tidy_group(solve: Callable) -> Callable:
    """As ``tidy``, for a function of one group."""

    def run(table):
        try:
            return solve(table)
        finally:
            release()

    return run


#: Bytes of text that one vectorised step works on; longer texts are taken in slices.
STEP = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (murmur's constants): spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16) * 5 // 4
        base = _ODD[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[which] = (out[0], out[1])
    return have[0], have[1]


class Rolling:
    """Polynomial hashes of any span of ``values`` (64-bit words) in O(1) after one pass."""

    def __init__(self, values: np.ndarray, which: int = 0):
        p, self.inv = powers(len(values) + 1, which)
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * p[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inv[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all spans of k values."""
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.empty(0, np.uint64)


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit word for each byte."""
    return _BYTES[data]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + length[i] - 1, for all i in turn."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)


def minimizer_runs(values: np.ndarray, bounds: np.ndarray, window: int, k: int):
    """Cuts the windows of each document into runs that share a minimizer.

    bounds: document starts in ``values`` and the end. Equal windows have equal minimizers (the least hash of
    the k-grams within), so they meet under one key wherever they stand. Returns start, number of windows,
    key, and whether the minimizer occurs more than once in the run (only then can a window recur within it).
    """
    empty = np.empty(0, np.int64)
    n = len(values)
    if n < window:
        return empty, empty, np.empty(0, np.uint64), np.empty(0, bool)
    roll = Rolling(values)
    grams = roll.grams(k)
    least = sliding_min(grams, window - k + 1)
    lo, hi = bounds[:-1], bounds[1:]
    full = hi - lo >= window
    edge = np.zeros(n + 2, np.int8)
    np.add.at(edge, lo[full], 1)
    np.add.at(edge, hi[full] - window + 1, -1)
    valid = np.cumsum(edge[: len(least)], dtype=np.int8) > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    new[lo[full]] = True
    start = np.flatnonzero(valid & new)
    if not len(start):
        return empty, empty, np.empty(0, np.uint64), np.empty(0, bool)
    stop = np.flatnonzero(~valid)
    after = np.append(start[1:], len(least))
    if len(stop):
        at = np.searchsorted(stop, start)
        after = np.minimum(after, np.where(at < len(stop), stop[np.minimum(at, len(stop) - 1)], len(least)))
    count = after - start
    key = least[start]
    span = count + (window - k)
    own = np.cumsum(span) - span
    again = np.add.reduceat(grams[expand(start, span)] == np.repeat(key, span), own) > 1
    return start, count, key, again


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = flat.buffers()
    off = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off


def pieces(off: np.ndarray, overlap: int, step: int = STEP):
    """Groups rows into steps of about ``step`` bytes; longer rows are sliced, slices overlapping so that each
    window of overlap + 1 bytes lies in exactly one slice. Yields row, start in the row, and length arrays."""
    size = np.diff(off)
    rows, starts, lens, held = [], [], [], 0
    for row in range(len(size)):
        n = int(size[row])
        at = 0
        while True:
            take = min(n - at, step + overlap)
            rows.append(row)
            starts.append(at)
            lens.append(take)
            held += take
            if held >= step:
                yield np.array(rows), np.array(starts), np.array(lens)
                rows, starts, lens, held = [], [], [], 0
            if at + take >= n:
                break
            at += step
    if rows:
        yield np.array(rows), np.array(starts), np.array(lens)


def first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by the keys (the first is the main one) and returns the order and, along it, where the first two change."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    a, b = keys[0][order], keys[1][order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def squeezed(docs: DataFrame, id_col: str, text_col: str, *numbers: str) -> DataFrame:
    """_id, _text and the columns ``numbers``: texts (also null) as zstd blocks, two fifths of their size, for the shuffle of a
    join."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = pa.array([None if t is None else c.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), packed, *b.columns[2:]], ["_id", "_text", *numbers])

    return docs.select(F.col(id_col), F.col(text_col), *numbers).mapInArrow(tidy(work), f"_id {kind}, _text binary" + "".join(f", {c} long" for c in numbers))


def unsqueezed(block: bytes | None) -> str:
    return "" if block is None else zstandard.decompress(block).decode()
