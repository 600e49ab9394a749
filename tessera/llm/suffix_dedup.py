"""Exact substring deduplication on bytes, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

``repeated_spans`` finds every window of ``length`` bytes whose string also starts earlier (smaller id, or same
document and earlier start); ``remove_repeats`` takes the bytes that such windows cover out of the texts.

Windows are dealt to shards by minimizer (``shards.py``), so equal windows meet; runs of windows that are equal as a
whole are collapsed to their first occurrence, the others being repeats by definition. The rest of a shard is laid
out in one text, in (id, start) order. Its suffixes are sorted on their first 128 bytes, which gives the transform
and the LF mapping. Intervals of equal prefixes are then expanded breadth first, one byte to the left a level: an
interval's rows, mapped by LF, fall into one interval for each byte that precedes them; where the row below such
an interval has no value yet, the level is its common prefix with the row above, and the interval is expanded
further. Values come out by increasing size and the search stops at ``length``: rows without a value share
``length`` bytes with the row above. In each stretch of such rows the least position is the first occurrence.

Defined results: null text counts as empty; rows whose id is null are compared with nothing and kept whole; rows
that repeat both id and text are one document given twice and both get that document's result; rows that share an id
with different texts are documents of their own, the one of the lesser SHA-256 being the earlier; so ties don't occur.
Texts shorter than the window are kept; an empty table gives an empty result; other columns are ignored. Long texts are taken in slices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as S
from .kernels import Rolling, byte_values, expand, minimizer_runs, pieces, squeezed, text_bytes, tidy, tidy_group, unsqueezed

GRAM = 10
#: Bytes that one transform is built over, about; a larger group of one minimizer is taken whole.
TRANSFORM = 1_000_000


def content_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray):
    v = byte_values(data)
    return Rolling(v, 0).spans(at, at + size), Rolling(v, 1).spans(at, at + size)


def map_runs(ids: np.ndarray, raw: np.ndarray, off: np.ndarray, length: int):
    """Runs of the windows of some rows, in steps."""
    for row, start, size in pieces(off, length - 1):
        bounds = np.concatenate([[0], np.cumsum(size)])
        data = raw[expand(off[row] + start, size)]
        at, count, key, again = minimizer_runs(byte_values(data), bounds, length, GRAM)
        if len(at):
            own = np.searchsorted(bounds, at, side="right") - 1
            total = count + length - 1
            h1, h2 = content_hashes(data, at, total)
            yield S.Runs(ids[row[own]], start[own] + at - bounds[own], count, key, again, h1, h2, np.ones(len(at), np.int64), at, total, data)


def deal(parts: list[S.Runs], shards: int):
    """Arrow batch of (shard, block): first copies with content, the others as decided spans."""
    r = S.joined(parts)
    first, other, _ = S.first_copies(r)
    s_first, s_other = S.shard_of(r.key[first], shards), S.shard_of(r.key[other], shards)
    o1, o2 = np.argsort(s_first, kind="stable"), np.argsort(s_other, kind="stable")
    number = np.unique(s_first)
    c1, c2 = np.searchsorted(s_first[o1], number), np.searchsorted(s_first[o1], number, side="right")
    d1, d2 = np.searchsorted(s_other[o2], number), np.searchsorted(s_other[o2], number, side="right")
    blocks = []
    for i in range(len(number)):
        done = other[o2[d1[i] : d2[i]]]
        blocks.append(S.pack(r, np.sort(first[o1[c1[i] : c2[i]]]), (r.doc[done], r.start[done], r.count[done])))
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])


def bounded_suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` by their first 128 bytes, by doubling from 8; 0 stands beyond the end."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key = wide[:n].copy()
    for i in range(1, 8):
        key <<= np.uint64(8)
        key |= wide[i : n + i]
    order = np.argsort(key)
    rank = np.empty(n + 128, np.int64)
    reach = 8
    while True:
        k = key[order]
        rank[n:] = 0
        rank[order] = np.cumsum(np.concatenate([[1], (k[1:] != k[:-1]).astype(np.int64)]))
        if reach >= 128:
            return order
        key = rank[:n] * (n + 1) + rank[reach : n + reach]
        order = np.argsort(key)
        reach *= 2


def common_prefix_reaches(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of each row but the first: whether it shares ``length`` bytes or more with the row above, by breadth-first
    backward extension of intervals; one more element stands for the end."""
    n = len(text)
    before = text[order - 1]
    by_symbol = np.argsort(before, kind="stable")  # LF^-1
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    symbol_of = before[by_symbol]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0]), np.array([n])
    owner = np.full(n, -1, np.int64)
    for _ in range(length):
        rows_held = int((hi - lo).sum())
        if not rows_held:
            break
        if rows_held > n // 6:
            owner[:] = -1
            rows = expand(lo, hi - lo)
            owner[rows] = np.repeat(np.arange(len(lo)), hi - lo)
            own = owner[by_symbol]
            cut = np.flatnonzero((own[1:] != own[:-1]) | (symbol_of[1:] != symbol_of[:-1])) + 1
            left, right = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
            live = own[left] >= 0
            left, right = left[live], right[live]
        else:
            rows = expand(lo, hi - lo)
            to, inverse = lf[rows], np.repeat(np.arange(len(lo)), hi - lo)
            seq = np.argsort(to)
            to, own = to[seq], inverse[seq]
            new = np.ones(len(to), bool)
            new[1:] = (own[1:] != own[:-1]) | (to[1:] != to[:-1] + 1) | (symbol_of[to[1:]] != symbol_of[to[:-1]])
            at = np.flatnonzero(new)
            left, right = to[at], to[np.append(at[1:], len(to)) - 1] + 1
        fresh = unset[right]
        lo, hi = left[fresh], right[fresh]
        unset[hi] = False
    return unset


def repeated_in(r: S.Runs, length: int):
    """Spans (doc, first window, windows) of runs r whose strings start earlier in r."""
    order = np.lexsort((r.start, r.doc))
    r = r.take(order)
    held = r.size + 1
    text = np.zeros(int(held.sum()) + 1, np.uint8)
    place = np.cumsum(held) - held + 1
    # 0 parts the runs; bytes 0 and 1 of a text are moved apart from it: the alphabet gets one place more
    content = r.contents().astype(np.uint16) + 1
    wide = np.zeros(len(text), np.uint16)
    wide[expand(place, r.size)] = content
    used = np.unique(wide)
    if len(used) > 256:
        return wide_repeats(r, wide, place, length)
    text = np.searchsorted(used, wide).astype(np.uint8)
    return spans_from(r, text, place, length)


def wide_repeats(r: S.Runs, wide: np.ndarray, place: np.ndarray, length: int):
    """All 256 byte values and the separator occur: each value is written as two symbols, windows twice as long."""
    pair = np.empty(2 * len(wide), np.uint8)
    pair[0::2], pair[1::2] = np.where(wide > 255, 2, np.where(wide == 0, 0, 1)), np.where(wide > 255, 1, wide)
    order = full_order(pair, 2 * length)
    same = common_prefix_reaches(pair, order, 2 * length)
    return decide(r, order, same, place, length, 2)


def full_order(text: np.ndarray, reach: int) -> np.ndarray:
    """As bounded_suffix_order, to at least ``reach`` symbols."""
    n = len(text)
    rank, k = text.astype(np.int64) + 1, 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:]
        key = rank * (int(rank.max()) + 1) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)]))
        k *= 2
        if k >= reach + 1:
            return order


def spans_from(r: S.Runs, text: np.ndarray, place: np.ndarray, length: int):
    order = bounded_suffix_order(text) if length < 128 else full_order(text, length)
    return decide(r, order, common_prefix_reaches(text, order, length), place, length, 1)


def decide(r: S.Runs, order: np.ndarray, same: np.ndarray, place: np.ndarray, length: int, wide: int):
    n = len(order)
    starts = np.flatnonzero(~same[:n])
    least = np.minimum.reduceat(order, starts)
    first = np.repeat(least, np.diff(np.append(starts, n)))
    again = np.zeros(n, bool)
    again[order] = first != order
    windows = expand(place, r.count)
    own = np.repeat(np.arange(len(r)), r.count)
    return S.spans_of(windows - place[own], again[windows * wide], r.doc, r.start, own)


def candidates(r: S.Runs, length: int) -> S.Runs:
    """Runs cut down to windows that may be repeated: those whose leading length - 16 bytes, hashed, occur twice here.
    What isn't kept has a prefix of its own, so no string of ``length`` bytes is lost."""
    lead = max(1, length - 16)
    roll = Rolling(byte_values(r.data))
    at = expand(r.at, r.count)
    h = roll.spans(at, at + lead)
    order = np.argsort(h)
    s = h[order]
    twice = np.zeros(len(h), bool)
    eq = s[1:] == s[:-1]
    twice[order[1:][eq]] = True
    twice[order[:-1][eq]] = True
    own = np.repeat(np.arange(len(r)), r.count)
    inside = at - r.at[own]
    keep = np.flatnonzero(twice)
    if not len(keep):
        return r.take(keep)
    new = np.ones(len(keep), bool)
    new[1:] = (own[keep[1:]] != own[keep[:-1]]) | (inside[keep[1:]] != inside[keep[:-1]] + 1)
    s = np.flatnonzero(new)
    count = np.diff(np.append(s, len(keep)))
    o, i = own[keep[s]], inside[keep[s]]
    t = r.take(o)
    t.start, t.at, t.count, t.size = t.start + i, t.at + i, count, count + length - 1
    return t


def solve_shard(blocks: list[bytes], length: int):
    """Spans of one shard."""
    out = []
    parts = []
    for b in blocks:
        r, done = S.unpack(b, content_hashes)
        if len(r):
            parts.append(r)
        if len(done[0]):
            out.append(done)
    if parts:
        r = S.joined(parts)
        del parts
        r = r.take(np.flatnonzero(S.repeated_keys(r)))
        first, other, _ = S.first_copies(r)
        out.append((r.doc[other], r.start[other], r.count[other]))
        r = r.take(first)
        r = r.take(np.flatnonzero(S.repeated_keys(r)))
        for part in S.batches_of(r, 3 * TRANSFORM):
            c = candidates(compact(r.take(part)), length)
            for group in S.batches_of(c, TRANSFORM):
                out.append(repeated_in(c.take(group), length))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def compact(r: S.Runs) -> S.Runs:
    data = r.contents()
    r.at, r.data = np.cumsum(r.size) - r.size, data
    return r


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, tie (see shards.told_apart), start, windows: windows start .. start + windows - 1 of the document are repeats."""
    return spans_of_texts(S.told_apart(plain(docs, id_col, text_col), "_id", "_text"), length, shards)


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))


def spans_of_texts(docs: DataFrame, length: int, shards: int | None = None) -> DataFrame:
    """As repeated_spans, of _id, _text, _tie."""
    n = shards or S.shards_for(docs, "_text")

    def to_shards(batches):
        parts, held = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ties = b.column(2).to_numpy(zero_copy_only=False)
            raw, off = text_bytes(b.column(1))
            for r in map_runs(np.arange(len(ids)), raw, off, length):
                parts.append(S.owned(r, ids, ties))
                held += len(r.data)
                if held >= S.GATHER:
                    yield deal(parts, n)
                    parts, held = [], 0
        if parts:
            yield deal(parts, n)

    def solve(table: pa.Table) -> pa.Table:
        return S.spans_batch(*solve_shard(table.column("block").to_pylist(), length))

    known = docs.filter("_id is not null").select(F.col("_id").cast("long"), "_text", "_tie")
    dealt = known.mapInArrow(tidy(to_shards), "shard int, block binary")
    return dealt.repartitionById(n, "shard").groupBy("shard").applyInArrow(tidy_group(solve), S.SPANS)


def covered(starts: np.ndarray, windows: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered stretches [from, to) of a text of ``size`` units."""
    order = np.argsort(starts)
    lo = starts[order]
    hi = np.minimum(np.maximum.accumulate(lo + windows[order] + length - 1), size)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]: one row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    told = S.told_apart(plain(docs, id_col, text_col), "_id", "_text")
    both = S.with_spans(squeezed(told, "_id", "_text", "_tie"), spans_of_texts(told, length), "_id")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes

    def work(batches):
        for b in batches:
            out = {k: [] for k in names[1:]}
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                raw = unsqueezed(text.as_py()).encode()
                kept, gone, n = raw, 0, 0
                if spans.is_valid:
                    v = spans.values
                    lo, hi = covered(v.field(0).to_numpy(), v.field(1).to_numpy(), length, len(raw))
                    n, gone = len(lo), int((hi - lo).sum())
                    at = 0
                    left = []
                    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                        left.append(raw[at:x])
                        at = y
                    kept = b"".join([*left, raw[at:]])
                for k, x in zip(names[1:], (len(raw), gone, n, hashlib.sha256(kept).hexdigest(), kept)):
                    out[k].append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out.values(), kinds))], names)

    return both.select("_id", "_text", "_spans").mapInArrow(tidy(work), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
