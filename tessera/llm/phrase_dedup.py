"""Substring deduplication on words with repeated-phrase automata.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r. ``repeated_spans`` finds every window of
``length`` consecutive words whose sequence starts anywhere else as well; ``remove_repeats`` drops every word that such
a window covers, all occurrences alike.

Windows are dealt to shards by minimizer (``shards.py``), so all occurrences of a passage meet. Runs of windows that
are equal as a whole, byte for byte, are recurring passages already. In the rest, candidates are windows whose hash
recurs; each goes, as its word sequence, into Aho-Corasick automata of bounded size, and every run of the shard is
streamed through them: a phrase found twice or more marks all its occurrences. The words themselves decide, not hashes.

Defined results: null text has no words; rows whose id is null are compared with nothing and kept whole; rows that
repeat both id and text are one document given twice; rows that share an id with different texts are documents of their
own, with results of their own; texts of fewer words than the window are kept; an empty table gives an empty result;
other columns are ignored. Long texts are hashed in slices.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as S
from .kernels import STEP, Rolling, byte_values, expand, minimizer_runs, mix64, squeezed, text_bytes, tidy, tidy_group, unsqueezed
from .suffix_dedup import covered

GRAM = 5
#: Phrases in one automaton, about; windows of one minimizer go to one automaton.
PHRASES = 12_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def normal_words(raw: np.ndarray, off: np.ndarray):
    """Words of rows: their bytes, one space between words; the words' starts and ends there; the rows' word counts."""
    space = _SPACE[raw]
    row_start = np.zeros(len(raw) + 1, bool)
    row_start[off[:-1]] = True
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1] | row_start[1 : len(raw)]
    start = np.flatnonzero(begins)
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:] = word
    ends[:-1] &= space | row_start[:-1]
    end = np.flatnonzero(ends)
    size = end - start
    to = np.cumsum(size + 1) - (size + 1)
    data = np.full(int((size + 1).sum()), 32, np.uint8)
    data[expand(to, size)] = raw[expand(start, size)]
    count = np.searchsorted(start, off[1:]) - np.searchsorted(start, off[:-1])
    return data, to, to + size, count


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in slices of bounded size: the mixed sum of its mixed (place, byte) pairs."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STEP)))
        size = end[i:j] - start[i:j]
        own = np.cumsum(size) - size
        at = expand(start[i:j], size)
        place = (at - np.repeat(start[i:j], size)).astype(np.uint64)
        out[i:j] = mix64(np.add.reduceat(mix64((place << np.uint64(8)) + data[at] + np.uint64(1)), own))
        i = j
    return out


def content_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray):
    v = byte_values(data)
    return Rolling(v, 0).spans(at, at + size), Rolling(v, 1).spans(at, at + size)


def groups_of(off: np.ndarray, step: int = STEP):
    """Row ranges of about ``step`` bytes."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + step, side="right")) - 1)
        yield a, min(b, n)
        a = b


def map_runs(ids: np.ndarray, raw: np.ndarray, off: np.ndarray, length: int):
    for a, b in groups_of(off):
        data, start, end, count = normal_words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        if not len(start):
            continue
        value = word_hashes(data, start, end)
        bounds = np.concatenate([[0], np.cumsum(count)])
        at, windows, key, again = minimizer_runs(value, bounds, length, GRAM)
        if not len(at):
            continue
        own = np.searchsorted(bounds, at, side="right") - 1
        place, stop = start[at], end[at + windows + length - 2]
        h1, h2 = content_hashes(data, place, stop - place)
        yield S.Runs(ids[a + own], at - bounds[own], windows, key, again, h1, h2, np.ones(len(at), np.int64), place, stop - place, data)


def deal(parts: list[S.Runs], shards: int):
    """Arrow batch of (shard, block). Content that occurs more than once here recurs: all its places are decided, and
    the content travels once, without a place and with its weight, so that the shard can match others with it."""
    r = S.joined(parts)
    first, other, total = S.first_copies(r)
    many = total > 1
    done = np.concatenate([first[many], other])
    r.weight[first] = np.minimum(total, 2)
    done_at = (r.doc[done], r.start[done], r.count[done])
    doc = r.doc.copy()
    doc[first[many]] = S.NOWHERE
    s_first, s_done = S.shard_of(r.key[first], shards), S.shard_of(r.key[done], shards)
    r.doc = doc
    o1, o2 = np.argsort(s_first, kind="stable"), np.argsort(s_done, kind="stable")
    number = np.unique(s_first)
    c1, c2 = np.searchsorted(s_first[o1], number), np.searchsorted(s_first[o1], number, side="right")
    d1, d2 = np.searchsorted(s_done[o2], number), np.searchsorted(s_done[o2], number, side="right")
    blocks = []
    for i in range(len(number)):
        pick = o2[d1[i] : d2[i]]
        blocks.append(S.pack(r, np.sort(first[o1[c1[i] : c2[i]]]), tuple(x[pick] for x in done_at)))
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])


def repeated_in(r: S.Runs, length: int, out: list) -> None:
    """Adds spans of runs r (whole minimizer groups) with recurring windows."""
    data = r.contents()
    words_of = data.tobytes()
    size = r.size
    at = np.cumsum(size) - size
    number: dict[bytes, int] = {}
    seqs = [[number.setdefault(w, len(number)) for w in words_of[a : a + n].split(b" ")] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
    lens = np.array([len(s) for s in seqs], np.int64)
    flat = np.concatenate([np.array(s, np.uint64) for s in seqs])
    base = np.cumsum(lens) - lens
    windows = expand(base, r.count)
    own = np.repeat(np.arange(len(r)), r.count)
    h = Rolling(mix64(flat + np.uint64(1))).spans(windows, windows + length)
    uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    seen = np.bincount(inverse, weights=r.weight[own])
    recurring = np.flatnonzero(seen > 1)
    if not len(recurring):
        return
    hit = np.zeros(len(windows), bool)
    streams = np.unique(own[np.isin(inverse, recurring)]) if len(recurring) < len(uniq) else np.arange(len(r))
    window_base = np.cumsum(r.count) - r.count
    for lo in range(0, len(recurring), PHRASES):
        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        part = recurring[lo : lo + PHRASES]
        for j, f in enumerate(first[part].tolist()):
            o = own[f]
            s = f - window_base[o]
            auto.add_word(tuple(seqs[o][s : s + length]), j)
        auto.make_automaton()
        found_window, found_phrase = [], []
        for o in streams.tolist():
            wb = int(window_base[o]) - length + 1
            for end, j in auto.iter(tuple(seqs[o])):
                found_window.append(wb + end)
                found_phrase.append(j)
        w, p = np.array(found_window, np.int64), np.array(found_phrase, np.int64)
        times = np.bincount(p, weights=r.weight[own[w]], minlength=len(part))
        hit[w[times[p] > 1]] = True
    doc, start, count = S.spans_of(windows - base[own], hit, r.doc, r.start, own)
    real = doc != S.NOWHERE  # a passage that is known to recur has had its places decided
    out.append((doc[real], start[real], count[real]))


def solve_shard(blocks: list[bytes], length: int):
    out, parts = [], []
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
        first, other, total = S.first_copies(r)
        # equal runs recur: every place that isn't decided yet is decided now
        many = np.flatnonzero(total > 1)
        done = np.concatenate([first[many], other])
        done = done[r.doc[done] != S.NOWHERE]
        out.append((r.doc[done], r.start[done], r.count[done]))
        r.weight[first] = np.minimum(total, 2)
        r.doc = r.doc.copy()
        r.doc[first[many]] = S.NOWHERE
        r = r.take(first)
        _, inverse, counts = np.unique(r.key, return_inverse=True, return_counts=True)
        r = r.take(np.flatnonzero((counts[inverse] > 1) | r.again))
        for part in S.batches_of(r, 1_000_000):
            repeated_in(r.take(part), length, out)
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def repeated_spans(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, tie (see shards.told_apart), start, windows: the windows at words start .. start + windows - 1 recur."""
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
    return known.mapInArrow(tidy(to_shards), "shard int, block binary").repartitionById(n, "shard").groupBy("shard").applyInArrow(tidy_group(solve), S.SPANS)


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, kept]: one row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    told = S.told_apart(plain(docs, id_col, text_col), "_id", "_text")
    both = S.with_spans(squeezed(told, "_id", "_text", "_tie"), spans_of_texts(told, length), "_id")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_words

    def work(batches):
        for b in batches:
            out = {k: [] for k in names[1:]}
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                words = WORD.findall(unsqueezed(text.as_py()))
                kept, gone = words, 0
                if spans.is_valid:
                    v = spans.values
                    lo, hi = covered(v.field(0).to_numpy(), v.field(1).to_numpy(), length, len(words))
                    gone, at, kept = int((hi - lo).sum()), 0, []
                    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                        kept += words[at:x]
                        at = y
                    kept += words[at:]
                line = " ".join(kept)
                for k, x in zip(names[1:], (len(words), gone, hashlib.sha256(line.encode()).hexdigest(), line)):
                    out[k].append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out.values(), kinds))], names)

    return both.select("_id", "_text", "_spans").mapInArrow(tidy(work), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_words)


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans [from, to), sorted by start, and without the white space after them."""
    words = list(WORD.finditer(text))
    left, at = [], 0
    for lo, hi in spans:
        hi = min(hi, len(words))
        if hi <= lo:
            continue
        start, stop = words[lo].start(), words[hi].start() if hi < len(words) else len(text)
        if start > at:
            left.append(text[at:start])
        at = max(at, stop)
    left.append(text[at:])
    return "".join(left)
