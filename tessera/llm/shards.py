"""Dealing the windows of all documents to shards so that equal windows meet.

A window (``window`` consecutive tokens of one document) belongs to the shard of its minimizer. Consecutive windows
with one minimizer travel as one run, so a text is sent about three times, compressed, whatever the window. Runs
that are equal within a map step travel once; the other copies send only their place. Each shard is a task-sized
share of the whole: their number follows the bytes of the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .kernels import expand, first_of, mix64

#: Bytes of text whose runs are gathered before they are compressed and dealt.
GATHER = 6 << 20
#: Bytes of text for each shard, about.
SHARE = 16 << 20


def shards_for(docs: DataFrame, text_col: str, share: int = SHARE) -> int:
    """A number of shards in proportion to the bytes of the texts, the session's shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // share))


#: Bits of a start that count places in a text (a string has fewer than 2^31 bytes); those above hold the text's tie.
PLACE = 31
#: The owner of content that travels without a place.
NOWHERE = np.iinfo(np.int64).min
#: Bits of a digest, and of a number, that make a tie.
DIGEST, NUMBER = 12, 20


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with ``_tie``, so that (id, tie) names one text: 0 where an id stands for one text, however often it is given. The
    texts of an id that stands for several are numbered by the order of their digests, in groups by the digest's head, so
    that one such id is no single task; a group holds 2^20 texts. Rows without an id get numbers in turn: nothing matches
    them, and a join by (id, tie) deals them to all tasks. What is shuffled to find such ids is an id and two hashes a row."""
    id_, text = F.col(id_col), F.coalesce(text_col, F.lit(""))
    turn = F.when(id_.isNull(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << NUMBER) - 1)))
    seen = docs.filter(id_.isNotNull()).select(id_.alias("_i"), F.xxhash64(text).alias("h")).groupBy("_i").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    shared = seen.filter("lo <> hi").select("_i")
    if shared.isEmpty():
        return docs.withColumn("_tie", F.coalesce(turn, F.lit(0)).cast("long"))
    digest = F.sha2(text, 256)
    texts = docs.select(id_.alias("_i"), digest.alias("_d")).join(shared, "_i", "left_semi").distinct()
    head = F.conv(F.substring("_d", 1, DIGEST // 4), 16, 10).cast("long")
    nth = F.row_number().over(Window.partitionBy("_i", "_head").orderBy("_d")) - 1
    ties = texts.withColumn("_head", head).select("_i", "_d", (F.col("_head") * (1 << NUMBER) + nth).alias("_n"))
    both = docs.join(ties, (id_ == F.col("_i")) & (digest == F.col("_d")), "left")
    return both.withColumn("_tie", F.coalesce("_n", turn, F.lit(0)).cast("long")).drop("_i", "_d", "_n")


def owned(runs: Runs, ids: np.ndarray, ties: np.ndarray) -> Runs:
    """Runs whose owners are row numbers, with the rows' ids as owners and their ties in the starts."""
    runs.start = runs.start + (ties[runs.doc] << PLACE)
    runs.doc = ids[runs.doc]
    return runs


def spans_batch(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.Table:
    """SPANS of owners, starts with their ties, and windows."""
    cols = (doc, start >> PLACE, start & ((1 << PLACE) - 1), count)
    return pa.table([pa.array(c, pa.int64()) for c in cols], ["doc_id", "tie", "start", "windows"])


SPANS = "doc_id long, tie long, start long, windows long"


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """docs (see told_apart) with ``_spans``: the sorted (start, windows) of a row's text, null where there is none."""
    by_text = spans.groupBy(F.col("doc_id").alias("_own"), F.col("tie").alias("_t")).agg(F.sort_array(F.collect_list(F.struct("start", "windows"))).alias("_spans"))
    return docs.join(by_text, (F.col(id_col).cast("long") == F.col("_own")) & (F.col("_tie") == F.col("_t")), "left").drop("_own", "_t")


@dataclass
class Runs:
    """Runs of windows: owner id, first window, number of windows, minimizer, whether the minimizer recurs in the run,
    two 64-bit hashes of the content, weight (how many times the content is known to occur), and content bytes."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    again: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    weight: np.ndarray
    at: np.ndarray  # content's place in ``data``
    size: np.ndarray
    data: np.ndarray

    FIELDS = ("doc", "start", "count", "key", "again", "h1", "h2", "weight", "size")

    def __len__(self):
        return len(self.doc)

    def take(self, index: np.ndarray) -> Runs:
        return Runs(*(getattr(self, f)[index] for f in ("doc", "start", "count", "key", "again", "h1", "h2", "weight", "at", "size")), self.data)

    def contents(self) -> np.ndarray:
        return self.data[expand(self.at, self.size)]


def joined(parts: list[Runs]) -> Runs:
    base = np.cumsum([0] + [len(p.data) for p in parts])
    cols = [np.concatenate([getattr(p, f) for p in parts]) for f in ("doc", "start", "count", "key", "again", "h1", "h2", "weight")]
    return Runs(*cols, np.concatenate([p.at + b for p, b in zip(parts, base)]), np.concatenate([p.size for p in parts]), np.concatenate([p.data for p in parts]))


#: Bytes of content that are compared at once.
COMPARED = 4 << 20


def unequal(r: Runs, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the runs a[i], b[i] differ in their bytes."""
    out = r.size[a] != r.size[b]
    left = np.flatnonzero(~out & (r.at[a] != r.at[b]))
    upto = np.cumsum(r.size[a[left]])
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + COMPARED, side="right")))
        x, y = a[left[i:j]], b[left[i:j]]
        differ = r.data[expand(r.at[x], r.size[x])] != r.data[expand(r.at[y], r.size[y])]
        out[left[i:j]] = np.add.reduceat(differ, np.cumsum(r.size[x]) - r.size[x]) > 0
        i = j
    return out


def equal_contents(r: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Order of the runs by content (and doc, start), and where in it another content begins. Hashes sort; the bytes
    themselves decide: runs that share both hashes without being equal are parted."""
    order, new = first_of(r.h1, r.h2, r.doc, r.start)
    if not len(order):
        return order, new
    head = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))
    wrong = unequal(r, order, head)
    if wrong.any():
        number: dict[bytes, int] = {}
        which = np.zeros(len(order), np.int64)
        for i in np.flatnonzero(np.isin(head, head[wrong])).tolist():
            j = order[i]
            which[j] = number.setdefault(r.data[r.at[j] : r.at[j] + r.size[j]].tobytes(), len(number))
        order = np.lexsort((r.start, r.doc, which, r.h2, r.h1))
        keys = [x[order] for x in (r.h1, r.h2, which)]
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return order, new


def first_copies(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups equal contents: indexes of the first copy by (doc, start) of each, of all other copies, and the total
    weight by first copy. Places that are given twice (repeated rows) count once."""
    order, new = equal_contents(r)
    same = np.zeros(len(order), bool)
    d, s = r.doc[order], r.start[order]
    same[1:] = ~new[1:] & (d[1:] == d[:-1]) & (s[1:] == s[:-1]) & (d[1:] != NOWHERE)
    weight = np.where(same, 0, r.weight[order])
    at = np.flatnonzero(new)
    total = np.add.reduceat(weight, at) if len(at) else weight[:0]
    return order[new], order[~new & ~same], total


def pack(r: Runs, places: np.ndarray, emitted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """Runs ``places`` of r, and spans that are decided already (doc, start, count), as one compressed block."""
    p = r.take(places)
    head = np.array([len(p), len(emitted[0])], np.int64).tobytes()
    cols = [p.doc.astype(np.int64), p.start.astype(np.int64), p.count.astype(np.int32), p.key, p.again.astype(np.uint8), p.weight.astype(np.int8), p.size.astype(np.int32)]
    done = [emitted[0].astype(np.int64), emitted[1].astype(np.int64), emitted[2].astype(np.int32)]
    return zstandard.ZstdCompressor(level=6).compress(b"".join([head, *(c.tobytes() for c in cols + done), p.contents().tobytes()]))


def unpack(block: bytes, hashes) -> tuple[Runs, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The inverse; ``hashes`` gives both content hashes again, which are not sent."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at, cols = 16, []
    for kind, k in ((np.int64, n), (np.int64, n), (np.int32, n), (np.uint64, n), (np.uint8, n), (np.int8, n), (np.int32, n), (np.int64, m), (np.int64, m), (np.int32, m)):
        cols.append(np.frombuffer(raw, kind, k, at))
        at += k * np.dtype(kind).itemsize
    doc, start, count, key, again, weight, size = cols[:7]
    data = np.frombuffer(raw, np.uint8, -1, at)
    size = size.astype(np.int64)
    place = np.cumsum(size) - size
    h1, h2 = hashes(data, place, size)
    return Runs(doc, start, count.astype(np.int64), key, again.astype(bool), h1, h2, weight.astype(np.int64), place, size, data), (cols[7], cols[8], cols[9].astype(np.int64))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((mix64(key) >> np.uint64(24)) % np.uint64(shards)).astype(np.int64)


def repeated_keys(r: Runs) -> np.ndarray:
    """Which runs may hold a repeated window: those whose minimizer another run has, or recurs in the run."""
    _, inverse, counts = np.unique(r.key, return_inverse=True, return_counts=True)
    return (counts[inverse] > 1) | r.again | (r.weight > 1)


def batches_of(r: Runs, limit: int):
    """Index arrays of whole minimizer groups, of about ``limit`` content bytes."""
    order = np.argsort(r.key, kind="stable")
    key = r.key[order]
    size = np.cumsum(r.size[order])
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    a = 0
    while a < len(order):
        held = size[a - 1] if a else 0
        b = int(np.searchsorted(size, held + limit, side="right"))
        later = new[np.searchsorted(new, max(b, a + 1)) :]
        b = int(later[0]) if len(later) else len(order)
        yield order[a:b]
        a = b


def spans_of(start_positions: np.ndarray, flags: np.ndarray, doc: np.ndarray, first: np.ndarray, owner: np.ndarray):
    """Maximal stretches of flagged windows: doc, first window, number. ``start_positions`` are the places of the flags
    in a common text, ``owner`` the run of each and ``first`` the run's first window."""
    at = np.flatnonzero(flags)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    own = owner[at]
    window = first[own] + start_positions[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)
    s = np.flatnonzero(new)
    return doc[own[s]], window[s], np.diff(np.append(s, len(at)))
