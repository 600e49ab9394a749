"""Packing of documents into fixed-length sequences.

``pack`` tokenizes each text, appends the end id, cuts the ids into pieces of at most ``capacity`` and packs the
pieces by first-fit decreasing, independently in randomised groups of documents (a seeded hash of id and text deals
documents to groups, so a group is bounded however large the table is and whatever ids repeat). The first bin that still holds a piece
is found in O(log bins) in a tournament tree of the bins' free room: each inner node keeps the larger room of
its two children, and the search goes left wherever the left winner is large enough.

A piece carries the span, the ids' CRC and its place; only these few numbers are shuffled, never the ids. With
``keep_ids`` the ids come along as a column.

Defined results: null text counts as empty (one piece, just the end id); rows with null or equal ids are packed each on its
own, copies of a row in groups of their own; ties in length go by id, start and CRC; an empty table gives an empty
result; other columns are ignored. Long texts are cut into as many pieces as they need.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import tidy
from .pretokens import byte_symbols, cut

#: Bytes, about, of the pieces that a task remembers; further ones are encoded anew each time.
REMEMBERED = 48 << 20
#: Documents in a group, about; with some thousand pieces the last, part-filled bins of a group don't matter.
GROUP_DOCS = 4096


class Rooms:
    """A tournament tree over bins: the winner of each match is the bin with more free room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Takes the first bin with room for ``size`` and returns its number."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            won = max(room[2 * at], room[2 * at + 1])
            if room[at] == won:
                break
            room[at] = won
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, in the order given; larger ones are placed first, ties in that order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return bins, offsets
    tree = Rooms(len(sizes), capacity)
    fill = [0] * len(sizes)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        b = tree.put(n)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
    return bins, offsets


@lru_cache(2)
def encoder(path: str):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's own. Its pattern cuts a text
    into pieces that are encoded one by one, so pieces seen before need no second encoding; texts with added
    tokens go to the tokenizer whole. A second function forgets the pieces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    known: dict[str, bytes] = {}
    left = REMEMBERED
    model, symbol = t.model, dict(enumerate(byte_symbols()))

    def piece_ids(piece: str) -> bytes:
        got = model.tokenize(piece.encode().decode("latin-1").translate(symbol))
        return struct.pack(f"<{len(got)}I", *[x.id for x in got])

    def ids(text: str) -> bytes:
        nonlocal left
        if any(a in text for a in added):
            return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = cut(text)
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            new = [p for p in set(parts) if p not in known]
            got = {p: piece_ids(p) for p in new}
            if left > 0:
                short = {p: x for p, x in got.items() if len(p) < 64}
                known.update(short)
                # a string and a bytes object have some 180 bytes beside their contents in a dict
                left -= sum(map(len, short)) + sum(map(len, short.values())) + 180 * len(short)
            return b"".join([x if (x := known.get(p)) is not None else got[p] for p in parts])

    def forget() -> None:
        nonlocal left
        known.clear()
        left = REMEMBERED

    return ids, forget


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"] + ["ids"] * keep_ids

    def work(batches):
        from pyspark import TaskContext

        encode, task = encoder(tokenizer)[0], TaskContext.get().partitionId()
        copies: dict[tuple, int] = {}
        for b in batches:
            rows, start, length, crc, total, salts, ids = [], [], [], [], [], [], []
            for row, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                flat = encode(text.as_py() or "") + end
                own = (key, zlib.crc32(flat))
                # a row that comes again gets a salt that only this task gives
                again = copies[own] = copies.get(own, -1) + 1
                salt = own[1] if not again else zlib.crc32(struct.pack("<3Q", own[1], task, again))
                for at in range(0, len(flat), 4 * capacity):
                    part = flat[at : at + 4 * capacity]
                    rows.append(row)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(flat) // 4)
                    salts.append(salt)
                    if keep_ids:
                        ids.append(part)
            cols = [b.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total, salts)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * keep_ids, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(tidy(work, lambda: encoder(tokenizer)[1]()), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, seed: int = 17, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]."""
    groups = max(1, math.ceil(docs.count() / group_docs))
    cut = cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids)
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "salt"), F.lit(groups))).drop("salt")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        group = int(pdf["pack_group"].iloc[0])
        # ids of sequences stay distinct over groups: group number in the high bits
        return pdf.drop(columns="pack_group").assign(sequence_id=(group << 32) + bins, offset=offsets)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.drop("salt").schema) + ", sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(work, schema)
