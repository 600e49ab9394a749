"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made.

``count_tokens`` gives, for each document, what a byte-level BPE tokenizer would emit without special tokens of
its own: the text is cut at the literal added tokens (each counts one), then by the tokenizer's pattern, and in
each piece the adjacent pair of lowest rank is merged until none is left; the count is the number of initial
symbols less the merges.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows are independent, so ties, repeated rows and
null ids pass through; texts of any length are counted whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernels import tidy
from .pretokens import byte_symbols, cut

#: Bytes, about, of the pieces that a task remembers; further ones are counted anew each time.
REMEMBERED = 48 << 20


class Merges:
    """Ranks of symbol pairs, symbols numbered 0-255 for bytes and on for merged ones."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number = {s: b for b, s in enumerate(byte_symbols())}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = number.setdefault(left + right, len(number))
            self.rank[number[left], number[right]] = (rank, made)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def count(self, piece: str) -> int:
        """Symbols left of one piece: its bytes less the merges made."""
        symbol = list(piece.encode())
        n = len(symbol)
        if n < 2:
            return n
        rank, merges = self.rank, 0
        before, after, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []
        for i in range(n - 1):
            if (r := rank.get((symbol[i], symbol[i + 1]))) is not None:
                heap.append((r[0], i, symbol[i], symbol[i + 1], r[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            merges += 1
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((made, symbol[k]))) is not None:
                    heapq.heappush(heap, (r[0], i, made, symbol[k], r[1]))
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], made))) is not None:
                heapq.heappush(heap, (r[0], h, symbol[h], made, r[1]))
        return n - merges


class Memory(dict):
    """piece -> count, worked out on first sight."""

    def __init__(self, merges: Merges):
        self.merges, self.left = merges, REMEMBERED

    def __missing__(self, piece: str) -> int:
        n = self.merges.count(piece)
        if len(piece) < 64 and self.left > 0:
            self[piece] = n
            self.left -= len(piece) + 140  # a string has some 140 bytes beside its characters in a dict
        return n


@lru_cache(2)
def counter(path: str):
    """A function from a text to its number of tokens, one per worker process, and one that forgets the pieces."""
    merges = Merges(path)
    memory = Memory(merges)

    def tokens(text: str) -> int:
        if merges.added is None or not merges.added.search(text):
            return sum(map(memory.__getitem__, cut(text)))
        parts = merges.added.split(text)
        return len(parts) - 1 + sum(sum(map(memory.__getitem__, cut(p))) for p in parts)

    def forget() -> None:
        memory.clear()
        memory.left = REMEMBERED

    return tokens, forget


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        tokens, _ = counter(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.array([tokens(t) for t in texts], np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(tidy(work, lambda: counter(tokenizer)[1]()), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
