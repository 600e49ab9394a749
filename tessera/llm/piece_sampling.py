"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

A text becomes the symbol string of the piece model (space -> the word mark). Its lattice has an edge for each
vocabulary piece that matches, and one for each single character (spelled in byte pieces where the vocabulary
lacks it). An edge weighs exp(alpha * score); forward filtering sums the weights of all paths to each node, and
backward sampling walks from the end, choosing each incoming edge in proportion to (sum at its start) x weight.
No piece has a word mark behind another character, so a node before a word's mark is on every path and the
lattice falls apart into words: each distinct word of a batch of rows is filtered once, all words position by
position together, and all occurrences are sampled together. Random numbers are a hash of (seed, row key, word index, step): the same row key and
text give the same segmentation on any machine, in any order.

Decoding concatenates pieces and bytes; a word mark that stands in the text itself is spelled in bytes, so
decode(encode(text)) == text for every text.

The model's normaliser is passed over: pieces are sampled from the text as it is, so that decoding gives it back.

Defined results: null text counts as empty (no pieces); a word of any length is one lattice, whose size grows with its
length; a null key seeds like the string 'null'; repeated rows
with equal key and text get equal segmentations; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import Rolling, mix64

MARK = "▁"
#: Rows whose words are filtered and sampled together.
ROWS = 1024
_WORD = re.compile(r" +[^ ]*|[^ ]+")


class Model:
    """Pieces of a model file as a sorted table of their hashes, with scores, behind a bitmap of the hashes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte, self.bytes_of, usable = np.zeros(256, np.int64), [], []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(p.replace(MARK, " ").encode())
                usable.append((p, i, sp.get_score(i)))
        self.longest = max(len(p) for p, _, _ in usable)
        # scores of a merge model are ranks; scaled so that the worst ordinary piece has -20, a forbidden one -40
        low = min([s for _, _, s in usable if -1e8 < s < 0], default=-1.0)
        code = np.frombuffer("".join(p for p, _, _ in usable).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(p) for p, _, _ in usable])
        hashes = Rolling(mix64(code.astype(np.uint64) + np.uint64(1))).spans(np.concatenate([[0], end[:-1]]), end)
        order = np.argsort(hashes)
        self.hash = hashes[order]
        self.id = np.array([i for _, i, _ in usable])[order]
        self.score = np.array([max(s, 2 * low) / -low * 20 for _, _, s in usable])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hash >> np.uint64(44)] = True
        self.fallback = -40.0  # for each byte piece


class Lattices:
    """The filtered lattices of some words as flat arrays. A node is a position in a word; the incoming edges of a
    node are contiguous, and ``upto`` rises by exactly one in each node, so that one search samples any node."""

    def __init__(self, m: Model, words: list[str], alpha: float):
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        code = np.where(code == ord(" "), np.uint64(ord(MARK)), np.where(code == ord(MARK), np.uint64(0), code))  # a mark in the text itself matches no piece
        size = np.array([len(w) for w in words], np.int64)
        last = np.repeat(np.cumsum(size), size)  # of each character: where its word ends
        shift = np.repeat(np.arange(len(words)), size)  # a word has one node more than characters
        self.first = np.cumsum(size) - size + np.arange(len(words))
        self.ends = self.first + size
        roll, at = Rolling(mix64(code + np.uint64(1))), np.arange(len(code))
        frm, to, piece, weight = [], [], [], []
        for n in range(1, m.longest + 1):
            at = at[at + n <= last[at]]
            if not len(at):
                break
            h = roll.spans(at, at + n)
            maybe = np.flatnonzero(m.seen[h >> np.uint64(44)])
            k = np.minimum(np.searchsorted(m.hash, h[maybe]), len(m.hash) - 1)
            is_piece = m.hash[k] == h[maybe]
            i, k = at[maybe[is_piece]], k[is_piece]
            if n == 1:
                alone = np.ones(len(code), bool)
                alone[i] = False
                rest = np.flatnonzero(alone)
                self.spelled = {int(c): text[c].encode("utf-8") for c in rest}
                frm.append(rest + shift[rest])
                to.append(frm[-1] + 1)
                piece.append(-1 - rest)
                weight.append(alpha * m.fallback * np.array([len(self.spelled[int(c)]) for c in rest], float))
            frm.append(i + shift[i])
            to.append(frm[-1] + n)
            piece.append(m.id[k])
            weight.append(alpha * m.score[k])
        frm, to, piece, weight = map(np.concatenate, (frm, to, piece, weight))
        order = np.argsort(to, kind="stable")
        self.frm, to, self.piece, weight = frm[order], to[order], piece[order], weight[order]
        node_word = np.repeat(np.arange(len(words)), size + 1)
        depth = to - self.first[node_word[to]]
        by_depth = np.argsort(depth.astype(np.int16) if len(depth) and depth.max() < 1 << 15 else depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, depth.max(initial=0) + 2))
        sums = np.zeros(int(size.sum()) + len(words))
        self.upto = np.empty(len(to))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = by_depth[a:b]
            node = to[e]
            new = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            count = np.diff(np.append(new, len(e)))
            v = sums[self.frm[e]] + weight[e]
            top = np.maximum.reduceat(v, new)
            v = np.exp(v - np.repeat(top, count))
            total = np.add.reduceat(v, new)
            sums[node[new]] = top + np.log(total)
            run = np.cumsum(v)
            run -= np.repeat(run[new] - v[new], count)
            share = node + np.minimum(run / np.repeat(total, count), 1.0)
            share[new + count - 1] = node[new] + 1.0
            self.upto[e] = share


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def sample(m: Model, texts: list[str], seeds: np.ndarray, alpha: float) -> list[np.ndarray]:
    """Piece ids of each text."""
    words = [words_of(t) for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    number: dict[str, int] = {}
    which = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    if not len(which):
        return [np.empty(0, np.int64) for _ in texts]
    lat = Lattices(m, list(number), alpha)
    first, node = lat.first[which], lat.ends[which]
    own = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    key = mix64(np.repeat(seeds, count) + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    live, step, took_word, took_piece = np.arange(len(which)), 0, [], []
    while len(live):
        u = (mix64(key[live] + np.uint64(step + 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        edge = np.searchsorted(lat.upto, node + u, side="right")
        took_word.append(live)
        took_piece.append(lat.piece[edge])
        node = lat.frm[edge]
        going = node > first[live]
        live, node, step = live[going], node[going], step + 1
    # steps run from a word's end to its start
    order = np.argsort(np.concatenate(took_word[::-1]), kind="stable")
    chosen = np.concatenate(took_piece[::-1])[order]
    per_word = np.bincount(np.concatenate(took_word), minlength=len(which))
    cuts = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(count)])]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ids = chosen[a:b]
        if len(ids) and ids.min() < 0:  # characters that are spelled in bytes
            ids = np.array([i for p in ids.tolist() for i in ([p] if p >= 0 else m.byte[list(lat.spelled[-1 - p])].tolist())], np.int64)
        out.append(ids)
    return out


def decode(m: Model, ids) -> str:
    """The text of a list of piece ids; the exact inverse of ``sample``."""
    return b"".join(map(m.bytes_of.__getitem__, ids)).decode("utf-8")


def row_seeds(keys: list, seed: int) -> np.ndarray:
    return mix64(np.array([zlib.crc32(str("null" if k is None else k).encode()) | (k & 0xFFFFFFFF if isinstance(k, int) else 0) << 32 for k in keys], np.uint64) + np.uint64(seed))


def encode_column(docs: DataFrame, model_path: str, alpha: float = 0.2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of little-endian 32-bit ids), decoded_sha256, lossless[, ids]."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        m = model(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids = sample(m, texts, row_seeds(b.column(0).to_pylist(), seed), alpha)
                back = [decode(m, x.tolist()) for x in ids]
                cols = [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([t == s for t, s in zip(back, texts, strict=True)], pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "lossless"]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(work, schema)
