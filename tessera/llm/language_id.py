"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on a bounded sample of labelled rows
(``per_lang`` documents a language, the least by a seeded hash of the id, ``SPANS`` spans of each). It labels every
byte position; a document's probabilities are the mean over all its positions. Texts are read whole: they are
cut into spans of ``SPAN`` bytes that run through the network side by side, so the work is linear in the bytes.

Defined results: text that is null or holds no letter gets 'und' with score 0; labels are only read from rows that
the caller offers for learning; rows with null labels or texts are not learned from; with no learnable row every
prediction is 'und' with score 0; ties between languages go to the first in sorted order; repeated rows get equal
predictions; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import expand, text_bytes, tidy

SPAN, SPANS, HIDDEN = 128, 6, 8
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Net:
    """Weights, first axis: the forward and the backward direction; gates r (reset), z (update), n (candidate).
    The gates are piecewise linear, clip(x, 0, 1), which spares two thirds of the transcendental functions."""

    langs: list[str]
    inp: dict[str, np.ndarray]  # gate -> 2 x 256 x h: input weights (and bias) of each byte
    rec: dict[str, np.ndarray]  # gate -> 2 x h x h
    bias: np.ndarray  # 2 x 1 x h: of the candidate's recurrent part
    out: np.ndarray  # 2 x h x languages
    out_bias: np.ndarray


def forward(net: Net, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """x: T x B bytes. States 2 x T x B x h, both directions aligned with the positions of x."""
    steps, width = x.shape
    h = net.bias.shape[-1]
    states = np.empty((2, steps, width, h), np.float32)
    state = np.zeros((2, width, h), np.float32)
    a = {g: np.empty((2, width, h), np.float32) for g in "rzn"}
    for t in range(steps):
        for g in "rzn":
            np.take(net.inp[g][0], x[t], 0, a[g][0], "clip")
            np.take(net.inp[g][1], x[steps - 1 - t], 0, a[g][1], "clip")
        inner = np.matmul(state, net.rec["n"])
        inner += net.bias
        for g in "rz":
            a[g] += np.matmul(state, net.rec[g])
            np.clip(a[g], 0, 1, a[g])
        cand = inner * a["r"]
        cand += a["n"]
        np.tanh(cand, cand)
        if keep is not None:
            keep.append((state, a["r"].copy(), a["z"].copy(), inner, cand))
        state = state - cand
        state *= a["z"]
        state += cand
        states[0, t], states[1, steps - 1 - t] = state[0], state[1]
    return states


def label_probabilities(net: Net, states: np.ndarray) -> np.ndarray:
    """languages x (T * B): the probability of each language at each position."""
    flat = states.reshape(2, -1, states.shape[-1])
    logits = net.out[0].T @ flat[0].T
    logits += net.out[1].T @ flat[1].T
    logits += net.out_bias[:, None]
    logits -= logits.max(0)
    np.exp(logits, logits)
    logits /= logits.sum(0)
    return logits


def train(spans: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = HIDDEN, steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 3) -> Net:
    """spans: N x T bytes. Adam on the mean cross-entropy of all positions."""
    rng = np.random.default_rng(seed)
    h, c, length = hidden, len(langs), spans.shape[1]
    f = lambda *s, k=0.3: rng.normal(0, k, s).astype(np.float32)
    net = Net(langs, {"r": f(2, 256, h) + 0.5, "z": f(2, 256, h) + 0.6, "n": f(2, 256, h)}, {g: f(2, h, h) for g in "rzn"}, np.zeros((2, 1, h), np.float32), f(2, h, c), np.zeros(c, np.float32))
    params = {**{f"inp_{g}": net.inp[g] for g in "rzn"}, **{f"rec_{g}": net.rec[g] for g in "rzn"}, "bias": net.bias, "out": net.out, "out_bias": net.out_bias}
    m = {k: np.zeros_like(p) for k, p in params.items()}
    v = {k: np.zeros_like(p) for k, p in params.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(spans), batch)
        x, y = np.ascontiguousarray(spans[pick].T), labels[pick]
        kept: list = []
        states = forward(net, x, kept)
        delta = label_probabilities(net, states).reshape(c, length, batch)
        delta[y, :, np.arange(batch)] -= 1
        delta = delta.reshape(c, -1) / (length * batch)
        flat = states.reshape(2, -1, h)
        grad = {"out": np.stack([flat[i].T @ delta.T for i in (0, 1)]), "out_bias": delta.sum(1)}
        into = np.stack([(net.out[i] @ delta).T.reshape(length, batch, h) for i in (0, 1)])
        drec = {g: np.zeros_like(net.rec[g]) for g in "rzn"}
        dinp = {g: np.empty((2, length, batch, h), np.float32) for g in "rzn"}
        dbias = np.zeros_like(net.bias)
        carry = np.zeros((2, batch, h), np.float32)
        for t in range(length - 1, -1, -1):
            before, r, z, inner, cand = kept[t]
            carry[0] += into[0, t]
            carry[1] += into[1, length - 1 - t]
            dn = carry * (1 - z) * (1 - cand * cand)
            dz = carry * (before - cand) * ((z > 0) & (z < 1))
            dr = dn * inner * ((r > 0) & (r < 1))
            dinner = dn * r
            past = before.transpose(0, 2, 1)
            carry = carry * z
            for g, d in (("r", dr), ("z", dz), ("n", dinner)):
                drec[g] += past @ d
                carry += d @ net.rec[g].transpose(0, 2, 1)
            dbias += dinner.sum(1, keepdims=True)
            for g, d in (("r", dr), ("z", dz), ("n", dn)):
                dinp[g][0, t], dinp[g][1, length - 1 - t] = d[0], d[1]
        at = x.ravel()
        for g in "rzn":
            grad[f"rec_{g}"] = drec[g]
            grad[f"inp_{g}"] = np.stack([np.stack([np.bincount(at, dinp[g][i].reshape(-1, h)[:, u], 256) for u in range(h)], 1) for i in (0, 1)])
        grad["bias"] = dbias
        norm = float(np.sqrt(sum((q * q).sum() for q in grad.values())))
        lr = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, p in params.items():
            q = grad[k] * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.99 * v[k] + 0.01 * q * q
            p -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, may_learn, per_lang: int = 250, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """A net trained on rows where ``may_learn`` (a Column) holds. Only ids and labels are ranked; at most
    per_lang rows a language and SPANS spans a row reach the driver."""
    rows = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    w = Window.partitionBy(lang_col).orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    chosen = rows.select(id_col, lang_col).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_lang)
    # a bounded list: per_lang ids a language
    ids = [r[0] for r in chosen.select(id_col).collect()]
    if not ids:
        return None

    def spans(batches):
        seen = set()
        for b in batches:
            keys, langs, parts = [], [], []
            for key, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                if (key, lang) in seen or not len(raw) or not _LETTER.search(text):
                    continue
                seen.add((key, lang))
                rng = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
                drawn = [raw[at : at + SPAN] for at in rng.integers(0, max(1, len(raw) - SPAN + 1), SPANS).tolist()]
                keys.append(str(key))
                langs.append(lang)
                parts.append(b"".join(np.pad(x, (0, SPAN - len(x)), constant_values=32).tobytes() for x in drawn))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["key", "lang", "spans"])

    wanted = rows.filter(F.col(id_col).isin(ids)).select(id_col, lang_col, text_col).mapInArrow(spans, "key string, lang string, spans binary")
    # rows that share an id count once, so that no more than the ids' number comes back
    held = wanted.groupBy("key", "lang").agg(F.min("spans").alias("spans")).collect()
    got = sorted((r["lang"], bytes(r["spans"][i : i + SPAN])) for r in held for i in range(0, len(r["spans"]), SPAN))
    if not got:
        return None
    langs = sorted({g[0] for g in got})
    number = {x: i for i, x in enumerate(langs)}
    return train(np.array([np.frombuffer(g[1], np.uint8) for g in got]), np.array([number[g[0]] for g in got]), langs, seed=seed)


def document_probabilities(net: Net, raw: np.ndarray, off: np.ndarray, width: int = 1024) -> np.ndarray:
    """Rows x languages: mean of the labels' probabilities over all byte positions."""
    size = np.diff(off)
    spans = (size + SPAN - 1) // SPAN
    row = np.repeat(np.arange(len(size)), spans)
    start = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN
    length = np.minimum(SPAN, off[1:][row] - start)
    total = np.zeros((len(size), len(net.langs)))
    for lo in range(0, len(row), width):
        s, n = start[lo : lo + width], length[lo : lo + width]
        x = np.full((len(s), SPAN), 32, np.uint8)
        inside = np.arange(SPAN) < n[:, None]
        x[inside] = raw[expand(s, n)]
        prob = label_probabilities(net, forward(net, np.ascontiguousarray(x.T))).reshape(len(net.langs), SPAN, -1)
        if not inside.all():
            prob *= inside.T
        np.add.at(total, row[lo : lo + width], prob.sum(1, dtype=np.float64).T)
    return total / np.maximum(size, 1)[:, None]


def predict(docs: DataFrame, net: Net | None, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of docs with lang_pred and score after them; columns of those names are replaced."""
    columns = [c for c in columns if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some 25 kB, whatever the data
    schema = ", ".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", lang_pred string, score double"

    def work(batches):
        own = sent.value
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 1024):
                b = whole.slice(at, 1024)
                text = b.column(0)
                lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                if own is not None and b.num_rows:
                    raw, off = text_bytes(text)
                    prob = document_probabilities(own, raw, off)
                    best = prob.argmax(1)
                    for i, t in enumerate(text.to_pylist()):
                        if t and _LETTER.search(t):
                            lang[i], score[i] = own.langs[best[i]], min(1.0, float(prob[i, best[i]]))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*columns, "lang_pred", "score"])

    return docs.select(F.col(text_col), *columns).mapInArrow(tidy(work), schema)
