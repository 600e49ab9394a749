"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive lower-case words (all words of a shorter text). A shingle weighs its frequency in the
text times log(1 + N / df), df being counted over all documents. Samples are drawn with frequencies from a table of 2**20
hashed places, a bound that no input changes; texts that share a bucket are then weighed by exact frequencies. Each of BANDS x ROWS samples keeps the shingle of the least hash value, the hash being
uniform in weight (two texts draw the same sample with the probability of their weighted Jaccard similarity); bands
of samples make the buckets, and pairs from buckets are verified by weighted Jaccard similarity on the texts. With
3 rows and 10 bands a pair at 0.8 shares a bucket with probability 0.999.

Equal texts are collapsed before any comparison.

Defined results: texts that are null or have no word link with nothing; rows with a null id are in no group and kept;
rows with equal ids get equal results; texts of any length are taken whole; ties go to the smaller id; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import groups_from_buckets
from .kernels import Rolling, mix64, squeezed, text_bytes, tidy, tidy_group, unsqueezed
from .phrase_dedup import groups_of, normal_words, word_hashes
from .shards import shards_for

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 10, 3, 0.8
PLACES, PARTS, STEP = 1 << 20, 16, 192 << 10
#: Shingles that are counted, and texts whose shingles are asked for, together.
GATHER, ASKED = 1 << 20, 2048
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def shingles(raw: np.ndarray, off: np.ndarray):
    """Of some rows: row, 48-bit shingle hash and frequency, sorted by row and hash. ASCII letters are folded here;
    others are folded by the caller, who has the characters."""
    data, start, end, count = normal_words(_LOW[raw], off)
    rows = len(off) - 1
    if not len(start):
        e = np.empty(0, np.int64)
        return e, e.astype(np.uint64), e
    value = word_hashes(data, start, end)
    bounds = np.concatenate([[0], np.cumsum(count)])
    number = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(rows), number)
    at = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + bounds[row]
    h = Rolling(value).spans(at, np.minimum(at + SHINGLE, bounds[row + 1]))
    key = (row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    key, tf = np.unique(key, return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), tf


def steps(column):
    """Row ranges of a text column with their shingles; at most 32768 rows and about STEP bytes
    a step, so that the arrays of a step stay in the processor's cache."""
    lowered = pa.array([t.lower() if t and not t.isascii() else t for t in column.to_pylist()], pa.string())
    raw, off = text_bytes(lowered)
    for a, b in groups_of(off, STEP):
        for c in range(a, b, 32768):
            d = min(b, c + 32768)
            yield c, d, shingles(raw[off[c] : off[d]], off[c : d + 1] - off[c])


def place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(28)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """Number of documents by hashed shingle; 2**20 counters whatever the input."""
    width = PLACES // PARTS

    def count(batches):
        total = np.zeros(PLACES, np.int64)
        for b in batches:
            for _, _, (_, h, _) in steps(b.column(0)):
                np.add.at(total, place(h), 1)
        blocks = [zstandard.compress(total[i * width : (i + 1) * width].tobytes(), 3) for i in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    def add(batches):
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for part, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zstandard.decompress(block), np.int64)
                have[part] = have[part] + got if part in have else got
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 3) for x in have.values()], pa.binary())], ["part", "block"])

    kind = "part int, block binary"
    out = np.zeros(PLACES, np.int64)
    # one row a part and task: at most 8 MB, the size of the table
    rows = docs.select(text_col).mapInArrow(tidy(count), kind).repartition(PARTS, "part").mapInArrow(add, kind).collect()
    for r in rows:
        out[r["part"] * width : (r["part"] + 1) * width] += np.frombuffer(zstandard.decompress(bytes(r["block"])), np.int64)
    return out


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(n / np.maximum(df, 1)).astype(np.float32)


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """k consistent weighted samples of each row, as 64-bit values (shingle and quantised weight): rows x k."""
    out = np.zeros((rows, k), np.uint64)
    if not len(row):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(first, len(row)))
    present = row[first]
    log_w = np.log(weight)
    scale = np.float32(1 / (1 << 21))
    for j in range(k):
        x = mix64(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        u = [((x >> np.uint64(s)) & np.uint64((1 << 21) - 1)).astype(np.float32) for s in (0, 21, 42)]
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        v = [((x >> np.uint64(s)) & np.uint64((1 << 21) - 1)).astype(np.float32) for s in (4, 26)]
        for a in (*u, *v):
            a += np.float32(0.5)
            a *= scale
        r = -np.log(u[0] * u[1])  # gamma(2, 1)
        c = -np.log(v[0] * v[1])
        t = np.floor(log_w / r + u[2])
        value = np.log(c) - r * (t - u[2]) - r
        least = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == np.repeat(least, size))
        own = row[hit]
        once = np.concatenate([[True], own[1:] != own[:-1]])
        hit = hit[once]
        out[present, j] = mix64(h[hit] ^ (t[hit].astype(np.int64).astype(np.uint64) << np.uint64(48)))
    return out


def signatures(docs: DataFrame, idf: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, digest and band keys of each document with words; texts' digests fold no case."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)  # 4 MB, whatever the data

    def work(batches):
        for b in batches:
            texts = b.column(1)
            for lo, hi, (row, h, tf) in steps(texts):
                if not len(row):
                    continue
                w = tf.astype(np.float32) * sent.value[place(h)]
                got = samples(row, h, w, hi - lo, BANDS * ROWS)
                present = np.unique(row)
                keys = []
                for band in range(BANDS):
                    x = np.full(hi - lo, band + 1, np.uint64)
                    for i in range(ROWS):
                        x = mix64(x ^ got[:, band * ROWS + i])
                    keys.append(x)
                keys = np.stack(keys, 1)[present].view(np.int64)
                digest = [hashlib.blake2b((texts[lo + int(i)].as_py()).encode(), digest_size=16).digest() for i in present]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(lo + present)), pa.array(digest, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    ["id", "digest", "bands"],
                )

    known = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return known.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(tidy(work), "id long, digest binary, bands array<long>")


def columns_of(x: np.ndarray) -> bytes:
    """Bytes of the values, all first bytes first: they compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_columns(raw: bytes, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def packed_shingles(h: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted shingle hashes, as differences, and 32-bit numbers that go with them."""
    return zstandard.compress(columns_of(np.diff(h, prepend=np.uint64(0))) + b"".join(columns_of(x.astype(np.uint32)) for x in more), 1)


def unpacked_shingles(block: bytes, more: int) -> list[np.ndarray]:
    raw = zstandard.decompress(block)
    n = len(raw) // (8 + 4 * more)
    return [np.cumsum(from_columns(raw, np.uint64, n, 0), dtype=np.uint64), *(from_columns(raw, np.uint32, n, (8 + 4 * i) * n) for i in range(more))]


def by_shard(h: np.ndarray, shards: int):
    """Order of the hashes by (shard, hash), and where each shard begins in it."""
    shard = (h % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((h, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def exactly_weighted(docs: DataFrame, texts: DataFrame, n: int, text_col: str) -> DataFrame:
    """id, digest, total, text of texts (id, text, squeezed): exact total weight, and the shingles with their number of
    documents and frequency. All documents' shingles are counted by gathers and dealt to shards as sorted blocks; gathers
    of the given texts ask each shard for their shingles, and get the counts back in the same order."""
    shards = shards_for(docs, text_col)

    def count(batches):
        parts, held = [], 0

        def counted():
            h, df = np.unique(np.concatenate(parts), return_counts=True)
            order, at = by_shard(h, shards)
            blocks = [packed_shingles(h[order[x:y]], df[order[x:y]]) for x, y in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])

        for b in batches:
            for _, _, (_, h, _) in steps(b.column(0)):
                parts.append(h)
                held += len(h)
                if held >= GATHER:
                    yield counted()
                    parts, held = [], 0
        if held:
            yield counted()

    def ask(batches):
        """gather, its documents (id, digest, number of shingles, places of these among the gather's, frequencies), and its shingles by shard."""
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, ASKED):
                key += 1
                part = b.slice(lo, ASKED)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                whole = [unsqueezed(x) for x in part.column(1).to_pylist()]
                got = list(steps(pa.array(whole, pa.string())))
                h, tf = (np.concatenate([x[i] for _, _, x in got]) for i in (1, 2))
                size = np.concatenate([np.bincount(x[0], minlength=hi - at) for at, hi, x in got])
                own, where = np.unique(h, return_inverse=True)
                order, at = by_shard(own, shards)
                place = np.empty(len(own), np.int64)
                place[order] = np.arange(len(own))
                digest = b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for t in whole)
                head = [np.array([len(ids), len(h)], np.int64).tobytes(), ids.astype(np.int64).tobytes(), digest, size.astype(np.int64).tobytes(), columns_of(place[where].astype(np.uint32)), columns_of(tf.astype(np.uint32))]
                blocks = [packed_shingles(own[order[x:y]]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([zstandard.compress(b"".join(head), 1)], pa.binary()), pa.array([blocks], pa.list_(pa.binary()))], ["gather", "head", "blocks"])

    def answer(table: pa.Table) -> pa.Table:
        gathers, blocks = table.column("gather").to_pylist(), table.column("block").to_pylist()
        parts = [unpacked_shingles(x, 1) for g, x in zip(gathers, blocks, strict=True) if g is None]
        h, df = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint32))
        order = np.argsort(h, kind="stable")
        h, df = h[order], df[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        h, df = h[first], np.add.reduceat(df, first) if len(first) else df
        asked = [(g, unpacked_shingles(x, 0)[0]) for g, x in zip(gathers, blocks, strict=True) if g is not None]
        back = [zstandard.compress(columns_of(df[np.searchsorted(h, own)].astype(np.uint32)), 1) for _, own in asked]
        shard = table.column("shard")[0].as_py()
        return pa.table({"gather": pa.array([g for g, _ in asked], pa.int64()), "shard": pa.array([shard] * len(asked), pa.int32()), "df": pa.array(back, pa.binary())})

    def weigh(batches):
        for b in batches:
            for head, blocks, told in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = zstandard.decompress(head)
                rows, total = np.frombuffer(raw, np.int64, 2).tolist()
                ids = np.frombuffer(raw, np.int64, rows, 16)
                digests = [raw[16 + 8 * rows + 16 * i : 32 + 8 * rows + 16 * i] for i in range(rows)]
                size = np.frombuffer(raw, np.int64, rows, 16 + 24 * rows)
                place, tf = (from_columns(raw, np.uint32, total, 16 + 32 * rows + 4 * i * total) for i in (0, 1))
                h = np.concatenate([unpacked_shingles(x, 0)[0] for x in blocks])
                df = np.concatenate([from_columns(r := zstandard.decompress(x["df"]), np.uint32, len(r) // 4, 0) for x in sorted(told, key=lambda x: x["shard"])])
                totals, packed, at = [], [], 0
                for k in size.tolist():
                    mine, f = place[at : at + k], tf[at : at + k]
                    totals.append(float((f * inverse_frequencies(df[mine], n)).sum(dtype=np.float64)))
                    packed.append(packed_shingles(h[mine], df[mine], f))
                    at += k
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(digests, pa.binary()), pa.array(totals, pa.float64()), pa.array(packed, pa.binary())], ["id", "digest", "total", "text"])

    counts = docs.select(text_col).mapInArrow(tidy(count), "shard int, block binary").select("shard", F.lit(None).cast("long").alias("gather"), "block")
    gathers = cut(texts.select("id", "text").mapInArrow(tidy(ask), "gather long, head binary, blocks array<binary>"))
    asked = gathers.select(F.posexplode("blocks").alias("shard", "block"), "gather").select("shard", "gather", "block")
    told = counts.union(asked).repartitionById(shards, "shard").groupBy("shard").applyInArrow(tidy_group(answer), "gather long, shard int, df binary")
    back = told.groupBy(F.col("gather").alias("_of")).agg(F.collect_list(F.struct("shard", "df")).alias("told"))
    return gathers.join(back, gathers["gather"] == back["_of"]).select("head", "blocks", "told").mapInArrow(tidy(weigh), "id long, digest binary, total double, text binary")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the group's least doc_id), kept (the least itself): one row for each row of docs."""
    spark = docs.sparkSession
    n = docs.count()
    idf = inverse_frequencies(document_frequencies(docs, text_col), max(n, 1))
    sig = cut(signatures(docs, idf, id_col, text_col))
    first = sig.groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    first = cut(first)
    drawn = first.select("rep", F.explode("bands").alias("key"))
    met = drawn.join(drawn.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key", "left_semi").select(F.col("rep").alias("id")).distinct()
    known = squeezed(docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col)
    texts = cut(known.select(F.col("_id").cast("long").alias("id"), F.col("_text").alias("text")).join(met, "id", "left_semi"))
    weighted = cut(exactly_weighted(docs, texts, max(n, 1), text_col))
    buckets = first.join(weighted.select(F.col("id").alias("rep"), "digest", "total").distinct(), ["rep", "digest"]).select(F.col("rep").alias("id"), "total", F.explode("bands").alias("key"))

    def weights(block):
        """Shingles of a weighted text, exact weights of one occurrence, and frequencies in the text."""
        h, df, tf = unpacked_shingles(block, 2)
        return h, inverse_frequencies(df, max(n, 1)), tf

    def prepare(block):
        h, idf, tf = weights(block)
        return h, tf * idf

    def alike(x, y):
        (hx, wx), (hy, wy) = x, y
        at = np.minimum(np.searchsorted(hx, hy), len(hx) - 1)
        both = hx[at] == hy
        shared = float(np.minimum(wx[at[both]], wy[both]).sum(dtype=np.float64))
        return shared >= similarity * (float(wx.sum(dtype=np.float64)) + float(wy.sum(dtype=np.float64)) - shared) * (1 - 1e-9)

    def allowed(x, y):
        return (x("total") >= y("total") * (similarity * 0.999)) & (y("total") >= x("total") * (similarity * 0.999))

    def rarest(ids, texts):
        """Prefix keys: a text's shingles, rarest first, up to the share by which two similar texts can differ; suffix
        is the weight from a shingle on, which bounds what two texts share from their first common shingle on."""

        def work(batches):
            for b in batches:
                parts = []
                for i, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    h, idf, tf = weights(block)
                    if not len(h):
                        continue
                    order = np.lexsort((h, -idf))
                    w = (tf * idf)[order].astype(np.float64)
                    total = w.sum()
                    suffix = total - (np.cumsum(w) - w)
                    n = int((suffix >= total * similarity * (1 - 1e-6)).sum())
                    parts.append((h[order[:n]].astype(np.int64), np.full(n, i), np.full(n, total), suffix[:n]))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["key", "id", "total", "suffix"])

        return texts.join(ids, "id").select("id", "text").mapInArrow(tidy(work), "key long, id long, total double, suffix double")

    def bound(x, y):
        return F.least(x("suffix"), y("suffix")) >= (x("total") + y("total")) * (similarity / (1 + similarity) * (1 - 1e-6))

    groups = groups_from_buckets(buckets, weighted.select("id", "text"), allowed, prepare, alike, ["total"], (rarest, bound))
    own = sig.select("id", "digest").distinct().join(first.select("digest", "rep"), "digest").join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
    own = own.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(own, F.col("doc_id").cast("long") == own["id"], "left")
    return out.select("doc_id", F.coalesce("component_id", F.col("doc_id").cast("long")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id").cast("long") == F.col("component_id"), F.lit(True)))
