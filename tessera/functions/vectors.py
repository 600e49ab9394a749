"""Vectors of texts by feature hashing, and the nearest vectors of many queries, in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Dimensions of a text's vector.
DIMENSIONS = 64
#: Queries that are sent to the tasks as they are; more of them meet the rows in blocks of as many, with rows in blocks of ROWS.
QUERIES, ROWS = 2048, 65_536
#: Words whose hashes a task remembers.
REMEMBERED = 1_000_000
#: Cosines that a task holds at once where the queries are sent to it.
SCORES = 1 << 21


def let(value, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def starts(ordered) -> Column:
    """Where in an array in order, counted from 0, each of its values begins."""
    return F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)))


def runs(ordered, at, f) -> Column:
    """``f`` of each value of an array in order, and of how often it stands there; ``at`` are the values' ``starts``."""
    return F.transform(at, lambda i, k: f(F.get(ordered, i), F.coalesce(F.get(at, k + 1), F.size(ordered)) - i))


def counts(ordered) -> Column:
    """A map from each value of an array in order to how often it stands there; work grows with the array, not its square."""
    return let(starts(ordered), lambda at: F.map_from_arrays(runs(ordered, at, lambda x, n: x), runs(ordered, at, lambda x, n: n)))


def hashed(words, dimensions: int = DIMENSIONS) -> Column:
    """v and norm of a text's words. A word's digest tells its dimension and its sign, so that words of one dimension cancel out
    as often as they add up; v holds the sums, v / norm is the unit vector. Without words both are zero, and null of null."""
    def code(w):
        h = F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long")
        return (h % dimensions * 2 + F.when(F.floor(h / dimensions) % 2 == 0, 1).otherwise(0)).cast("int")

    def dense(c, often):
        number = lambda k: F.coalesce(F.try_element_at(often, k), F.lit(0))
        v = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: number(d * 2 + 1) - number(d * 2))
        return let(v, lambda v: F.struct(v.alias("v"), F.when(c.isNotNull(), F.sqrt(F.aggregate(v, F.lit(0).cast("long"), lambda n, x: n + x * x))).alias("norm")))

    return let(F.sort_array(F.transform(words, code)), lambda c: let(counts(c), lambda often: dense(c, often)))


class Codes(dict):
    """A word's dimension and sign as one number, or -1 of words that are left out; each word is hashed once."""

    def __init__(self, left_out: tuple[str, ...], least: int, dimensions: int):
        self.left_out, self.least, self.dimensions = frozenset(left_out), least, dimensions

    def __missing__(self, w: str) -> int:
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        code = -1 if len(w) < self.least or w in self.left_out else h % self.dimensions * 2 + h // self.dimensions % 2
        self[w] = code
        return code


def hashed_rows(df: DataFrame, text: str, split, left_out: tuple[str, ...], least: int, dimensions: int = DIMENSIONS) -> DataFrame:
    """v and norm as ``hashed`` has them of the words that ``split`` finds in each row's ``text``, but those ``left_out`` and those of
    fewer than ``least`` characters, beside the other columns; rows without any are left out."""
    keys = [c for c in df.columns if c != text]

    def work(batches):
        codes = Codes(left_out, least, dimensions)
        for b in batches:
            all_, size = [], []
            for x in b.column(len(keys)).to_pylist():
                words = split(x) if x else ()
                all_.extend(map(codes.__getitem__, words))
                size.append(len(words))
            if len(codes) > REMEMBERED:
                codes.clear()
            code, row = np.array(all_, np.int64), np.repeat(np.arange(len(size)), size)
            code, row = code[code >= 0], row[code >= 0]
            n = np.bincount(row * dimensions + code // 2, 1.0 - 2.0 * (code % 2), len(size) * dimensions)
            v = n.astype(np.int64).reshape(-1, dimensions)
            norm = np.sqrt((v * v).sum(axis=1).astype(np.float64))
            at = np.flatnonzero(norm > 0)
            each = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * dimensions, v[at].astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)) for i in range(len(keys))), each, pa.array(norm[at])], names=[*keys, "v", "norm"])

    kind = ", ".join(f"{k} {t}" for k, t in df.dtypes if k != text)
    return df.select(*keys, text).mapInArrow(work, f"{kind}, v array<int>, norm double")


def hashed_sql(words: str, keys: str, dimensions: int = DIMENSIONS) -> str:
    """``hashed`` of the rows ``keys``, term, as one row (``keys``, v, norm) of each key with a norm."""
    sums = f"SELECT {keys}, CAST(h % {dimensions} AS INTEGER) AS d, sum(CASE WHEN (h // {dimensions}) % 2 = 0 THEN 1 ELSE -1 END) AS n FROM (SELECT {keys}, CAST('0x' || md5(term)[1:8] AS BIGINT) AS h FROM ({words})) GROUP BY ALL"
    return f"SELECT {keys}, list_transform(range(0, {dimensions}), lambda i: coalesce(map_extract_value(m, CAST(i AS INTEGER)), 0)) AS v, norm FROM (SELECT {keys}, map_from_entries(list({{'k': d, 'v': CAST(n AS INTEGER)}})) AS m, sqrt(sum(n * n)) AS norm FROM ({sums}) GROUP BY {keys}) WHERE norm > 0"


def best(qid, q, q_norm, ids, v, norm, k: int) -> pd.DataFrame:
    """The k rows of highest cosine of each query (score to 6 places, then the smaller id), of one block."""
    score = np.round(q @ v.T / (q_norm[:, None] * norm[None, :]), 6)
    out = []
    for i in range(len(qid)):
        s = score[i]
        if len(s) > k:
            near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            near = near[np.lexsort((ids[near], -s[near]))[:k]]
        else:
            near = np.arange(len(s))
        out.append(pd.DataFrame({"qid": qid[i], "id": ids[near], "score": s[near] + 0.0}))
    return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "score": []})


class Foremost:
    """The k ids of highest score of each query (then the smaller id), of blocks that come one after the other."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, np.finfo(np.float64).min)
        self.query, self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Queries by ids; at minus infinity there is no pair."""
        if len(ids) > self.k and (self.least == np.finfo(np.float64).min).any():
            self.least = np.maximum(self.least, np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        i, j = np.nonzero(score >= self.least[:, None])
        query, ids, score = (np.concatenate(x) for x in ((self.query, i), (self.ids, ids[j]), (self.score, score[i, j])))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        kept = rank < self.k
        self.query, self.ids, self.score = query[kept], ids[kept], score[kept]


def _arrays(rows: pd.DataFrame, key: str):
    v = np.vstack(rows["v"].to_numpy()).astype(np.float64) if len(rows) else np.empty((0, 1))
    return rows[key].to_numpy(), v, rows["norm"].to_numpy()


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """qid, id, score: of each query (qid, v, norm) at least its k nearest rows (id, v, norm), by cosine. Up to QUERIES
    queries go to the rows, which stay where they are; of more, blocks of queries and blocks of rows meet in a shuffle. A
    block, or a task that the queries were sent to, leaves k rows of a query, for the caller to rank."""
    spark = queries.sparkSession
    ids = {f: t for f, t in (*queries.dtypes, *rows.dtypes)}
    kind = f"qid {ids['qid']}, id {ids['id']}, score double"
    few = queries.select("qid", "v", "norm").limit(QUERIES + 1).toPandas()  # QUERIES rows at most go on
    if len(few) <= QUERIES:
        sent = spark.sparkContext.broadcast(_arrays(few, "qid"))

        def work(batches):
            qid, q, q_norm = sent.value
            top = Foremost(len(qid), k)
            for b in batches if len(qid) else ():
                ids, norm = b.column(0).to_numpy(), b.column(2).to_numpy()
                v = b.column(1).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
                for i in range(0, len(ids), SCORES // len(qid)):
                    part = slice(i, i + SCORES // len(qid))
                    top.add(np.round(q @ v[part].T / (q_norm[:, None] * norm[None, part]), 6) + 0.0, ids[part])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[top.query], top.ids, top.score)], names=["qid", "id", "score"])

        return rows.select("id", "v", "norm").mapInArrow(work, kind)
    meet = lambda a, b: best(*_arrays(b, "qid"), *_arrays(a, "id"), k) if len(a) and len(b) else pd.DataFrame({"qid": [], "id": [], "score": []})
    left, right = in_blocks(queries.select("qid", "v", "norm"), rows.select("id", "v", "norm"), "qid", "id", QUERIES)
    return left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(meet, kind)


def in_blocks(queries: DataFrame, rows: DataFrame, qid: str, key: str, most: int):
    """Rows and queries with the numbers b and g of where they meet: each block of about ROWS rows, each of about ``most`` queries."""
    blocks = max(1, -(-rows.count() // ROWS))
    groups = max(1, -(-queries.count() // most))
    dealt = lambda df, key, n: df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(n)))
    left = dealt(rows, key, blocks).select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).withColumnRenamed("_own", "b")
    right = dealt(queries, qid, groups).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).withColumnRenamed("_own", "g")
    both = lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("b", "g")})
    return both(left), both(right)


#: Queries of a block of ``compared``, and rows and queries whose cosines are held at once.
COMPARED, HELD = 8192, (65_536, 16)


def compared(queries: DataFrame, rows: DataFrame, reduce, kind: str) -> DataFrame:
    """What ``reduce`` makes of all cosines (to 6 places, 0 where a vector has no length) of queries (qid, v) and rows (id, v and
    what else they have) of one dimension, as ``kind``; a null vector has no length. It is called with a block's qids, its rows without their vectors, and an array of queries
    by rows; no more than HELD cosines are held at once, and its results are one task's share, for the caller to put together."""

    def unit(v, size):
        out = np.zeros((len(v), size))
        for i, x in enumerate(v):
            if x is not None and len(x) == size:
                out[i] = x
        n = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
        return np.divide(out, n, out=np.zeros_like(out), where=n != 0)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches)
        a, b = (block.filter(pc.equal(block["asks"], asks)).select(names).to_pandas() for asks, names in ((False, held), (True, ["qid", "q"])))
        del block
        if not len(a) or not len(b):
            return
        size = max((len(x) for x in b["q"] if x is not None), default=1)
        u, w, about, qid = unit(a["v"], size), unit(b["q"], size), a.drop(columns="v"), b["qid"].to_numpy()
        del a, b
        for j in range(0, len(w), HELD[1]):
            for i in range(0, len(u), HELD[0]):
                score = np.round(w[j : j + HELD[1]] @ u[i : i + HELD[0]].T, 6) + 0.0
                got = reduce(qid[j : j + HELD[1]], about.iloc[i : i + HELD[0]], score)
                if len(got):
                    yield pa.RecordBatch.from_pandas(got, schema=schema, preserve_index=False)

    held, schema = rows.columns, to_arrow_schema(StructType.fromDDL(kind))
    left, right = in_blocks(queries.select("qid", F.col("v").alias("q")), rows, "qid", "id", COMPARED)
    both = left.withColumn("asks", F.lit(False)).unionByName(right.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    return both.groupBy("b", "g").applyInArrow(meet, kind)


def leading(qid, about: pd.DataFrame, score, k: int) -> pd.DataFrame:
    """qid, score and the rows' columns: the k of highest score of each query, then of the smaller id; for ``reduce``."""
    out, ids = [], about["id"].to_numpy()
    for i in range(len(qid)):
        s, at = score[i], np.arange(len(ids))
        if len(s) > k:
            near = np.flatnonzero(~(s < np.partition(s, len(s) - k)[len(s) - k]))  # NaN counts as the greatest
            at = near[np.lexsort((ids[near], np.where(np.isnan(s[near]), -np.inf, -s[near])))[:k]]
            s = s[at]
        out.append((np.full(len(at), qid[i]), at, s))
    at = np.concatenate([x[1] for x in out])
    return pd.DataFrame({"qid": np.concatenate([x[0] for x in out]), "score": np.concatenate([x[2] for x in out])} | {c: about[c].to_numpy()[at] for c in about})


def at_least(qid, about: pd.DataFrame, score, least: float) -> pd.DataFrame:
    """qid, score and the rows' columns of all pairs of ``least`` or more; for ``reduce``."""
    i, j = np.nonzero(~(score < least))  # NaN counts as the greatest
    return pd.DataFrame({"qid": qid[i], "score": score[i, j]} | {c: about[c].to_numpy()[j] for c in about})
