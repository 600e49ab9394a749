"""Near-duplicate embeddings by sorted projection passes.

In each pass a vector's key is the concatenated signs of its projections on the pass's own random directions; vectors
are ordered lexicographically by key, and each is compared with its next WINDOW neighbours, by cosine in double
precision. Verified pairs of all passes are united into groups. Neighbour windows are bounded, so the links of a large
group would be found only in part; each group is therefore compared in full afterwards, in blocks of BLOCK vectors, and
a vector's links are counted there, without a row for each pair. The number of passes grows with the logarithm of the
table, as neighbours fall apart more often the more vectors stand between them.

Ranks are global: sorted keys are written once, counted by partition, and numbered; blocks of ranks overlap by WINDOW,
so no pair is lost at a partition's edge. Equal vectors are collapsed first and count by their number.

Defined results: a vector that is null, zero, empty or holds null or non-finite components links with nothing; rows with
equal ids and vectors are copies like any others; rows with a null id count as vectors of their own, named null, and
are in no one's group; vectors of different lengths don't link; of ties in a sort key the smaller id comes first; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shuffle_partitions
from .components import connected

BITS, WINDOW, BLOCK = 48, 64, 512
#: Passes over up to 2 ** AMPLE vectors, and further ones for each doubling from there: neighbours at the least cosine
#: fall apart more often the more vectors stand between them.
PASSES, AMPLE, MORE = 24, 16, 3
COSINE = 0.95


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safely for very large and very small components."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for x in column:
        v = x.as_py()
        ok = v is not None and len(v) and None not in v
        a = np.array(v, np.float64) if ok else None
        out.append(a if ok and np.isfinite(a).all() and a.any() else None)
    return out


def passes_for(n: int) -> int:
    return PASSES + MORE * max(0, (n - 1).bit_length() - AMPLE)


def directions(dim: int, seed: int, passes: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, passes * BITS))


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, raw: a vector's exact double components as bytes, null where it links with nothing."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else (v + 0.0).astype("<f8").tobytes() for v in usable(b.column(1))], pa.binary())], ["id", "raw"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(work, "id long, raw binary")


def keyed(distinct: DataFrame, seed: int) -> DataFrame:
    """pass, key, rep of each distinct vector and pass."""
    passes = passes_for(distinct.count())

    def work(batches):
        for b in batches:
            rep = b.column(0).to_numpy(zero_copy_only=False)
            raws = b.column(1).to_pylist()
            sizes = np.array([len(r) // 8 for r in raws], np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                v = unit(np.frombuffer(b"".join(raws[i] for i in at), "<f8").reshape(len(at), dim))
                bits = (v @ directions(int(dim), seed, passes) > 0).reshape(len(at), passes, BITS)
                packed = np.packbits(bits, axis=2)
                key = [(int(dim).to_bytes(4, "big") + packed[i, p].tobytes()) for i in range(len(at)) for p in range(passes)]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(passes, dtype=np.int32), len(at))), pa.array(key, pa.binary()), pa.array(np.repeat(rep[at], passes))], ["pass", "key", "rep"])

    return distinct.select("rep", "raw").mapInArrow(work, "pass int, key binary, rep long")


def ranked(keys: DataFrame) -> DataFrame:
    """pass, rep, rank: places in the order by (pass, key, rep), without one task that sees all rows."""
    order = keys.repartitionByRange(shuffle_partitions(keys.sparkSession), "pass", "key", "rep").sortWithinPartitions("pass", "key", "rep")

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], ["pass", "rep", "part", "place"])
            at += n

    placed = cut(order.mapInArrow(number, "pass int, rep long, part int, place long"))
    # one number a partition
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    upto, total = {}, 0
    for part in sorted(counts):
        upto[part] = total
        total += counts[part]
    offset = F.create_map(*[F.lit(x) for kv in upto.items() for x in kv])[F.col("part")] if upto else F.lit(0)
    return placed.select("pass", "rep", (F.col("place") + offset).alias("rank"))


def neighbour_links(distinct: DataFrame, seed: int, cosine: float) -> DataFrame:
    """Verified links (a, b) of distinct vectors from all passes."""
    rank = ranked(keyed(distinct, seed))
    span = BLOCK * 2
    block = F.floor(F.col("rank") / span)
    # a block holds its own ranks and the WINDOW after them
    dealt = rank.select("pass", "rep", "rank", F.explode(F.when((F.col("rank") % span < WINDOW) & (F.col("rank") >= span), F.array(block, block - 1)).otherwise(F.array(block))).alias("block"))
    rows = dealt.join(distinct.select("rep", "raw"), "rep").select("block", "pass", "rank", "rep", "raw")

    def compare(table: pa.Table) -> pa.Table:
        t = table.sort_by("rank")
        rep, which = t.column("rep").to_numpy(), t.column("pass").to_numpy()
        raws = t.column("raw").to_pylist()
        dims = np.array([len(r) for r in raws])
        a, b = [], []
        cuts = np.flatnonzero((which[1:] != which[:-1]) | (dims[1:] != dims[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rep)], strict=True):
            v = unit(np.frombuffer(b"".join(raws[lo:hi]), "<f8").reshape(hi - lo, -1))
            for i in range(0, hi - lo, WINDOW):
                near = v[i : i + WINDOW] @ v[i : i + 2 * WINDOW].T
                x, y = np.nonzero(near >= cosine)
                ok = (y > x) & (y - x <= WINDOW)
                a.append(rep[lo + i + x[ok]])
                b.append(rep[lo + i + y[ok]])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return rows.groupBy("block").applyInArrow(compare, "a long, b long").distinct()


def links_within(members: DataFrame, cosine: float) -> DataFrame:
    """rep, links: of distinct vectors (component, rep, raw, copies), the copies in the own component with cosine at
    least ``cosine``, without the own ones. Components are cut into blocks, and each pair of blocks is one group."""
    size = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = members.join(size, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def count(table: pa.Table) -> pa.Table:
        rep, copies, own = (table.column(c).to_numpy() for c in ("rep", "copies", "own"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        v = unit(np.frombuffer(b"".join(table.column("raw").to_pylist()), "<f8").reshape(len(rep), -1))
        links = np.zeros(len(rep), np.int64)
        if lo == hi:
            near = v @ v.T >= cosine
            np.fill_diagonal(near, False)
            links = near @ copies
        else:
            x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            near = v[x] @ v[y].T >= cosine
            links[x], links[y] = near @ copies[y], near.T @ copies[x]
        return pa.table({"rep": pa.array(rep), "links": pa.array(links, pa.int64())})

    return pairs.select("component", "lo", "hi", "own", "rep", "raw", "copies").groupBy("component", "lo", "hi").applyInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    rows = cut(prepared(vectors, id_col, vector_col))
    good = rows.filter("raw is not null and id is not null")
    distinct = cut(good.groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    groups = cut(connected(neighbour_links(distinct, seed, cosine)))
    members = distinct.join(groups.select(F.col("id").alias("rep"), "component"), "rep")
    links = links_within(members, cosine)
    told = distinct.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").join(links, "rep", "left")
    told = told.select("raw", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(told, "raw", "left")
    known = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias("vec_id"),
        F.when(known, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(known, F.coalesce("c", "id")).alias("component_id"),
        F.when(known, F.coalesce("c", "id") == F.col("id")).otherwise(True).alias("kept"),
    )
