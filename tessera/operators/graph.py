"""Entities, relations and walks on the graph."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import views as V
from ..registry import query
from ..session import cut, shared_dir, table

ALL = "chunks postings entities mentions"


@query("gr01_mentions", "SELECT type, count(*) AS mentions, count(DISTINCT name) AS names, CAST(sum(mention_count) AS BIGINT) AS total FROM mentions GROUP BY type", ALL)
def gr01(spark, d):
    """GR01: dictionary extraction, mentions by type."""
    return V.mentions(spark, d).groupBy("type").agg(F.count("*").alias("mentions"), F.countDistinct("name").alias("names"), F.sum("mention_count").alias("total"))


@query("gr02_standard_names", "SELECT DISTINCT regexp_replace(regexp_replace(upper(source), '[ \t]+', ' ', 'g'), '-[0-9]{4}$', '') AS name FROM documents")
def gr02(spark, d):
    """GR02: normalised names, year dropped."""
    return table(spark, d, "documents").select(F.regexp_replace(F.regexp_replace(F.upper("source"), "[ \\t]+", " "), "-[0-9]{4}$", "").alias("name")).distinct()


@query("gr07_cooccurrence", "SELECT source, target, weight FROM edges WHERE weight >= 3", ALL + " edges")
def gr07(spark, d):
    """GR07: co-occurrence edges of three chunks or more."""
    return V.edges(spark, d).filter("weight >= 3")


#: Chunks between a connector and a parameter that belong together (a fixed value).
BAND = 100
SPEC = f"WITH c AS (SELECT file_id, chunk_index AS idx, name FROM mentions WHERE type = 'connector'), p AS (SELECT file_id, chunk_index AS idx, name FROM mentions WHERE type = 'param') SELECT c.name AS source, p.name AS target, min(abs(c.idx - p.idx)) AS distance, count(DISTINCT c.file_id) AS weight FROM c JOIN p ON c.file_id = p.file_id AND abs(c.idx - p.idx) <= {BAND} GROUP BY ALL"


def banded(left, right, band: int):
    """JN11: pairs of (file_id, ci, source) and (file_id, pi, target) at most ``band`` chunks apart. Places are put in buckets
    as wide as the band, each row of the right side in three, so that a long file is no single group."""
    c = left.withColumn("b", F.floor(F.col("ci") / band))
    p = right.withColumn("b", F.explode(F.sequence(F.floor(F.col("pi") / band) - 1, F.floor(F.col("pi") / band) + 1)))
    return c.join(p, ["file_id", "b"]).filter(F.abs(F.col("ci") - F.col("pi")) <= band)


def sides(spark, d):
    m = V.mentions(spark, d).select("file_id", "chunk_index", "name", "type")
    side = lambda kind, at, name: m.filter(F.col("type") == kind).select("file_id", F.col("chunk_index").alias(at), F.col("name").alias(name))
    return side("connector", "ci", "source"), side("param", "pi", "target")


def near_names(connectors: list[tuple[int, str]], params: list[tuple[int, str]], band: int) -> dict[str, dict[str, int]]:
    """Of places and names of one file: for each connector the parameters at most ``band`` chunks away, by their least distance."""
    out: dict[str, dict[str, int]] = {}
    params = sorted(params)
    at = [p for p, _ in params]
    for c, source in connectors:
        own = out.setdefault(source, {})
        for p, target in params[bisect_left(at, c - band) : bisect_right(at, c + band)]:
            far = abs(c - p)
            if own.get(target, far + 1) > far:
                own[target] = far
    return out


#: Parts of a connector's rows, by the parameter's name: a connector that is in most files isn't one task's.
SHARES = 8


def near_rows(spark, d):
    """source, share, targets, distances: the parameters near a connector in one file, as one row of each share. Names are found
    in a chunk's row, a file's chunks meet once."""
    names = F.array_distinct(F.filter(V.tokens(F.col("content")), lambda t: (F.length(t) >= V.NAME) & t.rlike("^[a-zà-ÿ]+$")))
    c = V.chunks(spark, d).select("file_id", "chunk_index", names.alias("m"))
    of = lambda kind: F.array_join(F.filter("m", lambda t: V.entity_type(t) == kind), " ")
    held = c.select("file_id", "chunk_index", of("connector").alias("c"), of("param").alias("p")).filter("file_id is not null and (c <> '' or p <> '')")
    files = held.groupBy("file_id").agg(F.collect_list(F.struct("chunk_index", "c", "p")).alias("m")).select("m")

    def work(batches):
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            rows = []
            for m in b.column(0).to_pylist():
                side = lambda k: [(x["chunk_index"], n) for x in m for n in x[k].split()]  # noqa: B023, E731
                for source, near in near_names(side("c"), side("p"), BAND).items():
                    parts: dict[int, list] = {}
                    for target in near:
                        parts.setdefault(crc32(target.encode()) % SHARES, []).append(target)
                    rows += [(source, k, " ".join(ts), [near[t] for t in ts]) for k, ts in parts.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32())), strict=True)], ["source", "share", "targets", "distances"])

    return files.mapInArrow(work, "source string, share int, targets string, distances array<int>")


@query("gr08_spec_edges", SPEC, ALL)
def gr08(spark, d):
    """GR08: connectors and parameters within a hundred chunks of a file, by files and least distance. A file's pairs are made in
    its row and go around once, as lists by connector; they are taken apart where they are counted."""
    dealt = near_rows(spark, d).repartition("source", "share")
    pairs = dealt.select("source", "share", F.explode(F.arrays_zip(F.split("targets", " ").alias("t"), F.col("distances").alias("d"))).alias("x"))
    edges = pairs.groupBy("source", "share", F.col("x.t").alias("target")).agg(F.min("x.d").cast("long").alias("distance"), F.count("*").alias("weight"))
    return edges.select("source", "target", "distance", "weight")


@query("jn11_band_join", "SELECT c.file_id, c.name AS source, p.name AS target, c.chunk_index AS ci, p.chunk_index AS pi FROM mentions c JOIN mentions p ON c.file_id = p.file_id AND abs(c.chunk_index - p.chunk_index) <= 2 WHERE c.type = 'connector' AND p.type = 'param'", ALL)
def jn11(spark, d):
    """JN11: the band join itself, two chunks wide."""
    return banded(*sides(spark, d), 2).select("file_id", "source", "target", "ci", "pi")


@query("jn10_pairs_in_chunk", "SELECT a.chunk_id, a.name AS source, b.name AS target FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND a.name < b.name", ALL)
def jn10(spark, d):
    """JN10: pairs of entities of one chunk, each once; made within a chunk's row."""
    return V.pairs(spark, d)


@query("ag08_degree", "SELECT name, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT source AS name, weight AS w FROM edges UNION ALL SELECT target, weight FROM edges) GROUP BY name", ALL + " edges")
def ag08(spark, d):
    """AG08: degree and weight of nodes."""
    e = V.edges(spark, d)
    both = e.select(F.col("source").alias("name"), "weight").union(e.select("target", "weight"))
    return both.groupBy("name").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


@query("gr13_typed_graph", "SELECT e.source, e.target, e.weight FROM edges e WHERE e.source IN (SELECT name FROM entities WHERE type IN ('material', 'param')) AND e.target IN (SELECT name FROM entities WHERE type IN ('material', 'param'))", ALL + " edges")
def gr13(spark, d):
    """GR13: edges with both endpoints of the chosen types."""
    n = V.entities(spark, d).filter(F.col("type").isin("material", "param")).select("name")
    return V.edges(spark, d).join(n, F.col("source") == F.col("name"), "left_semi").join(n, F.col("target") == F.col("name"), "left_semi")


STRONG_EDGES = "strong AS (SELECT source, target FROM edges WHERE weight >= 3)"
BFS = f"WITH RECURSIVE {STRONG_EDGES}, und AS (SELECT source AS a, target AS b FROM strong UNION SELECT target, source FROM strong), start AS (SELECT min(source) AS name FROM strong), walk(name, hop) AS (SELECT name, 0 FROM start UNION SELECT und.b, hop + 1 FROM walk JOIN und ON und.a = walk.name WHERE hop < 2) SELECT name, CAST(min(hop) AS BIGINT) AS hop FROM walk WHERE name IS NOT NULL GROUP BY name"


def undirected(spark, d, least: int):
    e = V.edges(spark, d).filter(F.col("weight") >= least).select("source", "target")
    return e.union(e.select("target", "source")).toDF("a", "b").distinct()


@query("gr14_local_graph", BFS, ALL + " edges")
def gr14(spark, d):
    """GR14: breadth-first walk of two hops from the least node over strong edges; the frontier stays a
    DataFrame, and hops are few and fixed."""
    und = cut(undirected(spark, d, 3))
    seen = und.agg(F.min("a").alias("name")).filter("name is not null").withColumn("hop", F.lit(0).cast("long"))
    for hop in (1, 2):
        step = seen.join(und, seen["name"] == und["a"]).select(F.col("b").alias("name"), F.lit(hop).cast("long").alias("hop"))
        seen = seen.union(step).groupBy("name").agg(F.min("hop").alias("hop"))
    return seen


#: The farthest a local graph goes, and how many nodes it shows.
FARTHEST, SHOWN = 5, 40


#: Nodes of a block of bits.
BITS = 1 << 16
UNSEEN = 255


def numbered(e: DataFrame, center: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (name, id; numbered from 0 in the order of their names), the edges by these numbers (a, b, strong), both written
    to the shared folder, and the number of nodes."""
    spark = e.sparkSession
    root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex}"
    names = e.select(F.col("source").alias("name")).union(e.select("target")).union(center.select("name")).distinct()
    names.orderBy("name").select("name", F.monotonically_increasing_id().alias("at")).write.parquet(f"{root}/names")
    names = spark.read.parquet(f"{root}/names").select("name", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at"))
    sizes = sorted(map(tuple, names.groupBy("part").count().collect()))  # a row for each task that wrote
    first = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    offsets = F.broadcast(spark.createDataFrame(first, "part bigint, first bigint"))
    nodes = names.join(offsets, "part").select("name", (F.col("first") + F.col("at")).alias("id"))
    ends = e.join(nodes.toDF("source", "a"), "source").select("a", "target", (F.col("weight") >= STRONG_WEIGHT).alias("strong"))
    ends.join(nodes.toDF("target", "b"), "target").select("a", "b", "strong").write.parquet(f"{root}/edges")
    return nodes, spark.read.parquet(f"{root}/edges"), sum(n for _, n in sizes)


def columns(batch: pa.RecordBatch) -> list:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def reached(edges: DataFrame, hop: np.ndarray, step: int) -> np.ndarray:
    """Which nodes are met for the first time from those of hop ``step`` - 1; a bit a node goes around."""
    sent = edges.sparkSession.sparkContext.broadcast(hop)

    def work(batches):
        hop = sent.value
        new = np.zeros(-(-len(hop) // BITS) * BITS, bool)
        for batch in batches:
            a, b, _ = columns(batch)
            x, y = hop[a], hop[b]
            new[b[(x == step - 1) & (y == UNSEEN)]] = True
            new[a[(y == step - 1) & (x == UNSEEN)]] = True
        blocks = new.reshape(-1, BITS)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([np.packbits(blocks[i]).tobytes() for i in some], pa.binary())], names=["block", "bits"])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [bits.tobytes()]})

    found = edges.mapInArrow(work, "block bigint, bits binary").groupBy("block").applyInPandas(together, "block bigint, bits binary").toPandas()
    sent.destroy()
    out = np.zeros(-(-len(hop) // BITS) * BITS, bool)
    for k, bits in zip(found["block"], found["bits"]):
        out[k * BITS : (k + 1) * BITS] = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return out[: len(hop)]


def local_graphs(e: DataFrame, center: DataFrame, hops: tuple[int, ...], most: int = SHOWN) -> DataFrame:
    """GR14: hops, name, hop, degree, in_degree, out_degree, total of the neighbourhoods of ``center`` (one row: name) in the edges
    (source, target, weight; each pair once): ``hops`` (1 to FARTHEST) steps from nodes not seen before. Of more than ``most`` nodes the
    center and those of the largest 100 x strong edges + degree stay; degrees count the edges among the nodes that stay.
    One walk serves all ``hops``. Edges are shuffled for their numbers only; a byte for each node goes to the tasks."""
    spark, kind = e.sparkSession, "hops bigint, name string, hop bigint, degree bigint, in_degree bigint, out_degree bigint, total bigint"
    far = {h: max(1, min(h, FARTHEST)) for h in hops}
    start = center.select("name").first()
    if start is None:
        return spark.createDataFrame([], kind)
    nodes, edges, size = numbered(e, spark.createDataFrame([start], "name string"))
    hop = np.full(size, UNSEEN, np.uint8)
    middle = nodes.filter(F.col("name") == start["name"]).first()["id"]
    hop[middle] = 0
    for step in range(1, max(far.values()) + 1):
        new = reached(edges, hop, step)
        hop[new] = step
        if not new.any():
            break
    sent = spark.sparkContext.broadcast(hop)

    def weighed(batches):
        for batch in batches:
            a, b, strong = columns(batch)
            least = np.minimum(sent.value[a], sent.value[b])
            met = least < FARTHEST
            w = np.where(strong[met], 101, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([a[met], b[met]], [least[met].astype(np.int32)] * 2, [w, w])], names=["id", "least", "w"])

    of = edges.mapInArrow(weighed, "id bigint, least int, w bigint").filter(F.col("id") != middle)
    of = of.groupBy("id").agg(*[F.sum(F.when(F.col("least") < n, F.col("w"))).alias(f"w{n}") for n in sorted({*far.values()})])
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"w{far[h]}").alias("w")) for h in hops])).alias("x")
    order = Window.partitionBy("h").orderBy(F.desc("w"), "id")
    ranked = of.select("id", each).select("id", "x.h", "x.w").filter("w is not null").withColumn("n", F.row_number().over(order))
    kept = {h: [middle] for h in hops}
    for r in ranked.filter(F.col("n") < most).collect():
        kept[r["h"]].append(r["id"])

    def among(batches):
        for batch in batches:
            a, b, _ = columns(batch)
            least = np.minimum(sent.value[a], sent.value[b])
            for h, ids in kept.items():
                met = np.isin(a, ids) & np.isin(b, ids) & (least < far[h])
                if met.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(met.sum(), h)), pa.array(a[met]), pa.array(b[met])], names=["h", "a", "b"])

    left = [tuple(r) for r in edges.mapInArrow(among, "h bigint, a bigint, b bigint").collect()]  # of ``most`` nodes
    sent.destroy()
    outs, ins = Counter((h, a) for h, a, _ in left), Counter((h, b) for h, _, b in left)
    name = {r["id"]: r["name"] for r in nodes.filter(F.col("id").isin(sorted({i for ids in kept.values() for i in ids}))).collect()}
    rows = [(h, name[i], int(hop[i]), ins[h, i] + outs[h, i], ins[h, i], outs[h, i], int((hop <= far[h]).sum())) for h, ids in kept.items() for i in ids]
    return spark.createDataFrame(rows, kind)


#: From this weight on an edge is strong.
STRONG_WEIGHT = 3
HOPS = (1, 2, 9)


def _local_sql(hops: int) -> str:
    n = max(1, min(hops, FARTHEST))
    return f"""SELECT {hops} AS hops, * FROM (WITH RECURSIVE walk(name, hop) AS (SELECT name, 0 FROM center UNION SELECT und.b, hop + 1 FROM walk JOIN und ON und.a = walk.name WHERE hop < {n}),
 seen AS (SELECT name, min(hop) AS hop FROM walk GROUP BY name),
 met AS (SELECT DISTINCT source, target, weight FROM edges WHERE source IN (SELECT name FROM seen WHERE hop < {n}) OR target IN (SELECT name FROM seen WHERE hop < {n})),
 w AS (SELECT name, sum(CASE WHEN weight >= {STRONG_WEIGHT} THEN 100 ELSE 0 END) + count(*) AS w FROM (SELECT source AS name, weight FROM met UNION ALL SELECT target, weight FROM met) GROUP BY name),
 kept AS (SELECT name, hop FROM seen LEFT JOIN w USING (name) ORDER BY hop > 0, coalesce(w.w, 0) DESC, name LIMIT {SHOWN}),
 l AS (SELECT * FROM met WHERE source IN (SELECT name FROM kept) AND target IN (SELECT name FROM kept))
 SELECT name, CAST(hop AS BIGINT) AS hop, (SELECT count(*) FROM l WHERE l.source = kept.name) + (SELECT count(*) FROM l WHERE l.target = kept.name) AS degree, (SELECT count(*) FROM l WHERE l.target = kept.name) AS in_degree, (SELECT count(*) FROM l WHERE l.source = kept.name) AS out_degree, (SELECT count(*) FROM seen) AS total FROM kept)"""


@query("gr14_hops", "WITH und AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), center AS (SELECT min(source) AS name FROM edges WHERE weight >= 3) " + " UNION ALL ".join(f"SELECT CAST(hops AS BIGINT) AS hops, name, hop, degree, in_degree, out_degree, total FROM ({_local_sql(h)})" for h in HOPS), ALL + " edges")
def gr14_hops(spark, d):
    """GR14: neighbourhoods of one, two and nine (so five) hops, cut to forty nodes."""
    e = V.edges(spark, d)
    center = e.filter(F.col("weight") >= STRONG_WEIGHT).agg(F.min("source").alias("name")).filter("name is not null")
    return local_graphs(e, center, HOPS)


@query("tk07_graph_cut", "WITH und AS (SELECT source AS a, target AS b, weight FROM edges UNION ALL SELECT target, source, weight FROM edges), g AS (SELECT a AS name, count(*) AS degree, count(*) FILTER (WHERE weight >= 3) AS semantic FROM und GROUP BY a) SELECT name, degree, semantic FROM g ORDER BY semantic * 100 + degree DESC, name LIMIT 30", ALL + " edges")
def tk07(spark, d):
    """TK07: the thirty nodes of the largest 100 x strong edges + degree."""
    e = V.edges(spark, d)
    und = e.select(F.col("source").alias("name"), "weight").union(e.select("target", "weight"))
    g = und.groupBy("name").agg(F.count("*").alias("degree"), F.count(F.when(F.col("weight") >= 3, 1)).alias("semantic"))
    return g.orderBy(F.desc(F.col("semantic") * 100 + F.col("degree")), "name").limit(30)


@query("tk08_by_degree", "SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY name ORDER BY degree DESC, name LIMIT 50", ALL + " edges")
def tk08(spark, d):
    """TK08: the fifty nodes of highest degree, for display."""
    e = V.edges(spark, d)
    return e.select(F.col("source").alias("name")).union(e.select("target")).groupBy("name").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "name").limit(50)


@query("jn06_other_endpoint", "SELECT e.name, CASE WHEN e.name = g.source THEN g.target ELSE g.source END AS other, CASE WHEN e.name = g.source THEN 'out' ELSE 'in' END AS direction, g.weight FROM entities e JOIN edges g ON e.name = g.source OR e.name = g.target WHERE g.weight >= 2", ALL + " edges")
def jn06(spark, d):
    """JN06: the other endpoint of a node's edges; the OR becomes two equi-joins."""
    e = V.edges(spark, d).filter("weight >= 2")
    both = e.select(F.col("source").alias("name"), F.col("target").alias("other"), F.lit("out").alias("direction"), "weight").union(e.select("target", "source", F.lit("in"), "weight"))
    return both.join(V.entities(spark, d).select("name"), "name", "left_semi")


@query("jn07_live_links", "WITH link AS (SELECT id AS a, (id * 7 + 3) % (SELECT count(*) FROM files) AS b FROM files) SELECT a, b FROM link WHERE a IN (SELECT id FROM files WHERE NOT deleted) AND b IN (SELECT id FROM files WHERE NOT deleted)", "files")
def jn07(spark, d):
    """JN07: links both of whose files live."""
    f = V.files(spark, d).select("id", "deleted")
    live = f.filter("not deleted").select("id")
    n = f.agg(F.count("*").alias("n"))  # one row
    link = f.crossJoin(n).select(F.col("id").alias("a"), ((F.col("id") * 7 + 3) % F.col("n")).alias("b"))
    return link.join(live, F.col("a") == F.col("id"), "left_semi").join(live, F.col("b") == F.col("id"), "left_semi")


@query("jn08_backlinks", "WITH link AS (SELECT id AS a, (id * 7 + 3) % (SELECT count(*) FROM files) AS b FROM files) SELECT id, count(*) FILTER (WHERE way = 'in') AS incoming, count(*) FILTER (WHERE way = 'out') AS outgoing FROM (SELECT b AS id, 'in' AS way FROM link UNION ALL SELECT a, 'out' FROM link) GROUP BY id", "files")
def jn08(spark, d):
    """JN08: links into and out of each file."""
    f = V.files(spark, d).select("id")
    link = f.crossJoin(f.agg(F.count("*").alias("n"))).select(F.col("id").alias("a"), ((F.col("id") * 7 + 3) % F.col("n")).alias("b"))
    both = link.select(F.col("b").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(link.select("a", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


@query("pf10_display_filter", "SELECT source, target, weight FROM edges WHERE weight >= 2 AND source IN (SELECT name FROM entities WHERE type <> 'process') AND target IN (SELECT name FROM entities WHERE type <> 'process') AND NOT (source LIKE 'a%' AND target LIKE 'a%')", ALL + " edges")
def pf10(spark, d):
    """PF10: edges shown: a type and a kind of edge hidden, both endpoints present."""
    n = V.entities(spark, d).filter("type <> 'process'").select("name")
    e = V.edges(spark, d).filter("weight >= 2 and not (source like 'a%' and target like 'a%')")
    return e.join(n, F.col("source") == F.col("name"), "left_semi").join(n, F.col("target") == F.col("name"), "left_semi")


@query("gr10_uses_standard", "WITH m AS (SELECT DISTINCT a.name AS material, b.name AS standard FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id WHERE a.type = 'material' AND b.type = 'standard') SELECT material, standard FROM m EXCEPT SELECT source, target FROM edges WHERE weight >= 2", ALL + " edges")
def gr10(spark, d):
    """GR10: materials and standards of one chunk that no edge joins yet."""
    m = V.mentions(spark, d)
    a = m.filter("type = 'material'").select("chunk_id", F.col("name").alias("material"))
    b = m.filter("type = 'standard'").select("chunk_id", F.col("name").alias("standard"))
    have = V.edges(spark, d).filter("weight >= 2").select(F.col("source").alias("material"), F.col("target").alias("standard"))
    return a.join(b, "chunk_id").select("material", "standard").distinct().join(have, ["material", "standard"], "left_anti")


@query("gr15_entity_detail", "SELECT e.name, e.type, count(DISTINCT m.chunk_id) AS chunks, count(DISTINCT m.file_id) AS files, CAST(sum(m.mention_count) AS BIGINT) AS mentions, coalesce(any_value(g.degree), 0) AS degree FROM entities e JOIN mentions m USING (name) LEFT JOIN (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY name) g ON g.name = e.name GROUP BY e.name, e.type", ALL + " edges")
def gr15(spark, d):
    """GR15: an entity's card: chunks, files, mentions and degree."""
    e = V.edges(spark, d)
    degree = e.select(F.col("source").alias("name")).union(e.select("target")).groupBy("name").agg(F.count("*").alias("degree"))
    # a mention is one row of a chunk, so that only files need a set
    m = V.mentions(spark, d).groupBy("name", "type").agg(F.count("*").alias("chunks"), F.countDistinct("file_id").alias("files"), F.sum("mention_count").alias("mentions"))
    return m.join(degree, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


@query("gr06_bipartite_counts", "SELECT file_id, name, count(*) AS chunks, CAST(sum(mention_count) AS BIGINT) AS mentions FROM mentions GROUP BY file_id, name", ALL)
def gr06(spark, d):
    """GR06: entities and files with the counts of their links."""
    return V.mentions(spark, d).groupBy("file_id", "name").agg(F.count("*").alias("chunks"), F.sum("mention_count").alias("mentions"))


@query("gr11_standard_domain", "WITH cache AS (SELECT name, 'cached' AS domain FROM entities WHERE type = 'standard' AND name LIKE 'c%'), e AS (SELECT name FROM entities WHERE type = 'standard') SELECT e.name, coalesce(cache.domain, CASE WHEN regexp_matches(e.name, '^(in|un)') THEN 'prefix' WHEN regexp_matches(e.name, '^a') THEN 'letter' END, 'other') AS domain FROM e LEFT JOIN cache USING (name)", "chunks postings entities")
def gr11(spark, d):
    """GR11: a standard's domain from the cache, else by the first rule that fits its name, else 'other'."""
    e = V.entities(spark, d).filter("type = 'standard'").select("name")
    cache = e.filter("name like 'c%'").select("name", F.lit("cached").alias("cached"))
    rule = F.when(F.col("name").rlike("^(in|un)"), "prefix").when(F.col("name").rlike("^a"), "letter")
    return e.join(cache, "name", "left").select("name", F.coalesce("cached", rule, F.lit("other")).alias("domain"))


@query("gr18_query_entities", "SELECT DISTINCT q.qid, e.name, e.type FROM (SELECT DISTINCT qid, unnest(terms) AS name FROM questions) q JOIN entities e USING (name) WHERE e.type IN ('connector', 'material', 'standard', 'process', 'param')", "chunks postings questions entities")
def gr18(spark, d):
    """GR18: the entities that a query names, once each."""
    asked = V.questions(spark, d).select("qid", F.explode("terms").alias("name")).distinct()
    return V.entities(spark, d).join(asked, "name").select("qid", "name", "type").distinct()


@query("gr17_reclassify", "SELECT name, type AS old_type, CASE length(name) % 3 WHEN 0 THEN 'connector' ELSE type END AS new_type FROM entities WHERE (CASE length(name) % 3 WHEN 0 THEN 'connector' ELSE type END) <> type", "chunks postings entities")
def gr17(spark, d):
    """GR17: entities whose type a changed rule alters."""
    new = F.when(F.length("name") % 3 == 0, "connector").otherwise(F.col("type"))
    return V.entities(spark, d).select("name", F.col("type").alias("old_type"), new.alias("new_type")).filter("old_type <> new_type")


@query("jn04_entity_live_files", "SELECT m.name, count(DISTINCT f.id) AS files FROM mentions m LEFT JOIN files f ON f.id = m.file_id AND NOT f.deleted GROUP BY m.name", "files " + ALL)
def jn04(spark, d):
    """JN04: live files of each entity, the filter in the join's condition."""
    f = V.files(spark, d).filter("not deleted").select(F.col("id").alias("file_id"), F.lit(1).alias("live"))
    m = V.mentions(spark, d).select("name", "file_id").distinct()
    return m.join(f, "file_id", "left").groupBy("name").agg(F.count("live").alias("files"))


@query("jn13_mean_vector_pairs", "WITH v AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) SELECT CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b, round(sum(a.x * b.x), 6) AS dot FROM v a JOIN v b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
def jn13(spark, d):
    """JN13: each pair of mean vectors once (j > i)."""
    v = mean_vectors(spark, d)
    both = v.alias("a").join(v.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.label") < F.col("b.label")))
    return both.groupBy(F.col("a.label").cast("long").alias("a"), F.col("b.label").cast("long").alias("b")).agg(F.round(F.sum(F.col("a.x") * F.col("b.x")), 6).alias("dot"))


def mean_vectors(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))


@query("ag09_mean_vectors", "SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def ag09(spark, d):
    """AG09: mean vector of each group, by dimension."""
    return mean_vectors(spark, d).select(F.col("label").cast("long").alias("label"), F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("gr12_doc_similarity", "WITH v AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM v GROUP BY label) SELECT CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b, round(sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n) + 1e-9), 6) AS sim FROM v a JOIN v b ON a.i = b.i AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY a.label, b.label")
def gr12(spark, d):
    """GR12: cosine of mean vectors, one vector a label; long form, so any dimension works."""
    v = mean_vectors(spark, d)
    n = v.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    a, b = v.join(n, "label").alias("a"), v.join(n, "label").alias("b")
    both = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.label") < F.col("b.label")))
    g = both.groupBy(F.col("a.label").cast("long").alias("a"), F.col("b.label").cast("long").alias("b")).agg((F.sum(F.col("a.x") * F.col("b.x")) / (F.first("a.n") * F.first("b.n") + 1e-9)).alias("s"))
    return g.select("a", "b", F.round("s", 6).alias("sim"))


@query("so07_undirected_dedupe", "SELECT least(source, target) AS a, greatest(source, target) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT source, target, weight FROM edges UNION ALL SELECT target, source, weight FROM edges WHERE weight > 2) GROUP BY ALL", ALL + " edges")
def so07(spark, d):
    """SO07: undirected edges, once each."""
    e = V.edges(spark, d)
    both = e.union(e.filter("weight > 2").select("target", "source", "weight"))
    return both.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight"))


@query("ag15_file_entities", "SELECT file_id, type, string_agg(name, ',' ORDER BY n DESC, name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY file_id, type ORDER BY n DESC, name) AS r FROM (SELECT file_id, type, name, sum(mention_count) AS n FROM mentions GROUP BY file_id, type, name)) WHERE r <= 5 GROUP BY file_id, type", ALL)
def ag15(spark, d):
    """AG15: a file's leading entities by type."""
    g = V.mentions(spark, d).groupBy("file_id", "type", "name").agg(F.sum("mention_count").alias("n"))
    w = Window.partitionBy("file_id", "type").orderBy(F.desc("n"), "name")
    top = g.withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return top.groupBy("file_id", "type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("names"))
