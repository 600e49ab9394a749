"""An inverted file over vectors: cells around trained centroids, rows stored by cell as coded residuals, a search of the
cells next to each query.

Training takes rounds of two steps, each a DataFrame: rows of a sample (SAMPLE rows at most, a documented bound) to their
nearest centroid, and the mean of each cell. Every row is indexed. A row is stored as the difference from its centroid in one
byte a dimension; the best of these estimates are compared again by their exact cosine. Centroids, of which there are CELLS
at most, go to the tasks; a cell of very many rows is cut into blocks, so that no task holds it whole.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dot, doubles, first_of
from ..registry import query
from ..session import shared_dir, table
from .retrieval import VEC, nearest_vectors, ranked

#: Cells at most, cells for the square root of the rows, training rounds, rows that train at most.
CELLS, PER_ROOT, ROUNDS, SAMPLE = 4096, 4, 3, 262_144
#: Share of the cells that a query probes, and how much more for the share of all rows that it wants; estimates kept for each
#: result; rows of a cell, and queries, that meet in one group.
PROBED, WANTED, KEPT, BLOCK = 0.45, 3, 4, 16_384
_built: dict[tuple, tuple[str, np.ndarray, int]] = {}


def probes(cells: int, rows: int, k: int) -> int:
    return max(1, min(cells, math.ceil(cells * (PROBED + WANTED * k / max(rows, 1)))))


def unit(v) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """id and unit vector of each row; those without a direction are in no index."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"))
    return v.select("id", unit(F.col("v")).alias("v")).filter("v is not null and not exists(v, x -> x is null or isnan(x))")


def shuffled(id_col: str) -> list[Column]:
    """An order of rows that has nothing to do with their vectors."""
    return [F.md5(F.col(id_col).cast("string")), F.col(id_col)]


def near_cells(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """rows (id, v) with the n cells nearest to each, best first."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # CELLS rows at most
    kinds = dict(rows.dtypes)

    def work(batches):
        for b in batches:
            if not len(b):
                continue
            score = np.vstack(b["v"].to_numpy()) @ sent.value.T
            order = score.argmax(1)[:, None] if n == 1 else np.argsort(-score, axis=1, kind="stable")[:, :n]
            yield b.assign(cells=list(order.astype(np.int32)))

    return rows.mapInPandas(work, f"id {kinds['id']}, v array<double>, cells array<int>")


def train(rows: DataFrame, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids (to 6 places): the rows of the least digests at first, then the directions of their cells' means."""
    cells = max(1, min(CELLS, math.ceil(PER_ROOT * math.sqrt(n))))
    sample = rows.orderBy(*shuffled("id")).limit(SAMPLE) if n > SAMPLE else rows
    first = rows.orderBy(*shuffled("id")).limit(cells).select("v").toPandas()  # CELLS rows at most
    centroids = np.round(np.vstack(first["v"].to_numpy()), 6) if len(first) else np.empty((0, 1))
    for _ in range(rounds if len(first) else 0):
        met = near_cells(sample, centroids, 1).select(F.col("cells")[0].alias("cell"), array_to_vector("v").alias("x"))
        means = met.groupBy("cell").agg(vector_to_array(Summarizer.mean(F.col("x"))).alias("m")).toPandas()  # one row a cell
        m = np.vstack(means["m"].to_numpy())
        centroids[means["cell"].to_numpy()] = np.round(m / np.linalg.norm(m, axis=1, keepdims=True), 6)
    return centroids


def coded(b: pd.DataFrame, centroids: np.ndarray) -> pd.DataFrame:
    """Rows (id, v, cells) as cell, id, low, step and one byte a dimension of the residual."""
    cell = np.array([c[0] for c in b["cells"]], np.int32)
    rest = np.vstack(b["v"].to_numpy()) - centroids[cell]
    low = rest.min(1)
    step = np.maximum((rest.max(1) - low) / 255, 1e-12)
    codes = np.rint((rest - low[:, None]) / step[:, None]).astype(np.uint8)
    return pd.DataFrame({"cell": cell, "id": b["id"], "low": low, "step": step, "codes": [c.tobytes() for c in codes]})


def build(spark: SparkSession, d: str) -> tuple[str, np.ndarray, int]:
    """The folder of the lists, the centroids and the number of rows; built once a session for the same files."""
    key = (spark.sparkContext.applicationId, tuple(sorted(table(spark, d, "embeddings").inputFiles())))
    if key not in _built:
        rows = vectors(spark, d)
        n = rows.count()
        centroids = train(rows, n)
        path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/cells-{uuid.uuid4().hex}"
        kind = dict(rows.dtypes)["id"]
        sent = spark.sparkContext.broadcast(centroids)
        lists = near_cells(rows, centroids, 1).mapInPandas(lambda bs: (coded(b, sent.value) for b in bs if len(b)), f"cell int, id {kind}, low double, step double, codes binary")
        # by ranges of cell and id: cells lie together, and a large one in several tasks
        lists.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(path)
        _built[key] = path, centroids, n
    return _built[key]


def search(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    """qid, id, score (6 places), rank of the k best rows of each query (id, v) in the cells that it probes."""
    path, centroids, n = build(spark, d)
    lists = spark.read.parquet(path)
    blocks = lists.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    some = F.pmod(F.xxhash64("id"), F.ceil(F.lit(max(1, queries.count())) / BLOCK)).cast("int")
    asked = near_cells(queries, centroids, probes(len(centroids), n, k)).select(F.col("id").alias("qid"), "v", F.explode("cells").alias("cell"), some.alias("share"))
    asked = asked.join(blocks, "cell").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    shares = asked.select("cell", "block", "share").distinct()
    rows = lists.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(shares, ["cell", "block"])
    sent, most = spark.sparkContext.broadcast(centroids), KEPT * k
    kinds = f"qid {dict(queries.dtypes)['id']}, id {dict(lists.dtypes)['id']}, guess double"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "id": [], "guess": []})
        c = sent.value[int(a["cell"].iloc[0])]
        rest = np.frombuffer(b"".join(a["codes"]), np.uint8).reshape(len(a), -1) * a["step"].to_numpy()[:, None] + a["low"].to_numpy()[:, None]
        guess = np.vstack(b["q_v"].to_numpy()) @ (rest + c).T
        keep = np.argpartition(-guess, min(most, len(a)) - 1, axis=1)[:, :most]
        return pd.DataFrame({"qid": np.repeat(b["q_qid"].to_numpy(), keep.shape[1]), "id": a["id"].to_numpy()[keep.ravel()], "guess": np.take_along_axis(guess, keep, 1).ravel()})

    by = ("cell", "block", "share")
    left, right = rows.toDF(*rows.columns), asked.toDF(*(f"q_{c}" for c in asked.columns))
    guessed = left.groupBy(*by).cogroup(right.groupBy(*(f"q_{c}" for c in by))).applyInPandas(meet, kinds)
    best = first_of(guessed, ["qid"], [F.desc("guess"), "id"], most)
    v = vectors(spark, d)
    exact = best.select("qid", "id").join(v, "id").join(queries.select(F.col("id").alias("qid"), F.col("v").alias("q")), "qid")
    return ranked(exact.select("qid", "id", F.round(dot(F.col("v"), F.col("q")), 6).alias("score")), limit=k)


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: ids divisible by 50."""
    return vectors(spark, d).filter("id % 50 = 0")


def _rounds_sql() -> str:
    out = f"u AS MATERIALIZED (SELECT vec_id AS id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) WHERE list_dot_product(v, v) > 0),\nsize AS (SELECT CAST(greatest(1, least({CELLS}, ceil({PER_ROOT} * sqrt(count(*))))) AS BIGINT) AS cells, count(*) AS rows FROM u),\nc0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS cell, list_transform(v, lambda x: round(x, 6)) AS c FROM u QUALIFY cell < (SELECT cells FROM size)),\n"
    for i in range(ROUNDS):
        out += f"""a{i} AS MATERIALIZED (SELECT id, v, cell FROM (SELECT id, v, cell, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, c) DESC, cell) AS n FROM u, c{i}) WHERE n = 1),
m{i} AS (SELECT cell, d, avg(x) AS x FROM (SELECT cell, unnest(range(0, len(v))) AS d, unnest(v) AS x FROM a{i}) GROUP BY cell, d),
n{i} AS (SELECT cell, list(round(x / norm, 6) ORDER BY d) AS c FROM (SELECT cell, d, x, sqrt(sum(x * x) OVER (PARTITION BY cell)) AS norm FROM m{i}) GROUP BY cell),
c{i + 1} AS MATERIALIZED (SELECT cell, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (cell)),
"""
    return out + f"""own AS MATERIALIZED (SELECT id, v, cell FROM (SELECT id, v, cell, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, c) DESC, cell) AS n FROM u, c{ROUNDS}) WHERE n = 1),
probe AS MATERIALIZED (SELECT id AS qid, v AS q, cell FROM u, c{ROUNDS} WHERE id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, c) DESC, cell) <= (SELECT greatest(1, least(cells, ceil(cells * ({PROBED}::DOUBLE + {WANTED} * 50.0::DOUBLE / rows)))) FROM size)),
found AS (SELECT qid, id, round(list_dot_product(v, q), 6) AS score FROM probe JOIN own USING (cell)),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM found QUALIFY rank <= 50)"""


INDEX_SQL = f"WITH {_rounds_sql()}"


@query("rt08_index", f"{INDEX_SQL} SELECT qid, id, score, rank FROM top")
def rt08_index(spark: SparkSession, d: str) -> DataFrame:
    """RT08, TK02: the 50 nearest by the inverted file."""
    return search(spark, d, asked_vectors(spark, d), 50)


@query("rt08_index_recall", f"{INDEX_SQL}, {VEC.removeprefix("WITH ")}, exact AS (SELECT qid, id FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 50) SELECT e.qid, count(*) AS nearest, count(top.id) AS found, (SELECT count(*) FROM probe p JOIN own USING (cell) WHERE p.qid = e.qid) AS rows_read FROM exact e LEFT JOIN top ON top.qid = e.qid AND top.id = e.id GROUP BY e.qid")
def rt08_recall(spark: SparkSession, d: str) -> DataFrame:
    """RT08: of the 50 exactly nearest of each query, how many the index finds, and how many rows it reads for that."""
    exact = ranked(nearest_vectors(spark, d, 50), limit=50).select("qid", "id")
    got = rt08_index(spark, d).select("qid", "id", F.lit(1).alias("hit"))
    found = exact.join(got, ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("nearest"), F.count("hit").alias("found"))
    path, centroids, n = build(spark, d)
    sizes = spark.read.parquet(path).groupBy("cell").agg(F.count("*").alias("rows"))
    probed = near_cells(asked_vectors(spark, d), centroids, probes(len(centroids), n, 50))
    read = probed.select(F.col("id").alias("qid"), F.explode("cells").alias("cell")).join(sizes, "cell").groupBy("qid").agg(F.sum("rows").alias("rows_read"))
    return found.join(read, "qid")
