"""Whitening of vectors by the eigenvectors of their covariance.

Components of the vectors become whole numbers, so that counts, sums and differences from the mean are exact. The rows
less their mean go to a ``RowMatrix``, whose Gramian over n is the covariance; its eigenvectors are found on the driver
(a matrix of dimensions, not of rows) and sent to the tasks, which project their rows in Arrow batches. A second Gramian,
of the projected rows, tells how far from the identity their covariance is.

Defined results: null vectors, empty ones and those with a null or non-finite entry are dropped, and so are vectors of
another length than most have (of equally many, the longer ones stay); entries beyond 2^20 either way count as that;
repeated vectors count each time, rows that share an id or have none are rows of their own; where there are fewer
directions with variance than components asked for, only those are returned, none for a single or all equal vectors;
an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: An entry c counts as the whole number floor(c * SCALE) + OFFSET.
SCALE, OFFSET, BOUND = 1024, 100_000, float(1 << 20)
#: Directions with a smaller share of the largest variance have none, but for rounding.
FLAT = 1e-12
KINDS = "n long, deviation decimal(38,0), component int, whitened double, explained double, identity_error double"


def whole_numbers(vector: str) -> Column:
    """The entries of a vector as whole numbers; null for vectors that are dropped."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(v, lambda c: F.floor(F.least(F.greatest(c, F.lit(-BOUND)), F.lit(BOUND)) * SCALE).cast("long") + OFFSET)
    return F.when((F.size(v) > 0) & ~bad, whole)


def fit_list(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, list[int]]:
    """id and x (whole numbers) of the remaining vectors, their number, and the sums of their dimensions."""
    rows = df.select(F.col(id_col).alias("id"), whole_numbers(vector_col).alias("x")).filter("x is not null")
    most = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return rows, 0, []
    rows = rows.filter(F.size("x") == most["d"])
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect()  # one row a dimension
    return rows, most["n"], [r["s"] for r in sorted(sums, key=lambda r: r["i"])]


def covariance(rows: DataFrame, centred: Column, n: int) -> np.ndarray:
    """The Gramian of the rows' ``centred`` arrays, over n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def eigen(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of at most ``most`` directions with variance; an eigenvector's
    largest entry is positive."""
    value, vector = np.linalg.eigh((cov + cov.T) / 2)
    value, vector = value[::-1], vector[:, ::-1]
    keep = min(most, int(np.count_nonzero(value > FLAT * max(value[0], 0)))) if len(value) else 0
    vector = vector[:, :keep]
    return value[:keep], vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(keep)])


def deviations(centred: np.ndarray) -> list[int]:
    """The exact sums of squares of rows of whole numbers."""
    most = int(np.abs(centred).max(initial=0))
    if most * most * centred.shape[1] < 1 << 62:
        return np.einsum("ij,ij->i", centred, centred).tolist()
    return [sum(v * v for v in row) for row in centred.tolist()]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """id_col, n, deviation (exact, of (n x - S)^2 over all dimensions), component (from 1), whitened, explained (share of the
    variance) and identity_error, for each remaining row and component."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows, n, sums = fit_list(df, id_col, vector_col)
    empty = spark.createDataFrame([], f"`{id_col}` {kind}, {KINDS}")
    if n < 2:
        return empty
    # n x - S is a whole number: one rounding, when it is divided by n
    total = F.array(*[F.lit(s).cast("long") for s in sums])
    centred = F.zip_with("x", total, lambda x, s: (x * F.lit(n) - s).cast("double") / F.lit(float(n)))
    cov = covariance(rows, centred, n)
    value, vector = eigen(cov, components)
    if not len(value):
        return empty
    # dimensions times components, whatever the number of rows
    sent = spark.sparkContext.broadcast((np.array(sums, np.int64), vector / np.sqrt(value)))

    def project(batches):
        s, to = sent.value
        for b in batches:
            whole = np.vstack(b["x"].to_numpy()).astype(np.int64) * n - s if len(b) else np.empty((0, len(s)), np.int64)
            yield pd.DataFrame({"id": b["id"], "deviation": [Decimal(v) for v in deviations(whole)], "w": list((whole / n) @ to)})

    done = cut(rows.mapInPandas(project, f"id {kind}, deviation decimal(38,0), w array<double>"))
    k = len(value)
    mean = done.agg(*[F.avg(F.element_at("w", i + 1)).alias(f"m{i}") for i in range(k)]).first()
    around = F.zip_with("w", F.array(*[F.lit(m) for m in mean]), lambda w, m: w - m)
    error = float(np.abs(covariance(done, around, n) - np.eye(k)).max())
    share = F.array(*[F.lit(float(v)) for v in value / np.trace(cov)])
    out = done.select("id", "deviation", F.posexplode(F.arrays_zip(F.col("w").alias("w"), share.alias("share"))).alias("i", "c"))
    return out.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", (F.col("i") + 1).alias("component"), F.col("c.w").alias("whitened"), F.col("c.share").alias("explained"), F.lit(error).alias("identity_error"))
