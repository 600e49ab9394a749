"""Vectors, tests of texts, point ladders and cuts by rank, as Columns and DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubles(c) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Null for null vectors, 0 where one has no length."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def any_of(text, words) -> Column:
    """Whether a text holds one of some words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def ladder(value, *steps: tuple[float, int], rest: int = 0) -> Column:
    """The points of the first step (least value, points) that a value reaches."""
    out = F
    for least, points in steps:
        out = out.when(value >= least, points)
    return out.otherwise(rest)


def first_of(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n of each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
