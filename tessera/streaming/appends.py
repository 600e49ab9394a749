"""Appends that are safe to repeat: what a micro-batch writes lies in a partition of its number, and counts once it is logged.

A batch that comes again after a failure overwrites its own partition, and no other. A reader takes the partitions that the
log names, so it never sees half of a batch. What a batch writes is in proportion to its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class BatchLog:
    """Tables in one folder that grow by batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _write(self, name: str, df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/{name}")

    def write(self, number: int, **tables: DataFrame) -> None:
        """The rows of a batch for each table, then its line in the log. A table that gets no row keeps no partition of an
        earlier attempt either: the log's counts tell."""
        for name, df in tables.items():
            self._write(name, df, number)
        line = ", ".join(f"'{n}'" for n in tables)
        self._write("log", self.spark.sql(f"SELECT explode(array({line})) AS name"), number)

    def committed(self) -> DataFrame:
        return self.spark.read.schema("name string, batch long").parquet(f"{self.root}/log")

    def read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """The rows of the committed batches, or of those ``before`` a number."""
        if not self._there(name):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        done = self.committed().filter(F.col("name") == name).select("batch")
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{name}").join(F.broadcast(done), "batch", "left_semi")  # a number a batch
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _there(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def latest(self, name: str, schema: str, keys: list[str]) -> DataFrame:
        """The row of each key that the last batch wrote."""
        w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        return self.read(name, schema).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "batch")


def continued(rows: DataFrame, ends: DataFrame, key: str, order: list[str], index: str) -> DataFrame:
    """``rows`` with a running ``index`` in each key, from where the earlier batches left it (``ends``: key, last)."""
    last = ends.groupBy(key).agg(F.max("last").alias("_last"))
    w = Window.partitionBy(key).orderBy(*order)
    return rows.join(last, key, "left").withColumn(index, F.coalesce("_last", F.lit(-1)).cast("long") + F.row_number().over(w)).drop("_last")
