"""Session helpers: a tuned local session, table reads, lineage cuts in the shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local one, for one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(told)
    return told


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder (a reliable checkpoint), its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df`` as a table of the driver, marked for broadcast, if it has ``most`` rows at most, else ``df``."""
    rows = df.limit(most + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows)) if rows.num_rows <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
