"""Continuous forms: folder ingest, sliding metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("txt", "md", "html", "csv")) -> DataFrame:
    """SC19: files as they appear; the checkpoint remembers what was seen."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    return files.select("path", "modificationTime", "length", F.sha2(F.col("content"), 256).alias("content_hash"), "content")


def ingest(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """ST07, SC13: micro-batches handed to ``store``; a batch that is repeated after a failure has the same number."""
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_counts(events: DataFrame, span: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """ST01: events by sliding window, late ones within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", span, slide), "event_type").agg(F.count("*").alias("n"))
