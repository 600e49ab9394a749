"""Files of unknown encoding as text."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def is_binary(content: bytes, head: int = 8192, share: float = 0.05) -> bool:
    """SC03: more than ``share`` of the first ``head`` bytes are 0."""
    first = content[:head]
    return first.count(0) > share * len(first)


def decode(content: bytes | None) -> str | None:
    """SC02: UTF-8, else GB 18030, else UTF-16, else UTF-8 with replacement marks; null stays null."""
    if content is None:
        return None
    for name in ("utf-8", "gb18030", "utf-16"):
        try:
            return content.decode(name)
        except UnicodeError:
            continue
    return content.decode("utf-8", "replace")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, text, rejected: every file below ``folder``; binary ones are kept as rejected rows without a text.
    Spark's scan leaves out files of no bytes."""

    @F.pandas_udf("text string, rejected boolean")
    def parse(content: pd.Series) -> pd.DataFrame:
        bad = content.map(is_binary)
        return pd.DataFrame({"text": [None if b else decode(c) for c, b in zip(content, bad)], "rejected": bad.astype(bool)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", parse("content").alias("p")).select("path", "p.text", "p.rejected")


def csv_lines(text: str | None) -> list[str]:
    """SC04: rows of a CSV text as tab-separated col=value; the separator is the one of , ; tab | that the first line has
    most of. Empty cells are left out, cells beyond the header stand without a name; null and empty texts have no rows."""
    rows = [r for r in csv.reader(io.StringIO(text or ""), delimiter=max(",;\t|", key=(text or "").split("\n", 1)[0].count)) if any(r)]
    names = rows[0] if rows else []
    return ["\t".join([f"{names[i]}={c}" if i < len(names) else c for i, c in enumerate(r) if c]) for r in rows[1:]]
