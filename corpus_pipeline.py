"""From raw documents to packed training sequences: language ID, line, near and substring deduplication, packing.

Each stage works on all its predecessor kept. Every stage but the last returns the columns of documents; ``n_chars``
follows the text wherever a stage changes it.

Defined results: null, empty and letterless texts go in the first stage; texts of any length are taken whole; of ties the
smaller id stays; rows without an id are documents of their own, which only the first stage and the packing touch; an
empty table gives an empty result; columns other than those of documents are left out, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_dedup, minhash, packing, phrase_dedup, shards
from tessera.session import table

#: A document goes when the mean probability of its best language is below this: its bytes don't read as any.
LEAST_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (also null texts) and those that read as no learned language."""
    net = language_id.learn(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    named = language_id.predict(docs, net, COLUMNS)
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, and documents of which no line is left."""
    out = line_dedup.without_lines(docs.select(*COLUMNS), line_dedup.repeated_lines(docs))
    left = out.filter((F.col("dropped") == 0) | F.col("row.text").rlike(r"[\p{L}\p{N}]"))
    return left.select("row.*", "dropped").withColumn("n_chars", F.when(F.col("dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, and of rows that share an id one; rows without an id all stay."""
    kept = minhash.near_duplicates(docs).filter("kept").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"))
    both = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")))
    once = both.filter((F.col("_rows") == 1) | F.col("doc_id").isNull())
    return once.select(*COLUMNS).union(both.filter((F.col("_rows") > 1) & F.col("doc_id").isNotNull()).select(*COLUMNS).dropDuplicates(["doc_id"]))


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring passages out of the texts; documents that consist of nothing else go."""
    length = 35
    told = shards.told_apart(docs.select(*COLUMNS), "doc_id", "text")
    spans = phrase_dedup.spans_of_texts(told.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), "_tie"), length)
    both = shards.with_spans(told, spans, "doc_id")
    at = COLUMNS.index("text")

    def work(batches):
        for b in batches:
            texts, keep, size = [], [], []
            for text, spans, n in zip(b.column(at).to_pylist(), b.column(len(COLUMNS)).to_pylist(), b.column(COLUMNS.index("n_chars")).to_pylist(), strict=True):
                if spans:
                    text = phrase_dedup.cut_out(text, [(s["start"], s["start"] + s["windows"] + length - 1) for s in spans])
                    n = len(text)
                texts.append(text)
                size.append(n)
                keep.append(not spans or bool(text.strip()))
            cols = list(b.columns[: len(COLUMNS)])
            cols[at], cols[COLUMNS.index("n_chars")] = pa.array(texts, pa.string()), pa.array(size, pa.int64())
            yield pa.RecordBatch.from_arrays(cols, COLUMNS).filter(pa.array(keep, pa.bool_()))

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in COLUMNS)
    return both.select(*COLUMNS, "_spans").mapInArrow(work, kinds)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", identify_language), ("line dedup", dedup_lines), ("MinHash near-dedup", dedup_near), ("substring dedup", dedup_substrings), ("packing", pack)]

#: Trained, hashed and packed stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.session import cut

    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
