"""Sinks: tables that are written, merged and read back.

A table is Parquet in the shared folder; a change writes the next version beside it and then points to it, so that a
reader never sees half of a change and a lost executor's part is written again. Changes are joins and aggregations of
whole tables; nothing is looked up row by row.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import views as V
from ..registry import query
from ..session import shared_dir, table


class Store:
    """Named tables of one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.at = spark, f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}", {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """The table's next version; the one before stays readable for queries that have begun."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.at[name] = path
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.at[name])

    def append(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.at:
            return self.put(name, df)
        df.write.mode("append").parquet(self.at[name])
        return self.get(name)

    def upsert(self, name: str, changes: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of ``changes`` (one for each key) take the place of those with their keys."""
        old = self.get(name)
        return self.put(name, old.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*old.columns)))

    def upsert_sum(self, name: str, changes: DataFrame, keys: list[str]) -> DataFrame:
        """Numbers add up under their keys; sums combine before the shuffle."""
        old = self.get(name)
        rest = [c for c in old.columns if c not in keys]
        return self.put(name, old.unionByName(changes.select(*old.columns)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rest)).select(*old.columns))

    def upsert_columns(self, name: str, changes: DataFrame, keys: list[str]) -> DataFrame:
        """Columns of ``changes`` that aren't null overwrite the old ones; new keys are added."""
        old = self.get(name)
        rest = [c for c in old.columns if c not in keys]
        new = changes.select(*keys, *(F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys))
        value = lambda c: F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in new.columns else F.col(c)
        return self.put(name, old.join(new, keys, "full").select(*keys, *(value(c) for c in rest)).select(*old.columns))

    def insert_new(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows whose keys the table doesn't have; further rows of a key within ``rows`` are ignored."""
        old = self.get(name)
        return self.append(name, rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> DataFrame:
        return self.put(name, self.get(name).join(gone.select(*keys), keys, "left_anti"))

    def update(self, name: str, **columns) -> DataFrame:
        return self.put(name, self.get(name).withColumns(columns))


def count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("relation"), F.count("*").alias("n"))


@query("sk01_insert_with_index", "SELECT file_id, count(*) AS chunks, (SELECT count(*) FROM postings p WHERE p.file_id = c.file_id) AS postings, min(id) AS first_id FROM chunks c GROUP BY file_id", "chunks postings")
def sk01(spark, d):
    """SK01: chunks inserted with their index, ids returned; read back from both tables."""
    s = Store(spark)
    rows = s.put("chunks", V.chunks(spark, d).select("id", "file_id", "content"))
    s.put("index", rows.select("id", "file_id", F.explode(V.tokens(F.col("content"))).alias("term")).groupBy("id", "file_id", "term").agg(F.count("*").alias("tf")))
    of = s.get("index").groupBy("file_id").agg(F.count("*").alias("postings"))
    held = s.get("chunks").groupBy("file_id").agg(F.count("*").alias("chunks"), F.min("id").alias("first_id"))
    return held.join(of, "file_id", "left").withColumn("postings", F.coalesce("postings", F.lit(0)))


def labels_of(spark, d) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).dropDuplicates(["doc_id"])


@query("sk02_upsert_table", "SELECT custkey, CASE WHEN custkey % 3 = 0 THEN n + 100 ELSE n END AS n FROM (SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT -1, 100")
def sk02(spark, d):
    """SK02: rows replaced by key, new ones added, in a written table."""
    s = Store(spark)
    base = s.put("t", table(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("custkey")).agg(F.count("*").alias("n")))
    new = spark.createDataFrame([(-1, 100)], "custkey long, n long")
    return s.upsert("t", base.filter("custkey % 3 = 0").withColumn("n", F.col("n") + 100).union(new), ["custkey"])


@query("sk03_upsert_sum", "SELECT o_custkey AS custkey, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM orders WHERE o_custkey <> o_orderkey GROUP BY 1")
def sk03(spark, d):
    """SK03: counts and weights that add up over two batches; self-loops are dropped."""
    s = Store(spark)
    o = table(spark, d, "orders").filter("o_custkey <> o_orderkey")
    part = lambda rest, w: o.filter(f"o_orderkey % 2 = {rest}").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n")).withColumn("weight", F.col("n") * w)
    s.put("t", part(1, 1))
    return s.upsert_sum("t", part(0, 2), ["custkey"])


@query("sk04_upsert_columns", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS segment, round(c_acctbal, 2) AS balance FROM customer")
def sk04(spark, d):
    """SK04: some columns of known keys overwritten, the others kept."""
    s = Store(spark)
    c = s.put("t", table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 2).alias("balance")))
    return s.upsert_columns("t", c.filter("id % 5 = 0").select("id", F.lit("new").alias("segment")), ["id"])


@query("sk05_upsert_tasks", "SELECT user_id AS task_id, max_by(event_type, event_id) AS status, max(event_id) AS record FROM events GROUP BY user_id")
def sk05(spark, d):
    """SK05: task records written in two batches; the later record of a task stays."""
    s = Store(spark)
    e = table(spark, d, "events")
    latest = lambda df: df.groupBy(F.col("user_id").alias("task_id")).agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("record"))
    half = e.agg((F.max("event_id") / 2).alias("h"))  # one row
    both = e.crossJoin(half)
    s.put("t", latest(both.filter("event_id <= h")))
    return s.upsert("t", latest(both.filter("event_id > h")), ["task_id"])


@query("sk06_bin", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN NOT deleted THEN 'live' WHEN id % 34 = 0 THEN 'live' ELSE 'bin' END AS state, * FROM files) WHERE state = 'live' OR authority < 3 GROUP BY state", "files")
def sk06(spark, d):
    """SK06: soft delete, restore and purge on a written table; authority stands for the days in the bin."""
    s = Store(spark)
    s.put("files", V.files(spark, d).select("id", "authority", F.lit(False).alias("deleted")))
    s.update("files", deleted=F.col("id") % 17 == 0)
    s.update("files", deleted=F.col("deleted") & (F.col("id") % 34 != 0))
    s.put("files", s.get("files").filter("not deleted or authority < 3"))
    return s.get("files").groupBy(F.when(F.col("deleted"), "bin").otherwise("live").alias("state")).agg(F.count("*").alias("n"))


@query("sk07_cascade", "SELECT 'files' AS relation, count(*) AS n FROM files WHERE id % 10 <> 0 UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE file_id % 10 <> 0 UNION ALL SELECT 'postings', count(*) FROM postings WHERE file_id % 10 <> 0 UNION ALL SELECT 'mentions', count(*) FROM mentions WHERE file_id % 10 <> 0 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id % 10 <> 0 UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id % 10 <> 0", "files chunks postings entities mentions")
def sk07(spark, d):
    """SK07: files deleted for good with their rows of five relations."""
    s = Store(spark)
    held = {"files": (V.files(spark, d).select("id"), "id"), "chunks": (V.chunks(spark, d).select("id", "file_id"), "file_id"), "postings": (V.postings(spark, d).select("id", "file_id", "term"), "file_id"), "mentions": (V.mentions(spark, d).select("chunk_id", "file_id", "name"), "file_id"), "labels": (table(spark, d, "labels").select("doc_id"), "doc_id"), "vectors": (table(spark, d, "embeddings").select("vec_id"), "vec_id")}
    gone = V.files(spark, d).filter("id % 10 = 0").select("id")
    left = []
    for name, (df, key) in held.items():
        s.put(name, df)
        # a label or a vector whose file isn't there goes by its own number
        ids = gone if name not in ("labels", "vectors") else df.select(F.col(key).alias("id")).filter("id % 10 = 0").distinct()
        left.append(count(s.delete(name, ids.select(F.col("id").alias(key)), [key]), name))
    return reduce(DataFrame.union, left)


@query("sk08_vectors", "SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN -CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END, 6) AS head FROM embeddings WHERE vec_id % 7 <> 0")
def sk08(spark, d):
    """SK08: vectors upserted in Parquet batches of at most 4000 rows, then deleted by id."""
    s = Store(spark)
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    spark_rows = v.filter("vec_id % 3 = 0").select("vec_id", F.transform("v", lambda x: -x).alias("v"))
    s.put("v", v)
    old = s.get("v")
    path = f"{s.root}/v/{uuid.uuid4().hex}"
    old.join(spark_rows.select("vec_id"), "vec_id", "left_anti").union(spark_rows).write.option("maxRecordsPerFile", 4000).parquet(path)
    s.at["v"] = path
    return s.delete("v", old.filter("vec_id % 7 = 0").select("vec_id"), ["vec_id"]).select("vec_id", F.round(F.col("v")[0], 6).alias("head"))


@query("sk10_feedback", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'view') AND NOT (event_type = 'view' AND user_id % 4 = 0)")
def sk10(spark, d):
    """SK10: feedback added twice counts once; some of it is taken back."""
    s = Store(spark)
    e = table(spark, d, "events").filter("event_type in ('click', 'view')").select("user_id", "event_type")
    s.put("f", e.limit(0))
    s.insert_new("f", e, ["user_id", "event_type"])
    s.insert_new("f", e, ["user_id", "event_type"])
    return s.delete("f", e.filter("event_type = 'view' and user_id % 4 = 0").distinct(), ["user_id", "event_type"])


@query("sk11_permissions", "SELECT id AS file_id, 'u' || (id % 3) AS principal, CASE WHEN id % 2 = 0 THEN 'write' ELSE 'read' END AS level FROM files", "files")
def sk11(spark, d):
    """SK11: a principal's permission on a file set anew: the old one goes, the new one is inserted."""
    s = Store(spark)
    p = s.put("p", V.files(spark, d).select(F.col("id").alias("file_id"), F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("principal"), F.lit("read").alias("level")))
    new = p.filter("file_id % 2 = 0").withColumn("level", F.lit("write"))
    s.delete("p", new, ["file_id", "principal"])
    return s.append("p", new)


@query("sk12_audit", "SELECT event_type AS action, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def sk12(spark, d):
    """SK12: an audit that is only ever appended to, in three batches."""
    s = Store(spark)
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("action"))
    for part in range(3):
        s.append("audit", e.filter(f"event_id % 3 = {part}"))
    return s.get("audit").groupBy("action").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("sk14_file_updates", "SELECT f.id, f.category || '!' AS category, CAST(len(string_split(f.folder, '/')) AS BIGINT) AS depth, (SELECT count(*) FROM chunks c WHERE c.file_id = f.id) AS chunk_count FROM files f", "files chunks")
def sk14(spark, d):
    """SK14: a file's category, folder depth and chunk count written back to the table."""
    s = Store(spark)
    s.put("files", V.files(spark, d).select("id", "category", "folder", F.lit(0).cast("long").alias("chunk_count")))
    s.update("files", category=F.concat("category", F.lit("!")), depth=F.size(F.split("folder", "/")).cast("long"))
    counts = V.chunks(spark, d).groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    return s.upsert_columns("files", counts, ["id"]).select("id", "category", "depth", "chunk_count")


@query("sk15_conversations", "SELECT conv_id, count(*) + 1 AS messages, 'chat ' || conv_id AS title FROM conversations WHERE conv_id % 9 <> 0 GROUP BY conv_id")
def sk15(spark, d):
    """SK15: conversations created, a message appended to each, retitled, and some deleted with their messages."""
    s = Store(spark)
    m = table(spark, d, "conversations").select("conv_id", "turn", "text")
    conv = s.put("c", m.select("conv_id", F.lit("new").alias("title")).distinct())
    s.put("m", m)
    s.append("m", m.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("thanks").alias("text")))
    s.update("c", title=F.concat(F.lit("chat "), F.col("conv_id").cast("string")))
    gone = conv.filter("conv_id % 9 = 0")
    s.delete("c", gone, ["conv_id"])
    s.delete("m", gone, ["conv_id"])
    return s.get("c").join(s.get("m").groupBy("conv_id").agg(F.count("*").alias("messages")), "conv_id").select("conv_id", "messages", "title")


@query("sk16_task_changes", "SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 5 < 3 THEN 'retrying' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'retrying' WHEN event_type = 'error' THEN 'dead' WHEN event_type = 'view' THEN 'cancelled' ELSE 'done' END AS state FROM events WHERE event_type <> 'signup'")
def sk16(spark, d):
    """SK16: failures retried or given up, running ones cancelled, finished ones deleted, and some given-up ones retried by hand."""
    s = Store(spark)
    first = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("done")
    s.put("t", table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 5).alias("retries"), first.alias("state")))
    s.update("t", state=F.when((F.col("state") == "failed") & (F.col("retries") < 3), "retrying").when(F.col("state") == "failed", "dead").otherwise(F.col("state")))
    s.update("t", state=F.when(F.col("state").isin("pending", "running"), "cancelled").otherwise(F.col("state")))
    s.update("t", state=F.when((F.col("state") == "dead") & (F.col("event_id") % 2 == 0), "retrying").otherwise(F.col("state")))
    return s.put("t", s.get("t").filter("event_type <> 'signup'")).select("event_id", "state")


@query("sk17_permission_rows", "SELECT id AS file_id, 'u' || (id % 3) AS principal FROM files WHERE id % 3 = 1 AND id % 4 <> 0", "files")
def sk17(spark, d):
    """SK17: permissions of one principal read, after some were deleted."""
    s = Store(spark)
    p = s.put("p", V.files(spark, d).select(F.col("id").alias("file_id"), F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("principal")))
    return s.delete("p", p.filter("file_id % 4 = 0"), ["file_id", "principal"]).filter("principal = 'u1'")


@query("sk18_links", "SELECT DISTINCT l_orderkey % 50 AS a, l_partkey % 50 AS b FROM lineitem WHERE l_orderkey % 50 <> 7")
def sk18(spark, d):
    """SK18: links inserted once each whatever comes again; those of a deleted page go."""
    s = Store(spark)
    link = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("a"), (F.col("l_partkey") % 50).alias("b"))
    s.put("l", link.filter("a < 25").distinct())
    s.insert_new("l", link, ["a", "b"])
    return s.put("l", s.get("l").filter("a <> 7"))


@query("sk19_reimport", "SELECT id, id % 4 = 0 AS deleted, CAST(NULL AS BIGINT) AS replaces FROM files UNION ALL SELECT id + 1000000, false, id FROM files WHERE id % 4 = 0", "files")
def sk19(spark, d):
    """SK19: a file imported again is found by its record; the old one goes to the bin, the new one tells which it replaces."""
    s = Store(spark)
    f = s.put("f", V.files(spark, d).select("id", F.lit(False).alias("deleted"), F.lit(None).cast("long").alias("replaces")))
    again = f.filter("id % 4 = 0").select("id")
    s.upsert_columns("f", again.withColumn("deleted", F.lit(True)), ["id"])
    return s.append("f", again.select((F.col("id") + 1000000).alias("id"), F.lit(False).alias("deleted"), F.col("id").alias("replaces")))


@query("sk20_hit_counts", "SELECT part AS entry, count(*) AS hits FROM (SELECT l_partkey % 40 AS part FROM lineitem) GROUP BY part")
def sk20(spark, d):
    """SK20: hits of cache entries counted up in batches."""
    s = Store(spark)
    hit = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("entry"), "l_linenumber")
    s.put("c", hit.select("entry").distinct().withColumn("hits", F.lit(0).cast("long")))
    for part in range(2):
        s.upsert_sum("c", hit.filter(f"l_linenumber % 2 = {part}").groupBy("entry").agg(F.count("*").alias("hits")), ["entry"])
    return s.get("c")


@query("sk22_vector_store", "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS kept, CAST(0 AS BIGINT) AS after_reset")
def sk22(spark, d):
    """SK22: vectors deleted, counted, and the store reset."""
    s = Store(spark)
    v = s.put("v", table(spark, d, "embeddings").select("vec_id"))
    kept = s.delete("v", v.filter("vec_id % 2 = 1"), ["vec_id"]).agg(F.count("*").alias("kept"))
    return kept.crossJoin(s.put("v", v.limit(0)).agg(F.count("*").alias("after_reset")))  # one row each


@query("so03_vector_orphans", "SELECT 'orphan' AS state, count(*) AS n FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) UNION ALL SELECT 'missing', count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 EXCEPT SELECT vec_id FROM embeddings)")
def so03(spark, d):
    """SO03: vectors without a row, rows without a vector."""
    rows = table(spark, d, "documents").filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("vec_id")).distinct()
    vec = table(spark, d, "embeddings").select("vec_id").distinct()
    return count(vec.join(rows, "vec_id", "left_anti"), "orphan").union(count(rows.join(vec, "vec_id", "left_anti"), "missing")).withColumnRenamed("relation", "state")


@query("st11_self_heal", "SELECT 'vectors' AS relation, count(*) AS n FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) UNION ALL SELECT 'labels', count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'events', count(*) FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def st11(spark, d):
    """ST11: the start-up sequence on written tables: vectors and labels without a document go, old events are purged."""
    s = Store(spark)
    docs = table(spark, d, "documents").select("doc_id").distinct()
    s.put("vectors", table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))
    s.put("labels", labels_of(spark, d))
    s.put("events", table(spark, d, "events").select("event_id", "ts"))
    heal = lambda name: s.put(name, s.get(name).join(docs, "doc_id", "left_semi"))
    purged = s.put("events", s.get("events").filter(F.col("ts") > F.lit("2024-01-15").cast("timestamp")))
    return count(heal("vectors"), "vectors").union(count(heal("labels"), "labels")).union(count(purged, "events"))


@query("st05_resume", "SELECT doc_id, 'stored' AS stage, length(text) AS size FROM documents")
def st05(spark, d):
    """ST05: a run that stopped after its second stage for some documents: the rest repeats that stage, whose keyed writes make
    a second time the same as the first, and all reach the third."""
    s = Store(spark)
    docs = table(spark, d, "documents").select("doc_id", F.lit("parsed").alias("stage"), F.length("text").alias("size")).dropDuplicates(["doc_id"])
    parsed = s.put("t", docs)
    s.upsert("t", parsed.filter("doc_id % 3 = 0").withColumn("stage", F.lit("chunked")), ["doc_id"])
    s.upsert("t", parsed.withColumn("stage", F.lit("chunked")), ["doc_id"])
    return s.upsert("t", s.get("t").filter("stage = 'chunked'").withColumn("stage", F.lit("stored")), ["doc_id"])
