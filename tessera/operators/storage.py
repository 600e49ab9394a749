"""Upserts, deletes, deduplication, change capture, permissions and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import views as V
from ..registry import query
from ..session import table


def latest(df: DataFrame, keys: list[str], *by) -> DataFrame:
    """SK02, SK05, SK11: the last row of each key; max_by combines before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


@query("sk02_upsert_replace", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def sk02(spark, d):
    """SK02 over a log: upsert, last writer wins."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("sk06_soft_delete", "SELECT category, count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS bin FROM files GROUP BY category", "files")
def sk06(spark, d):
    """SK06, read: live files and the bin."""
    return V.files(spark, d).groupBy("category").agg(F.count(F.when(~F.col("deleted"), 1)).alias("live"), F.count(F.when(F.col("deleted"), 1)).alias("bin"))


@query("sk07_cascade_delete", "SELECT file_id, count(*) AS chunks FROM chunks WHERE file_id NOT IN (SELECT id FROM files WHERE deleted) GROUP BY file_id", "files chunks")
def sk07(spark, d):
    """SK07, read: what is left of chunks once deleted files are gone."""
    dead = V.files(spark, d).filter("deleted").select(F.col("id").alias("file_id"))
    return V.chunks(spark, d).join(dead, "file_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("chunks"))


@query("sk09_unique_slugs", "SELECT id, CASE WHEN n = 1 THEN base ELSE base || '-' || (n - 1) END AS slug FROM (SELECT id, category AS base, row_number() OVER (PARTITION BY category ORDER BY id) AS n FROM files)", "files")
def sk09(spark, d):
    """SK09: slugs made unique by a counter. A base's files are numbered in ranges of ids: within a range by a window, and
    from the sum of the ranges before it, so that one base is no single task."""
    f = V.files(spark, d).select("id", F.col("category").alias("base")).withColumn("range", F.floor(F.col("id") / 4096))
    own = F.row_number().over(Window.partitionBy("base", "range").orderBy("id"))
    before = Window.partitionBy("base").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = f.groupBy("base", "range").agg(F.count("*").alias("n")).withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    n = f.withColumn("own", own).join(counts, ["base", "range"]).withColumn("n", F.col("own") + F.col("held"))
    return n.select("id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", (F.col("n") - 1).cast("string"))).alias("slug"))


@query("ag17_duplicate_files", "SELECT file_id AS id, digest, row_number() OVER (PARTITION BY digest ORDER BY length(name) DESC, file_id) > 1 AS duplicate FROM (SELECT file_id, md5(string_agg(h, ',' ORDER BY h)) AS digest FROM (SELECT DISTINCT file_id, md5(content) AS h FROM chunks) GROUP BY file_id) JOIN files ON files.id = file_id", "files chunks")
def ag17(spark, d):
    """AG17: files whose chunks are equal as sets; the one of the longest name stays, then of the least id. A group of copies
    sends its best candidate of each task."""
    g = V.chunks(spark, d).groupBy("file_id").agg(F.md5(F.array_join(F.sort_array(F.collect_set(F.md5("content"))), ",")).alias("digest"))
    g = g.join(V.files(spark, d).select(F.col("id").alias("file_id"), (-F.length("name")).alias("short")), "file_id")
    first = g.groupBy("digest").agg(F.min(F.struct("short", "file_id"))["file_id"].alias("keep"))
    return g.join(first, "digest").select(F.col("file_id").alias("id"), "digest", (F.col("file_id") != F.col("keep")).alias("duplicate"))


@query("ag18_content_hash", "SELECT sha256(text) AS content_hash, min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY 1")
def ag18(spark, d):
    """AG18: deduplication by content hash; only digests are shuffled."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))


@query("st08_cdc", "WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS action, count(*) AS n FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1")
def st08(spark, d):
    """ST08: change capture between two snapshots by content hash."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    o = docs.filter("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("old"))
    n = docs.filter("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("new"))
    act = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return o.join(n, "doc_id", "full").groupBy(act.alias("action")).agg(F.count("*").alias("n"))


@query("so01_accessible_files", "WITH perm AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'u1' END AS usr, CASE WHEN id % 5 = 1 THEN 'reader' END AS role FROM files WHERE id % 5 < 3) SELECT id FROM perm WHERE usr = 'u1' OR role = 'reader' UNION SELECT id FROM files WHERE NOT deleted AND id NOT IN (SELECT id FROM perm)", "files")
def so01(spark, d):
    """SO01: granted to the user or a role, or under no rule at all."""
    f = V.files(spark, d).select("id", "deleted")
    perm = f.filter("id % 5 < 3").select("id", F.when(F.col("id") % 5 == 0, "u1").alias("usr"), F.when(F.col("id") % 5 == 1, "reader").alias("role"))
    granted = perm.filter("usr = 'u1' or role = 'reader'").select("id")
    return granted.union(f.filter("not deleted").join(perm, "id", "left_anti").select("id")).distinct()


@query("so02_index_reconcile", "SELECT 'orphan' AS state, count(*) AS n FROM (SELECT DISTINCT id FROM postings EXCEPT SELECT id FROM chunks WHERE id % 13 <> 0) UNION ALL SELECT 'missing', count(*) FROM (SELECT id FROM chunks WHERE id % 13 <> 0 EXCEPT SELECT id FROM postings)", "chunks postings")
def so02(spark, d):
    """SO02: index rows without a chunk, chunks without an index row."""
    have = V.postings(spark, d).select("id").distinct()
    rows = V.chunks(spark, d).filter("id % 13 <> 0").select("id")
    count = lambda name, df: df.agg(F.lit(name).alias("state"), F.count("*").alias("n"))
    return count("orphan", have.join(rows, "id", "left_anti")).union(count("missing", rows.join(have, "id", "left_anti")))


@query("st12_health", "SELECT 'labels_without_document' AS invariant, count(*) AS n FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) UNION ALL SELECT 'orders_without_customer', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey) UNION ALL SELECT 'lineitem_without_order', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey) UNION ALL SELECT 'wrong_length', count(*) FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'empty_text', count(*) FROM documents WHERE text = '' UNION ALL SELECT 'vectors_of_other_length', count(*) FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)")
def st12(spark, d):
    """ST12: one row of violations for each invariant."""
    t = lambda n: table(spark, d, n)
    docs = t("documents")
    checks = {
        "labels_without_document": t("labels").join(docs, "doc_id", "left_anti"),
        "orders_without_customer": t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "lineitem_without_order": t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "wrong_length": docs.filter(F.col("n_chars") != F.length("text")),
        "empty_text": docs.filter("text = ''"),
        "vectors_of_other_length": t("embeddings").filter("size(embedding) <> 64"),
        "repeated_ids": docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"),
    }
    return reduce(DataFrame.union, [df.agg(F.lit(k).alias("invariant"), F.count("*").alias("n")) for k, df in checks.items()])


@query("pf01_metadata_filter", "SELECT id, name FROM files WHERE category = 'en' AND authority >= 3 AND (folder = '/src1' OR starts_with(folder, '/src1/')) AND NOT deleted", "files")
def pf01(spark, d):
    """PF01: category, authority and folder filters."""
    return V.files(spark, d).filter((F.col("category") == "en") & (F.col("authority") >= 3) & ((F.col("folder") == "/src1") | F.col("folder").startswith("/src1/")) & ~F.col("deleted")).select("id", "name")


# Kinds of files that are taken in, and the most megabytes of one (fixed values).
TAKEN = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".csv", ".md", ".log", ".json", ".xml")
MEGABYTES = 200


def upload_gate(files: DataFrame, megabytes: int = MEGABYTES) -> DataFrame:
    """PF14: files (name, content) with ``verdict`` (ok, unsupported, too_large, empty) and ``digest`` of those that are ok. The
    kind is what follows the last dot of the last part of a name, in lower case; a name that begins with its only dot has none."""
    last = F.lower(F.element_at(F.split(F.coalesce("name", F.lit("")), "/"), -1))
    kind = F.regexp_extract(last, r"[^.].*([.][^.]+)$", 1)
    size = F.octet_length(F.coalesce("content", F.lit("")))
    v = F.when(~kind.isin(*TAKEN), "unsupported").when(size > megabytes << 20, "too_large").when(size == 0, "empty").otherwise("ok")
    return files.withColumn("verdict", v).withColumn("digest", F.when(F.col("verdict") == "ok", F.sha2("content", 256)))


@query(
    "pf14_upload_gate",
    f"SELECT relation, id, verdict, CASE WHEN verdict = 'ok' THEN sha256(content) END AS digest FROM (SELECT *, CASE WHEN regexp_extract(lower(list_last(string_split(name, '/'))), '[^.].*([.][^.]+)$', 1) NOT IN ({', '.join(f"'{x}'" for x in TAKEN)}) THEN 'unsupported' WHEN strlen(content) > {MEGABYTES << 20} THEN 'too_large' WHEN strlen(content) = 0 THEN 'empty' ELSE 'ok' END AS verdict FROM (SELECT 'files' AS relation, id, name, coalesce(text, '') AS content FROM files UNION ALL SELECT 'pages', page_id, url, coalesce(html, '') FROM pages))",
    "files",
)
def pf14(spark, d):
    """PF14: the gate over the documents' files and over pages, whose addresses are names without a kind."""
    files = V.files(spark, d).select(F.lit("files").alias("relation"), "id", "name", F.col("text").alias("content"))
    pages = table(spark, d, "pages").select(F.lit("pages"), "page_id", "url", "html")
    return upload_gate(files.union(pages)).select("relation", "id", "verdict", "digest")


@query("sk14_backfill_counts", "SELECT f.id, f.name, count(c.id) AS chunk_count FROM files f LEFT JOIN chunks c ON c.file_id = f.id GROUP BY ALL", "files chunks")
def sk14(spark, d):
    """SK14, read: chunk counts written back to files."""
    n = V.chunks(spark, d).groupBy("file_id").agg(F.count("*").alias("chunk_count"))
    f = V.files(spark, d).select("id", "name")
    return f.join(n, F.col("id") == F.col("file_id"), "left").select("id", "name", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
