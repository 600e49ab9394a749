"""Filters, joins, counts, limits and listings over the common views, one query each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import first_of
from ..plans import views as V
from ..registry import example, query
from ..session import table
from .fusion import RANKED, lexical, phrases
from .retrieval import BM25, VEC, bm25, nearest_vectors, ranked, vector_sums
from .text import readable


@query("pf02_file_list", "SELECT id, name FROM files WHERE NOT deleted AND category = 'en' AND folder = '/src1/en' AND id % 400 BETWEEN 1 AND 365", "files")
def pf02(spark, d):
    """PF02: live files of a category in exactly one folder, of the days 1 to 365 (the id stands for the age)."""
    return V.files(spark, d).filter("not deleted and category = 'en' and folder = '/src1/en' and id % 400 between 1 and 365").select("id", "name")


@query("pf05_like", r"SELECT id, name FROM files WHERE name LIKE '%src1\_1%' ESCAPE '\' OR name LIKE '%9\_%' ESCAPE '\'", "files")
def pf05(spark, d):
    """PF05: names that hold one of some terms, whose own % and _ stand for themselves."""
    hit = F.lit(False)
    for term in ("src1_1", "9_"):
        safe = "".join("\\" + c if c in "%_\\" else c for c in term)
        hit = hit | F.col("name").like(f"%{safe}%")
    return V.files(spark, d).filter(hit).select("id", "name")


@query("pf06_non_han", "SELECT doc_id FROM documents WHERE length(text) > 50 AND NOT regexp_matches(text, '[一-鿿]{2,}') AND length(regexp_replace(text, '[^一-鿿]', '', 'g')) < 0.3 * length(text)")
def pf06(spark, d):
    """PF06: texts of more than 50 characters without two Han characters in a row and under 0.3 of them."""
    han = F.length(F.regexp_replace("text", "[^一-鿿]", ""))
    return V.documents(spark, d).filter((F.length("text") > 50) & ~F.col("text").rlike("[一-鿿]{2,}") & (han < F.length("text") * 0.3)).select("doc_id")


@query("pf07_content_words", f"SELECT qid, CAST(len(list_distinct(terms)) AS BIGINT) AS kept, CAST(len(list_distinct(regexp_extract_all(lower(text), '{V.TOKEN}'))) - len(list_distinct(terms)) AS BIGINT) AS dropped FROM questions", "questions")
def pf07(spark, d):
    """PF07: words of a query that are neither short nor stop words, and how many are dropped."""
    every = F.size(F.array_distinct(V.tokens(F.col("text"))))
    return V.questions(spark, d).select("qid", F.size("terms").cast("long").alias("kept"), (every - F.size("terms")).cast("long").alias("dropped"))


@query("pf09_task_predicates", "SELECT event_id, event_type = 'error' AND event_id % 5 < 3 AS retryable, event_type = 'view' AS resumable, event_type IN ('view', 'error') AND ts < TIMESTAMP '2024-01-02' AS stale, event_type = 'error' AND event_id % 5 >= 3 AS dead FROM events")
def pf09(spark, d):
    """PF09: which tasks can be retried or resumed, are stale or dead."""
    e, bad, n = F.col("event_type"), F.col("event_type") == "error", F.col("event_id") % 5
    old = F.col("ts") < F.lit("2024-01-02").cast("timestamp")
    return table(spark, d, "events").select("event_id", (bad & (n < 3)).alias("retryable"), (e == "view").alias("resumable"), (e.isin("view", "error") & old).alias("stale"), (bad & (n >= 3)).alias("dead"))


@query("pf12_unimported_page", "SELECT id, name FROM files WHERE id NOT IN (SELECT vec_id FROM embeddings) ORDER BY id LIMIT least(500, 200) OFFSET 20", "files")
def pf12(spark, d):
    """PF12: a page of the files without an import record; a page has 200 rows at most."""
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return V.files(spark, d).select("id", "name").join(have, "id", "left_anti").orderBy("id").offset(20).limit(min(500, 200))


@query("pf15_history_gate", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant', 'system') AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20")
def pf15(spark, d):
    """PF15: the last twenty messages with a known role and a text."""
    ok = table(spark, d, "conversations").filter("role in ('user', 'assistant', 'system') and trim(text) <> ''")
    return first_of(ok, ["conv_id"], [F.desc("turn")], 20).select("conv_id", "turn")


IDS = ("12", "0012", "x1", " 7", "-3", "", "9999999999")


@example("pf16_chunk_ids", "SELECT raw, CAST(raw AS BIGINT) AS id FROM (VALUES " + ", ".join(f"('{x}')" for x in IDS) + ") v(raw) WHERE regexp_full_match(raw, '[0-9]+')")
def pf16(spark, d):
    """PF16: ids that are integers or strings of digits; others go."""
    rows = spark.createDataFrame([(x,) for x in IDS], "raw string")
    return rows.filter(F.col("raw").rlike("^[0-9]+$")).select("raw", F.col("raw").cast("long").alias("id"))


@query("jn02_chunks_of_vectors", "SELECT c.id, f.name FROM chunks c JOIN files f ON f.id = c.file_id JOIN embeddings e ON e.vec_id = c.file_id WHERE c.chunk_index = 0", "files chunks")
def jn02(spark, d):
    """JN02: chunks and files of stored vectors."""
    c = V.chunks(spark, d).filter("chunk_index = 0").select("id", "file_id")
    f = V.files(spark, d).select(F.col("id").alias("file_id"), "name")
    return c.join(f, "file_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("file_id")), "file_id").select("id", "name")


@query("jn03_backfill", "SELECT e.vec_id, coalesce(f.name, '') AS name, f.name IS NULL AS orphan FROM embeddings e LEFT JOIN files f ON f.id = e.vec_id", "files")
def jn03(spark, d):
    """JN03: names put to a list of ids; an id without a file keeps an empty one and is told."""
    f = V.files(spark, d).select(F.col("id").alias("vec_id"), "name")
    return table(spark, d, "embeddings").select("vec_id").join(f, "vec_id", "left").select("vec_id", F.coalesce("name", F.lit("")).alias("name"), F.col("name").isNull().alias("orphan"))


@query("jn12_query_vectors", VEC + " SELECT qid, count(*) AS scored, round(avg(score), 4) AS mean FROM s GROUP BY qid")
def jn12(spark, d):
    """JN12: a stated set of query vectors against all vectors; the scores are summed up where they are made."""
    return vector_sums(spark, d).groupBy("qid").agg(F.sum("n").alias("scored"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean"))


@query("jn15_orphans", "SELECT 'labels' AS relation, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'suppliers', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def jn15(spark, d):
    """JN15: rows whose parent is missing, five relations."""
    t = lambda n: table(spark, d, n)
    pairs = {"labels": ("labels", "doc_id", "documents", "doc_id"), "vectors": ("embeddings", "vec_id", "documents", "doc_id"), "orders": ("orders", "o_custkey", "customer", "c_custkey"), "lines": ("lineitem", "l_orderkey", "orders", "o_orderkey"), "suppliers": ("supplier", "s_nationkey", "nation", "n_nationkey")}
    out = None
    for name, (a, ka, b, kb) in pairs.items():
        n = t(a).select(F.col(ka).alias("k")).join(t(b).select(F.col(kb).alias("k")), "k", "left_anti").agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@query("jn16_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def jn16(spark, d):
    """JN16: a count for each row, 0 where there is none: a left join to counts."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("jn17_valid_sources", "SELECT doc_id FROM labels WHERE doc_id IN (SELECT id FROM files WHERE NOT deleted) AND quality IN (SELECT 1)", "files")
def jn17(spark, d):
    """JN17: cached rows whose source still lives."""
    live = V.files(spark, d).filter("not deleted").select(F.col("id").alias("doc_id"))
    return table(spark, d, "labels").filter("quality = 1").select("doc_id").join(live, "doc_id", "left_semi")


@query("ag04_rrf_sum", f"WITH {RANKED.strip()} SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS sources FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY qid, id", "chunks postings questions")
def ag04(spark, d):
    """AG04: sums of reciprocal ranks over the recalls that found a chunk."""
    both = lexical(spark, d).select("qid", "id", "rank").union(phrases(spark, d).select("qid", "id", "rank"))
    return both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"), F.count("*").alias("sources"))


@query("ag07_source_counts", "SELECT k AS source, count(*) AS refs FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL GROUP BY k")
def ag07(spark, d):
    """AG07: references of the JSON that messages carry, counted by what they refer to."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(k.alias("source")).filter("source is not null").groupBy("source").agg(F.count("*").alias("refs"))


@query("ag11_header_lines", "WITH l AS (SELECT lang, trim(regexp_extract(text, '^[^\n]*')) AS line FROM documents), p AS (SELECT lang, count(*) AS pages FROM documents GROUP BY lang) SELECT lang, line, count(*) AS n FROM l JOIN p USING (lang) GROUP BY lang, line, pages HAVING count(*) >= greatest(3, 0.005 * pages)")
def ag11(spark, d):
    """AG11: first lines that at least three pages of a file, and a share of them, have (a language stands for a file)."""
    page = table(spark, d, "documents").select("lang", F.trim(F.regexp_extract("text", "^[^\n]*", 0)).alias("line"))
    n = page.groupBy("lang", "line").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("lang").agg(F.sum("n").alias("pages")), "lang").filter(F.col("n") >= F.greatest(F.lit(3.0), F.col("pages") * 0.005)).select("lang", "line", "n")


@query("ag20_legend", "SELECT 'type' AS kind, type AS name, count(*) AS n FROM entities GROUP BY type UNION ALL SELECT 'category', category, count(*) FROM files GROUP BY category", "files chunks postings entities")
def ag20(spark, d):
    """AG20: legend of the graph: nodes by type, files by category."""
    one = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return one(V.entities(spark, d), "type", "type").union(one(V.files(spark, d), "category", "category"))


@query("ag24_metric_events", "SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, count(*) AS calls, count(*) FILTER (WHERE value > 100) AS slow, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ag24(spark, d):
    """AG24: recorded calls by kind and hour, with the slow ones."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    return table(spark, d, "events").groupBy("event_type", slot.alias("slot")).agg(F.count("*").alias("calls"), F.count(F.when(F.col("value") > 100, 1)).alias("slow"), F.round(F.sum("value"), 4).alias("total"))


@query("wn01_file_cap", f"WITH {BM25.strip()} SELECT qid, id, row_number() OVER (PARTITION BY qid, file_id ORDER BY score DESC, id) AS n FROM bm25 QUALIFY n <= 8", "chunks postings questions")
def wn01(spark, d):
    """WN01: the first eight of each file, in the order of their scores."""
    w = Window.partitionBy("qid", "file_id").orderBy(F.desc("score"), "id")
    return bm25(spark, d).withColumn("n", F.row_number().over(w).cast("long")).filter("n <= 8").select("qid", "id", "n")


@query("wn03_chunks_of_files", "SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY file_id, chunk_index) AS place FROM (SELECT f.category, c.* FROM chunks c JOIN files f ON f.id = c.file_id WHERE c.chunk_index < 10) QUALIFY place <= 50", "files chunks")
def wn03(spark, d):
    """WN03: ten chunks of each file, fifty in all, of each category."""
    f = V.files(spark, d).select(F.col("id").alias("file_id"), "category")
    c = V.chunks(spark, d).filter("chunk_index < 10").join(f, "file_id")
    w = Window.partitionBy("category").orderBy("file_id", "chunk_index")
    return c.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 50").select("category", "id", "place")


@query("wn08_line_repeats", "WITH l AS (SELECT doc_id, i, line, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE line = prev) AS repeats, md5(arg_min(line, i)) AS first, md5(arg_max(line, i)) AS last FROM l GROUP BY doc_id")
def wn08(spark, d):
    """WN08: lines that repeat the one before, and a text's first and last line; kept inside the row."""
    p = F.split("text", "\n", -1)
    pairs = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: a == b)
    rows = V.documents(spark, d).filter("text is not null").select("doc_id", p.alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("lines"), F.size(F.filter(pairs, lambda x: x)).cast("long").alias("repeats"), F.md5(F.element_at("p", 1)).alias("first"), F.md5(F.element_at("p", -1)).alias("last"))


@query("wn11_segment_ratios", "WITH s AS (SELECT doc_id, i, substring(text, CAST(i * (length(text) // 24) + 1 AS BIGINT), 800) AS seg FROM documents, range(0, 24) r(i)) SELECT doc_id, round(min(r), 6) AS lowest, round(max(r), 6) AS highest FROM (SELECT doc_id, length(regexp_replace(seg, '[^a-zA-ZÀ-ÿ0-9 ]', '', 'g')) / greatest(length(seg), 1) AS r FROM s) GROUP BY doc_id")
def wn11(spark, d):
    """WN11: readable share of 24 sampled segments of 800 characters, the least and the greatest."""
    return V.documents(spark, d).select("doc_id", readable("text").alias("r")).select("doc_id", F.round(F.array_min("r"), 6).alias("lowest"), F.round(F.array_max("r"), 6).alias("highest"))


@query("wn12_task_eviction", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'purchase') UNION ALL SELECT event_id FROM (SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 200)")
def wn12(spark, d):
    """WN12: of finished and failed tasks the newest 200 stay, the others all do; a top-k taken in each partition first."""
    e = table(spark, d, "events")
    over = F.col("event_type").isin("error", "purchase")
    return e.filter(~over).select("event_id").union(e.filter(over).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id"))


@query("tk01_bm25_top", f"WITH {BM25.strip()} SELECT qid, id, -score AS rank_score FROM bm25 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 200", "chunks postings questions")
def tk01(spark, d):
    """TK01: 200 best by words, scores negated: the more negative the better."""
    return lexical(spark, d).select("qid", "id", (-F.col("score")).alias("rank_score"))


@query("tk02_nearest", VEC + " SELECT qid, id, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 50")
def tk02(spark, d):
    """TK02: fifty nearest vectors."""
    return ranked(nearest_vectors(spark, d, 50), limit=50).select("qid", "id", "score")


@query("tk03_fused_cut", f"WITH {RANKED.strip()}, f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(src) AS src, min(rank) AS best FROM (SELECT *, 1 AS src FROM r1 UNION ALL SELECT *, 2 AS src FROM r2) GROUP BY qid, id) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, src, best, id) AS rank FROM f QUALIFY rank <= 30", "chunks postings questions")
def tk03(spark, d):
    """TK03: three times ten of the fusion; equal scores by the order of the recalls."""
    both = lexical(spark, d).select("qid", "id", "rank", F.lit(1).alias("src")).union(phrases(spark, d).select("qid", "id", "rank", F.lit(2)))
    f = both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"), F.min("src").alias("src"), F.min("rank").alias("best"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "src", "best", "id")
    return f.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 30").select("qid", "id", "score", "rank")


@query("tk06_file_candidates", f"WITH {BM25.strip()}, h AS (SELECT qid, file_id, count(*) AS hits FROM bm25 GROUP BY ALL), n AS (SELECT file_id, count(*) AS chunks FROM chunks GROUP BY file_id) SELECT qid, file_id, hits, chunks FROM h JOIN n USING (file_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hits DESC, chunks, file_id) <= 8", "chunks postings questions")
def tk06(spark, d):
    """TK06: files by hits, then by fewer chunks, then by id."""
    n = V.chunks(spark, d).groupBy("file_id").agg(F.count("*").alias("chunks"))
    h = bm25(spark, d).groupBy("qid", "file_id").agg(F.count("*").alias("hits")).join(n, "file_id")
    return first_of(h, ["qid"], [F.desc("hits"), "chunks", "file_id"], 8).select("qid", "file_id", "hits", "chunks")


@query("tk11_recent_audit", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def tk11(spark, d):
    """TK11: the hundred newest rows of the audit."""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")


@query("so05_first_seen", f"WITH {RANKED.strip()} SELECT qid, id, min(src) AS seen_in FROM (SELECT qid, id, 1 AS src FROM r1 WHERE rank <= 20 UNION ALL SELECT qid, id, 2 FROM r2 WHERE rank <= 20) GROUP BY qid, id", "chunks postings questions")
def so05(spark, d):
    """SO05: results of several forms of a query in one list, each where it was seen first."""
    both = lexical(spark, d).filter("rank <= 20").select("qid", "id", F.lit(1).alias("src")).union(phrases(spark, d).filter("rank <= 20").select("qid", "id", F.lit(2)))
    return both.groupBy("qid", "id").agg(F.min("src").alias("seen_in"))


@query("sc22_scan", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey IN (1, 2, 3, 4, 5)")
def sc22(spark, d):
    """SC22: a filtered scan; filter and columns reach Parquet."""
    return table(spark, d, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal > 0 and c_nationkey in (1, 2, 3, 4, 5)").select("c_custkey", "c_name")


@query("sc25_ordered_scan", "SELECT file_id, md5(string_agg(content, chr(10) ORDER BY chunk_index)) AS digest, count(*) AS chunks FROM chunks GROUP BY file_id", "chunks")
def sc25(spark, d):
    """SC25: a file's chunks in their order."""
    g = V.chunks(spark, d).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return g.select("file_id", F.md5(F.array_join(F.transform("c", lambda x: x["content"]), "\n")).alias("digest"), F.size("c").cast("long").alias("chunks"))


@query("sc20_folder_tree", "WITH RECURSIVE tree(id, parent) AS (SELECT p_partkey, p_partkey // 3 FROM part), walk(id, up, depth, path) AS (SELECT id, parent, 1, ':' || id || ':' FROM tree UNION ALL SELECT walk.id, tree.parent, depth + 1, ':' || tree.id || path FROM walk JOIN tree ON tree.id = walk.up WHERE depth < 20) SELECT id, CAST(max(depth) AS BIGINT) AS depth, arg_max(path, depth) AS path FROM walk GROUP BY id")
def sc20(spark, d):
    """SC20: the path of each folder from the root, at most twenty deep; each step is a join of all folders still open, and
    the walk ends when none is."""
    from ..session import cut

    tree = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    up = tree.select(F.col("id").alias("_id"), F.col("parent").alias("_next"))
    walk = tree.select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth"), F.concat(F.lit(":"), F.col("id").cast("string"), F.lit(":")).alias("path"))
    done = walk.limit(0)
    for _ in range(19):
        step = cut(walk.join(up, F.col("at") == F.col("_id"), "left"))
        done = done.union(step.filter("_id is null").select("id", "at", "depth", "path"))
        walk = step.filter("_id is not null").select("id", F.col("_next").alias("at"), (F.col("depth") + 1).alias("depth"), F.concat(F.lit(":"), F.col("_id").cast("string"), F.col("path")).alias("path"))
        if walk.isEmpty():
            break
    return done.union(walk).select("id", "depth", "path")


@query("rt36_rewrite_cache", "SELECT user_id, count(DISTINCT event_type) AS kept FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS n FROM events GROUP BY user_id, event_type) WHERE n <= 3 GROUP BY user_id")
def rt36(spark, d):
    """RT36: a cache of the queries used last, three of each user here."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("at"))
    return first_of(last, ["user_id"], [F.desc("at")], 3).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("gr16_extraction_queue", "SELECT file_id, min(id) AS id FROM chunks WHERE file_id % 3 <> 0 GROUP BY file_id, content QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY min(id)) <= 50", "chunks")
def gr16(spark, d):
    """GR16: what a model would be given: files not extracted yet, each content once, fifty chunks of a file."""
    once = V.chunks(spark, d).filter("file_id % 3 <> 0").groupBy("file_id", "content").agg(F.min("id").alias("id"))
    return first_of(once, ["file_id"], ["id"], 50).select("file_id", "id")


@query("st06_due_retries", "SELECT event_id, event_id % 5 AS retries FROM events WHERE event_type = 'error' AND event_id % 5 < 3 AND ts + to_seconds(CAST(5 * pow(2, event_id % 5) AS BIGINT)) <= TIMESTAMP '2024-01-20'")
def st06(spark, d):
    """ST06: failed tasks whose waiting time is over at the scheduler's tick, and that were tried less than three times."""
    n = F.col("event_id") % 5
    due = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.pow(F.lit(2.0), n) * 5 <= 1705708800.0
    return table(spark, d, "events").filter((F.col("event_type") == "error") & (n < 3) & due).select("event_id", n.alias("retries"))


#: Migrations of a schema (literal rows), and the version it is at.
MIGRATIONS, AT = ((3, "add category"), (1, "create files"), (5, "add links"), (4, "add folder"), (2, "create chunks")), 2


@example("st14_migrations", "SELECT version, name, row_number() OVER (ORDER BY version) AS step FROM (VALUES " + ", ".join(f"(CAST({v} AS BIGINT), '{n}')" for v, n in MIGRATIONS) + f") m(version, name) WHERE version > {AT}")
def st14(spark, d):
    """ST14: migrations beyond the highest version applied, in their order."""
    m = spark.createDataFrame(list(MIGRATIONS), "version long, name string").filter(F.col("version") > AT)
    return m.withColumn("step", F.row_number().over(Window.orderBy("version")).cast("long"))


@query("rt23_expanded_queries", f"WITH once AS (SELECT qid, list_filter(terms, lambda t, i: list_position(terms, t) = i) AS terms FROM questions), forms AS (SELECT qid * 10 AS qid, terms[1:3] AS terms FROM once UNION ALL SELECT qid * 10 + 1, terms[4:] FROM once), {BM25.strip().replace('FROM questions', 'FROM forms')}, top AS (SELECT * FROM bm25 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 20) SELECT qid // 10 AS qid, id, min(qid % 10) AS seen_in FROM top GROUP BY ALL", "chunks postings questions")
def rt23(spark, d):
    """RT23: several forms of a query (given rows; the model that would write them is outside), their results in one list,
    each where it was seen first."""
    q = V.questions(spark, d).select("qid", "terms")
    forms = q.select((F.col("qid") * 10).alias("qid"), F.slice("terms", 1, 3).alias("terms")).union(q.select(F.col("qid") * 10 + 1, F.slice("terms", F.lit(4), F.greatest(F.size("terms"), F.lit(1)))))
    top = ranked(bm25(spark, d, forms), limit=20)
    return top.groupBy(F.floor(F.col("qid") / 10).alias("qid"), "id").agg(F.min(F.col("qid") % 10).alias("seen_in"))
