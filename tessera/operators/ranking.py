"""Query analysis, local re-ranking, gates and listings around the recalls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans import views as V
from ..registry import query
from ..session import table
from .fusion import _CLASS_SQL, _W_SQL, class_weight, query_class
from .retrieval import BM25, VEC, bm25, nearest_vectors, ranked, relevant_vectors



def top_sql(n: int) -> str:
    return f"{BM25.strip()}, top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= {n})"


TOP = top_sql(30)


def rerank_sql() -> str:
    return f"t AS (SELECT qid, top.id, score, list_distinct(terms) AS terms, regexp_extract_all(lower(content), '{V.TOKEN}') AS words FROM top JOIN chunks c ON c.id = top.id JOIN questions q USING (qid)), r AS (SELECT qid, id, score, list_sum(list_transform(terms, lambda t: CASE WHEN list_contains(words, t) THEN len(list_filter(words, lambda x: x = t)) / len(words) * 1000.0 + 5 WHEN len(list_filter(words, lambda x: contains(x, t))) > 0 THEN 2.5 ELSE 0.0 END)) AS raw FROM t), reranked AS (SELECT qid, id, round(0.6::DOUBLE * score / max(score) OVER w + 0.4::DOUBLE * coalesce((raw - min(raw) OVER w) / nullif(max(raw) OVER w - min(raw) OVER w, 0), 0), 4) AS score FROM r WINDOW w AS (PARTITION BY qid))"


@query("rt04_dynamic_weights", f"SELECT item_id, class, {_W_SQL(0)} AS w_vec, {_W_SQL(1)} AS w_bm25 FROM (SELECT item_id, {_CLASS_SQL} AS class FROM benchmark)")
def rt04(spark, d):
    """RT04: a query's class and the weights of its recalls."""
    return table(spark, d, "benchmark").select("item_id", query_class(F.col("text")).alias("class")).select("item_id", "class", class_weight(F.col("class"), 0).alias("w_vec"), class_weight(F.col("class"), 1).alias("w_bm25"))


@query("rt07_bigrams", "SELECT qid, array_to_string(list_transform(range(1, length(terms[1])), lambda i: substring(terms[1], i, 2)), ' OR ') AS bigrams FROM questions WHERE len(terms) > 0", "questions")
def rt07(spark, d):
    """RT07: the first term's bigrams, the fallback of a query without hits."""
    t = F.col("terms")[0]
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return V.questions(spark, d).filter(F.size("terms") > 0).select("qid", F.array_join(grams, " OR ").alias("bigrams"))


def local_rerank(spark, d, top):
    """qid, id, score of candidates (qid, id, score): term frequency, or a term inside a word; blended with the first score."""
    asked = V.questions(spark, d).select("qid", "terms")
    t = top.join(V.chunks(spark, d).select("id", "content"), "id").join(asked, "qid").withColumn("words", V.tokens(F.col("content")))
    n = lambda test: F.size(F.filter("words", test))
    one = lambda t: F.when(F.array_contains(F.col("words"), t), n(lambda x: x == t) / F.size("words") * 1000.0 + 5).when(F.exists("words", lambda x: F.contains(x, t)), 2.5).otherwise(0.0)
    r = t.select("qid", "id", "score", F.aggregate(F.transform("terms", one), F.lit(0.0), lambda s, x: s + x).alias("raw"))
    w = Window.partitionBy("qid")
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    part = F.coalesce((F.col("raw") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))
    return r.select("qid", "id", F.round(0.6 * F.col("score") / F.max("score").over(w) + 0.4 * part, 4).alias("score"))


@query("rt16_local_rerank", f"WITH {top_sql(40)}, {rerank_sql()} SELECT * FROM reranked", "chunks postings questions")
def rt16(spark, d):
    """RT16: local re-rank of the forty best."""
    return local_rerank(spark, d, ranked(bm25(spark, d), limit=40).select("qid", "id", "score"))


@query("rt18_rerank_key", f"WITH {TOP} SELECT qid, substring(md5(string_agg(id, ',' ORDER BY rank)), 1, 12) AS cache_key FROM top GROUP BY qid", "chunks postings questions")
def rt18(spark, d):
    """RT18: key of the re-rank cache, from the candidates in order."""
    top = ranked(bm25(spark, d), limit=30)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    return top.groupBy("qid").agg(F.substring(F.md5(F.array_join(ids, ",")), 1, 12).alias("cache_key"))


@query("pf11_preview", f"WITH {TOP} SELECT qid, top.id, rank, substring(content, 1, 160) AS preview FROM top JOIN chunks c ON c.id = top.id", "chunks postings questions")
def pf11(spark, d):
    """PF11: the debug listing, 30 rows a query with 160 characters each."""
    top = ranked(bm25(spark, d), limit=30)
    return top.join(V.chunks(spark, d).select("id", "content"), "id").select("qid", "id", "rank", F.substring("content", 1, 160).alias("preview"))


@query("rt19_models", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(text), '[A-Z]{2,}[-_]?[0-9]{2,}'))), ' ') AS models FROM documents")
def rt19(spark, d):
    """RT19 over the test texts: model codes in a text, whatever their case."""
    codes = F.regexp_extract_all(F.upper("text"), F.lit("[A-Z]{2,}[-_]?[0-9]{2,}"), F.lit(0))
    return V.documents(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(codes)), " ").alias("models"))


@query("pf08_compile_gate", "SELECT id, size >= 200 AND (category IN ('en', 'de') OR authority >= 4) AS compiles FROM files", "files")
def pf08(spark, d):
    """PF08: long enough, and of a wanted kind or of high authority."""
    return V.files(spark, d).select("id", ((F.col("size") >= 200) & (F.col("category").isin("en", "de") | (F.col("authority") >= 4))).alias("compiles"))


@query("gr04_series", "SELECT regexp_extract(p_brand, '^[^0-9]*[0-9]') AS series, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS variants FROM part GROUP BY 1")
def gr04(spark, d):
    """GR04: variants merged under their series; sets combine before the shuffle."""
    return table(spark, d, "part").groupBy(F.regexp_extract("p_brand", "^[^0-9]*[0-9]", 0).alias("series")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("variants"))


@query("gr05_prefix_rules", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)^standard') THEN 'norm' WHEN regexp_matches(p_type, '(?i)^(small|medium)') THEN 'size' WHEN regexp_matches(p_type, '(?i)^(economy|promo)') THEN 'price' ELSE 'other' END AS domain FROM part")
def gr05(spark, d):
    """GR05: ordered prefix rules, the first match wins, with a default."""
    hit = lambda p: F.col("p_type").rlike(p)
    domain = F.when(hit("(?i)^standard"), "norm").when(hit("(?i)^(small|medium)"), "size").when(hit("(?i)^(economy|promo)"), "price").otherwise("other")
    return table(spark, d, "part").select("p_partkey", domain.alias("domain"))


def packs(text, size: int = 400):
    """WN05: number of pieces when paragraphs are packed in order until the next one would pass ``size``; a sum that
    starts anew, kept inside the row. Null and blank texts have none."""
    parts = F.filter(F.split(text, "\n", -1), lambda p: F.trim(p) != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("run"))
    full = lambda s, p: (s["run"] > 0) & (s["run"] + F.length(p) > size)
    step = lambda s, p: F.struct((s["n"] + full(s, p).cast("int")).alias("n"), (F.when(full(s, p), 0).otherwise(s["run"]) + F.length(p)).alias("run"))
    return F.coalesce(F.aggregate(parts, start, step, lambda s: s["n"] + (s["run"] > 0).cast("int")), F.lit(0)).cast("long")


@query("wn05_packing", """WITH RECURSIVE p AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(x)) AS l FROM documents),
w(doc_id, l, i, packs, run) AS (SELECT doc_id, l, 0, 0, 0 FROM p UNION ALL
 SELECT doc_id, l, i + 1, packs + CASE WHEN run > 0 AND run + l[i + 1] > 400 THEN 1 ELSE 0 END, CASE WHEN run > 0 AND run + l[i + 1] > 400 THEN 0 ELSE run END + l[i + 1] FROM w WHERE i < len(l))
SELECT doc_id, CAST(packs + CASE WHEN run > 0 THEN 1 ELSE 0 END AS BIGINT) AS packs FROM w WHERE i = coalesce(len(l), 0)""")
def wn05(spark, d):
    """WN05: paragraphs packed into pieces of 400 characters."""
    return V.documents(spark, d).select("doc_id", packs(F.col("text")).alias("packs"))


@query("tx25_web_context", "WITH p AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, url, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY page_id) AS n FROM pages QUALIFY n <= 5) SELECT host, string_agg('[' || n || '] ' || url, chr(10) ORDER BY n) AS context FROM p GROUP BY host")
def tx25(spark, d):
    """TX25: numbered context of the five first results of a host."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "url", "page_id")
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).filter("n <= 5")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", "url"))), lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["url"]))
    return p.groupBy("host").agg(F.array_join(lines, "\n").alias("context"))


@query("tk10_relevant_results", VEC + " SELECT qid, id, score FROM s QUALIFY score >= 0.15 OR row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 2")
def tk10(spark, d):
    """TK10: results at 0.15 or more, two of each query in any case."""
    least = 0.15
    # two of each query are ranked; the others, most of all pairs perhaps, are neither sorted nor shuffled
    few = ranked(nearest_vectors(spark, d, 2), limit=2).filter(F.col("score") < least)
    return relevant_vectors(spark, d, least).select("qid", "id", "score").union(few.select("qid", "id", "score"))


@query("sk13_retention", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 7")
def sk13(spark, d):
    """SK13: the last seven snapshots of each owner; Spark limits each group before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", "ts").withColumn("_n", F.row_number().over(w)).filter("_n <= 7").select("user_id", "event_id")


@query("st10_utc", "SELECT event_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def st10(spark, d):
    """ST10: local times of UTC+8 moved to UTC."""
    at = F.to_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai")
    return table(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("utc"))
