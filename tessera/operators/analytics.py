"""Conversations, citations, feedback, metrics and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans import views as V
from ..registry import query
from ..session import table


@query("ag01_folders", "SELECT folder, count(*) AS n FROM files GROUP BY folder", "files")
def ag01(spark, d):
    """AG01: counts by folder."""
    return V.files(spark, d).groupBy("folder").agg(F.count("*").alias("n"))


@query("ag02_status", "SELECT event_type, count(*) AS n, count(*) > 5 AS warn FROM events GROUP BY event_type")
def ag02(spark, d):
    """AG02: counts by status with the warning."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count("*") > 5).alias("warn"))


@query("ag05_feedback_decay", "SELECT user_id, round(sum(exp(-ln(2) * (epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / (7 * 86400.0))), 6) AS eff, round(1 / (1 + 0.5 * sum(exp(-ln(2) * (epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / (7 * 86400.0)))), 6) AS penalty FROM events WHERE event_type = 'error' GROUP BY user_id HAVING sum(exp(-ln(2) * (epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / (7 * 86400.0))) >= 2")
def ag05(spark, d):
    """AG05: time-decayed downvotes and their penalty; now is a parameter."""
    age = F.lit(1706659200.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    g = table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.sum(F.exp(F.lit(-0.6931471805599453) * age / (7 * 86400.0))).alias("e"))
    return g.filter("e >= 2").select("user_id", F.round("e", 6).alias("eff"), F.round(1 / (1 + 0.5 * F.col("e")), 6).alias("penalty"))


@query("ag06_down_counts", "SELECT user_id, count(*) AS downs FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3")
def ag06(spark, d):
    """AG06: raw counts with a threshold."""
    return table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("downs")).filter("downs >= 3")


#: Bounds of the latency histogram (fixed values).
BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1000)
BUCKET = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}" for b in BOUNDS) + " ELSE 999999 END"


@query("ag12_latency_histogram", f"WITH h AS (SELECT event_type, CAST({BUCKET} AS BIGINT) AS bound, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, bound, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bound) AS BIGINT) AS upto FROM h")
def ag12(spark, d):
    """AG12: latency histogram with running counts; percentiles read off the running count."""
    b = F
    for x in BOUNDS:
        b = b.when(F.col("value") <= x, x)
    h = table(spark, d, "events").groupBy("event_type", b.otherwise(999999).cast("long").alias("bound")).agg(F.count("*").alias("n"))
    return h.withColumn("upto", F.sum("n").over(Window.partitionBy("event_type").orderBy("bound")))


@query("ag13_rates", "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'error') / greatest(count(*), 1), 4) AS error_rate, round(count(*) FILTER (WHERE event_type = 'purchase') / greatest(count(*), 1), 4) AS hit_rate FROM events GROUP BY user_id")
def ag13(spark, d):
    """AG13: conditional rates."""
    rate = lambda k: F.round(F.count(F.when(F.col("event_type") == k, 1)) / F.greatest(F.count("*"), F.lit(1)), 4)
    return table(spark, d, "events").groupBy("user_id").agg(rate("error").alias("error_rate"), rate("purchase").alias("hit_rate"))


@query("ag16_kb_meta", "SELECT (SELECT count(*) FROM files WHERE NOT deleted) AS files, (SELECT count(*) FROM chunks) AS chunks", "files chunks")
def ag16(spark, d):
    """AG16: size of the knowledge base."""
    f = V.files(spark, d).filter("not deleted").agg(F.count("*").alias("files"))
    return f.crossJoin(V.chunks(spark, d).agg(F.count("*").alias("chunks")))


@query("ag19_timeline", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def ag19(spark, d):
    """AG19: timeline by truncated time."""
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("ag21_token_estimate", "SELECT conv_id, CAST(sum(greatest(1, length(text) // 2)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def ag21(spark, d):
    """AG21: estimated tokens of conversations."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 2))).cast("long").alias("tokens"))


@query("ag22_suggestions", "SELECT DISTINCT category FROM files ORDER BY category LIMIT 5", "files")
def ag22(spark, d):
    """AG22: the first five categories."""
    return V.files(spark, d).select("category").distinct().orderBy("category").limit(5)


@query("ag23_freshness", "SELECT count(*) AS n, max(ts) AS newest, max(ts) > TIMESTAMP '2024-01-29' AS fresh FROM events")
def ag23(spark, d):
    """AG23: count, newest and freshness."""
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.max("ts").alias("newest"), (F.max("ts") > F.lit("2024-01-29").cast("timestamp")).alias("fresh"))


@query("wn06_history_trim", "WITH h AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM conversations) SELECT conv_id, turn FROM h WHERE rn <= 20 AND (upto <= 1200 OR rn = 1)")
def wn06(spark, d):
    """WN06: the newest messages within a budget, one at least."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    h = table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("rn"), F.sum(F.length("text")).over(w).alias("upto"))
    return h.filter("rn <= 20 and (upto <= 1200 or rn = 1)").select("conv_id", "turn")


@query("wn07_context_budget", "WITH c AS (SELECT file_id, chunk_index, least(length(content), 800) AS n FROM chunks), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM c) SELECT file_id, count(*) AS refs, CAST(sum(n) AS BIGINT) AS chars FROM b WHERE held < 6000 GROUP BY file_id", "chunks")
def wn07(spark, d):
    """WN07: references until the budget is reached."""
    w = Window.partitionBy("file_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    n = F.least(F.length("content"), F.lit(800))
    b = V.chunks(spark, d).select("file_id", "chunk_index", n.alias("n")).withColumn("held", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return b.filter("held < 6000").groupBy("file_id").agg(F.count("*").alias("refs"), F.sum("n").alias("chars"))


@query("wn09_cache_eviction", "SELECT event_id, value FROM events QUALIFY row_number() OVER (ORDER BY value DESC, event_id DESC) <= 500")
def wn09(spark, d):
    """WN09: the 500 best; a global top-k, taken in each partition first."""
    return table(spark, d, "events").orderBy(F.desc("value"), F.desc("event_id")).limit(500).select("event_id", "value")


@query("wn10_failed_tasks", "SELECT user_id, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def wn10(spark, d):
    """WN10: last 20 failures of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").filter("event_type = 'error'").withColumn("n", F.row_number().over(w)).filter("n <= 20").select("user_id", "event_id")


@query("rt02_route", "SELECT item_id, CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN 'exact' WHEN length(text) > 300 THEN 'complex' WHEN contains(lower(text), ' the ') THEN 'semantic' ELSE 'general' END AS route FROM benchmark")
def rt02(spark, d):
    """RT02 over the test texts: routing ladder, first match wins."""
    r = F.when(F.col("text").rlike("[0-9]{3,}"), "exact").when(F.length("text") > 300, "complex").when(F.contains(F.lower("text"), F.lit(" the ")), "semantic").otherwise("general")
    return table(spark, d, "benchmark").select("item_id", r.alias("route"))


@query("rt25_multiturn", "WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role = 'user') SELECT conv_id, turn, md5(CASE WHEN prev IS NOT NULL AND length(text) <= 60 THEN prev || ' ' || text ELSE text END) AS resolved FROM u")
def rt25(spark, d):
    """RT25: short follow-ups take up the user's turn before."""
    u = table(spark, d, "conversations").filter("role = 'user'")
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return u.withColumn("prev", prev).select("conv_id", "turn", F.md5(F.when(F.col("prev").isNotNull() & (F.length("text") <= 60), F.concat_ws(" ", "prev", "text")).otherwise(F.col("text"))).alias("resolved"))


@query("so04_jaccard", "WITH u AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+')) AS t FROM conversations), p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM u) SELECT conv_id, turn, round(len(list_intersect(t, q)) / greatest(len(list_distinct(list_concat(t, q))), 1), 4) AS overlap FROM p WHERE q IS NOT NULL")
def so04(spark, d):
    """SO04: token overlap of consecutive turns."""
    u = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(V.tokens(F.col("text"))).alias("t"))
    p = u.withColumn("q", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("q is not null")
    return p.select("conv_id", "turn", F.round(F.size(F.array_intersect("t", "q")) / F.greatest(F.size(F.array_union("t", "q")), F.lit(1)), 4).alias("overlap"))


@query("rt30_citations", "WITH n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text || ' [1] [' || (doc_id % 8 + 1) || ']', '\\[([0-9]{1,9})\\]', 1), lambda x: CAST(x AS BIGINT))) AS refs FROM documents) SELECT doc_id, CAST(len(refs) AS BIGINT) AS cited, CAST(len(list_filter(refs, lambda r: r > 5)) AS BIGINT) AS phantom, round(len(list_filter(refs, lambda r: r <= 5)) / greatest(len(refs), 1), 3) AS score FROM n")
def rt30(spark, d):
    """RT30 over whole texts: cited references, phantoms beyond the five given, and the grounded share."""
    a = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" [1] ["), (F.col("doc_id") % 8 + 1).cast("string"), F.lit("]")).alias("answer"))
    refs = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit("\\[([0-9]{1,9})\\]"), F.lit(1)), lambda x: x.cast("long")))
    n = a.select("doc_id", refs.alias("refs"))
    size = lambda c: F.size(c).cast("long")
    return n.select("doc_id", size("refs").alias("cited"), size(F.filter("refs", lambda r: r > 5)).alias("phantom"), F.round(F.size(F.filter("refs", lambda r: r <= 5)) / F.greatest(F.size("refs"), F.lit(1)), 3).alias("score"))


@query("tk09_page", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def tk09(spark, d):
    """TK09: one page of an ordered list."""
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20).select("p_partkey", "p_name")
