"""Pages with versions, and orders of a re-ranker that are kept for a day.

A page's state after each edit is a running fold over its edits. It is taken in blocks of edits: within a block by a window,
and from the blocks before it by one row a block, so that a page with very many edits is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import views as V
from ..registry import query
from ..session import table
from .ranking import local_rerank, rerank_sql, top_sql
from .retrieval import bm25, ranked
from .tables import Store

FIELDS = ("title", "content", "status", "changed_by")
EDITS = f"page_id long, at long, {', '.join(f'{c} string' for c in FIELDS)}"
PAGE = ["page_id", "version", *FIELDS]
BY = "llm"  # the author of a page that names none (a fixed value)


def slug(title) -> Column:
    """Words of a title in lower case, joined by hyphens; ``untitled`` where there are none or the title is null."""
    s = F.btrim(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}_]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def unique_slugs(pages: DataFrame, step: int = 4096) -> DataFrame:
    """SK09: page_id, slug of pages (page_id, title): a slug's first page has it as it is, later ones with the next number that
    is no other page's plain slug. Numbered slugs of different stems can't be equal, so that all are unique. Pages of a stem are
    numbered in ranges of ids. Rows that share an id must be one before; an empty table gives an empty one."""
    p = pages.select("page_id", slug(F.col("title")).alias("base"), F.floor(F.col("page_id") / step).alias("block"))
    own = F.row_number().over(Window.partitionBy("base", "block").orderBy("page_id"))
    before = Window.partitionBy("base").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = p.groupBy("base", "block").agg(F.count("*").alias("n")).withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    k = p.withColumn("own", own).join(held, ["base", "block"]).select("page_id", "base", (F.col("own") + F.col("held") - 1).alias("k"))
    # numbers of a stem that are plain slugs themselves
    plain = p.select("base").distinct().select(F.regexp_extract("base", r"^(.+)-([1-9][0-9]{0,17})$", 1).alias("stem"), F.regexp_extract("base", r"^(.+)-([1-9][0-9]{0,17})$", 2).cast("long").alias("t")).filter("stem <> ''")
    taken = plain.groupBy(F.col("stem").alias("base")).agg(F.sort_array(F.collect_list("t")).alias("taken"))
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), F.col("k"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return k.join(taken, "base", "left").select("page_id", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", free.cast("string"))).alias("slug"))


def page_history(edits: DataFrame, before: DataFrame | None = None, step: int = 1024) -> DataFrame:
    """SK09: a row for each version: page_id, version, the page's fields after it, ``kept`` (the text its history holds).

    ``edits`` are rows of EDITS, unique by (page_id, at), in the order of ``at``; a null field is not given. The first edit of a
    page that ``before`` (PAGE, the pages as they stand) doesn't hold creates it as version 1, with empty text and the author BY
    where it names none. Each later edit that gives a field adds one to the version; one that gives none is no edit. The
    history holds the edit's text, or the text before it where the edit gives none or an empty one; an empty author counts
    as not given there. Edits without page_id or at are left out."""
    e = edits.filter("page_id is not null and at is not null").withColumn("block", F.floor(F.col("at") / step))
    first = e.groupBy("page_id").agg(F.min("at").alias("born"))
    if before is not None:
        first = first.join(before.select("page_id"), "page_id", "left_anti")
    e = e.join(first, "page_id", "left").withColumn("creates", F.coalesce(F.col("at") == F.col("born"), F.lit(False))).drop("born")
    e = e.filter(F.col("creates") | F.coalesce(*FIELDS).isNotNull())
    made = lambda c, v: F.when(F.col("creates"), F.coalesce(c, F.lit(v))).otherwise(F.col(c))
    e = e.withColumns({"content": made("content", ""), "changed_by": made("changed_by", BY)})
    start = before if before is not None else edits.sparkSession.createDataFrame([], f"page_id long, version long, {', '.join(f'{c} string' for c in FIELDS)}")

    upto = Window.partitionBy("page_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("page_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("page_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c].alias(c)
    carried = e.groupBy("page_id", "block").agg(F.count("*").alias("n"), *(newest(c) for c in FIELDS))
    carried = carried.select("page_id", "block", F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("_n"), *(F.last(c, ignorenulls=True).over(blocks).alias(f"_{c}") for c in FIELDS))
    carried = carried.join(start.select("page_id", F.col("version").alias("_v"), *(F.col(c).alias(f"_s_{c}") for c in FIELDS)), "page_id", "left")
    carried = carried.select("page_id", "block", (F.col("_n") + F.coalesce("_v", F.lit(0))).alias("_n"), *(F.coalesce(f"_{c}", f"_s_{c}").alias(f"_{c}") for c in FIELDS))

    rows = e.withColumns({"n": F.row_number().over(Window.partitionBy("page_id", "block").orderBy("at"))} | {f"now_{c}": F.last(c, ignorenulls=True).over(upto) for c in FIELDS} | {f"was_{c}": F.last(c, ignorenulls=True).over(above) for c in ("content", "changed_by")})
    rows = rows.join(carried, ["page_id", "block"])
    was = lambda c: F.coalesce(f"was_{c}", f"_{c}")
    given = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), was(c), F.col(c))
    return rows.select(
        "page_id", (F.col("n") + F.col("_n")).alias("version"), *(F.coalesce(f"now_{c}", f"_{c}").alias(c) for c in FIELDS), given("content").alias("kept"), given("changed_by").alias("kept_by")
    )


def apply_edits(store: Store, edits: DataFrame) -> None:
    """Tables ``pages`` (PAGE) and ``versions`` (page_id, version, content, changed_by) of a store, taken on by a batch of edits:
    versions are only appended, pages replaced by their newest state."""
    new = store.put("batch", page_history(edits, store.get("pages") if "pages" in store.at else None))
    store.append("versions", new.select("page_id", "version", F.col("kept").alias("content"), F.col("kept_by").alias("changed_by")))
    rest = F.struct(*PAGE[1:])
    pages = new.groupBy("page_id").agg(F.max_by(rest, "version").alias("p")).select("page_id", *(F.col(f"p.{c}").alias(c) for c in PAGE[1:]))
    store.upsert("pages", pages, ["page_id"]) if "pages" in store.at else store.put("pages", pages)


def talk_edits(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as the edits of a page: a user's turn gives title and text, an answer the text, a system turn the state."""
    role = F.col("role")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("at"), F.when(role == "user", F.substring("text", 1, 30)).alias("title"), F.when(role != "system", F.col("text")).alias("content"),
        F.when(role == "system", "reviewed").alias("status"), F.when(role == "user", "user").when(role == "assistant", BY).alias("changed_by"),
    )


EDITS_SQL = f"e AS (SELECT conv_id AS page_id, turn AS nth, CASE WHEN role = 'user' THEN substring(text, 1, 30) END AS title, CASE WHEN role <> 'system' THEN text END AS content, CASE WHEN role = 'system' THEN 'reviewed' END AS status, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN '{BY}' END AS changed_by FROM conversations)"
HISTORY_SQL = f"""{EDITS_SQL}, m AS (SELECT * REPLACE (CASE WHEN b THEN coalesce(content, '') ELSE content END AS content, CASE WHEN b THEN coalesce(changed_by, '{BY}') ELSE changed_by END AS changed_by) FROM (SELECT *, nth = min(nth) OVER (PARTITION BY page_id) AS b FROM e) WHERE b OR coalesce(title, content, status, changed_by) IS NOT NULL),
h AS (SELECT page_id, nth, row_number() OVER w AS version, content, changed_by, last_value(title IGNORE NULLS) OVER u AS now_title, last_value(status IGNORE NULLS) OVER u AS now_status, last_value(content IGNORE NULLS) OVER u AS now_content, last_value(content IGNORE NULLS) OVER a AS was_content, last_value(changed_by IGNORE NULLS) OVER a AS was_by FROM m
 WINDOW w AS (PARTITION BY page_id ORDER BY nth), u AS (PARTITION BY page_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY page_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("sk09_page_versions", f"WITH {HISTORY_SQL} SELECT page_id, version, md5(coalesce(nullif(content, ''), was_content, content)) AS digest, coalesce(nullif(changed_by, ''), was_by, changed_by) AS changed_by, version = max(version) OVER (PARTITION BY page_id) AS current FROM h")
def sk09_versions(spark, d):
    """SK09: the history of all pages, written by two batches of edits."""
    s = Store(spark)
    edits = talk_edits(spark, d)
    apply_edits(s, edits.filter("at < 3"))
    apply_edits(s, edits.filter("at >= 3"))
    last = s.get("pages").select("page_id", F.col("version").alias("top"))
    return s.get("versions").join(last, "page_id").select("page_id", "version", F.md5("content").alias("digest"), "changed_by", (F.col("version") == F.col("top")).alias("current"))


@query("sk09_pages", f"WITH {HISTORY_SQL} SELECT page_id, version, now_title AS title, now_status AS status, md5(now_content) AS digest FROM h QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY version DESC) = 1")
def sk09_pages(spark, d):
    """SK09: the pages as they stand after all edits."""
    s = Store(spark)
    edits = talk_edits(spark, d)
    apply_edits(s, edits.filter("at % 8 < 5"))
    apply_edits(s, edits.filter("at % 8 >= 5"))
    return s.get("pages").select("page_id", "version", "title", "status", F.md5("content").alias("digest"))


_STEM = "'^(.+)-([1-9][0-9]{0,17})$'"
TITLES_SQL = "(SELECT doc_id AS page_id, regexp_extract(text, '^[^\\n]*?([^ \\n]+)', 1) AS title FROM documents)"


@query(
    "sk09_page_slugs",
    f"WITH p AS (SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), '-'), ''), 'untitled') AS base FROM {TITLES_SQL}), k AS (SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) - 1 AS k FROM p), t AS (SELECT regexp_extract(base, {_STEM}, 1) AS base, list(regexp_extract(base, {_STEM}, 2)::BIGINT ORDER BY regexp_extract(base, {_STEM}, 2)::BIGINT) AS taken FROM (SELECT DISTINCT base FROM p) WHERE regexp_matches(base, {_STEM}) GROUP BY 1) SELECT page_id, CASE WHEN k = 0 THEN base ELSE base || '-' || list_reduce(list_prepend(k, coalesce(taken, [])), lambda n, t: CASE WHEN t <= n THEN n + 1 ELSE n END) END AS slug FROM k LEFT JOIN t USING (base)",
)
def sk09_slugs(spark, d):
    """SK09: unique slugs of pages that have the first word of a text as their title."""
    return unique_slugs(V.documents(spark, d).select(F.col("doc_id").alias("page_id"), F.regexp_extract("text", r"^[^\n]*?([^ \n]+)", 1).alias("title")))


# --- re-ranked orders

#: Full-width signs, and the plain ones that they stand for.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
PLAIN = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Hours that an order is good for (a fixed value).
HOURS = 24
KEY = ["q", "top_k", "fp"]


def normal_query(text) -> Column:
    """Plain signs for full-width ones, lower case, single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), WIDE, PLAIN)), r"\s+", " "))


def keyed(candidates: DataFrame, top_k: int) -> DataFrame:
    """qid, q, top_k, fp of candidates (qid, query, id, rank): what an order is kept under. The fingerprint is over the ids in
    order, so that another set or order of candidates finds nothing. Ids that are null don't count."""
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("rank", "id")))), lambda x: x["id"].cast("string"))
    return candidates.groupBy("qid").agg(normal_query(F.first("query", ignorenulls=True)).alias("q"), F.lit(top_k).alias("top_k"), F.substring(F.md5(F.array_join(ids, ",")), 1, 12).alias("fp"))


def orders(candidates: DataFrame, results: DataFrame, top_k: int, created_at) -> DataFrame:
    """Rows of the cache: q, top_k, fp, seq (id and score in the order of ``results``: qid, id, score), created_at. Queries that are
    equal when normalised, with equal candidates, leave one row."""
    best = results.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= top_k)
    seq = best.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "id", "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("seq"))
    rows = keyed(candidates, top_k).join(seq, "qid").withColumn("created_at", created_at)
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("seq", "created_at"), F.struct("created_at", "qid")).alias("r")).select(*KEY, "r.seq", "r.created_at")


def purged(cache: DataFrame, now) -> DataFrame:
    """The rows that are younger than HOURS, or have no time."""
    return cache.filter(F.col("created_at").isNull() | (F.col("created_at") >= now - F.expr(f"interval {HOURS} hours")))


def reordered(candidates: DataFrame, cache: DataFrame, top_k: int, now) -> DataFrame:
    """RT18: qid, state (hit, expired, miss), id, place, score: the ``top_k`` candidates of each query in the order that is kept
    under its key, with the score kept there; candidates that the order lacks follow as they came. Without a good order they
    stay as they came. A candidate that comes twice counts once."""
    c = candidates.filter("id is not null").groupBy("qid", "id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    good = F.col("created_at").isNull() | (F.col("created_at") >= now - F.expr(f"interval {HOURS} hours"))
    found = keyed(candidates, top_k).join(cache, KEY, "left").select("qid", F.when(F.col("seq").isNull(), "miss").when(good, "hit").otherwise("expired").alias("state"), "seq")
    kept = found.filter("state = 'hit'").select("qid", F.posexplode("seq").alias("at", "s")).groupBy("qid", F.col("s.id").alias("id")).agg(F.min(F.struct("at", "s.score")).alias("s"))
    rows = c.join(found.select("qid", "state"), "qid").join(kept, ["qid", "id"], "left")
    w = Window.partitionBy("qid").orderBy(F.col("s.at").asc_nulls_last(), "rank", "id")
    return rows.select("qid", "state", "id", F.row_number().over(w).alias("place"), F.round(F.coalesce("s.score", "score"), 4).alias("score")).filter(F.col("place") <= top_k)


_quote = lambda s: "'" + s.replace("'", "''") + "'"
_NORMAL_SQL = f"trim(regexp_replace(lower(translate(text, {_quote(WIDE)}, {_quote(PLAIN)})), '\\s+', ' ', 'g'))"
_FP = "substring(md5(string_agg(id, ',' ORDER BY rank)), 1, 12)"


@query(
    "rt18_rerank_cache",
    f"""WITH {top_sql(40)}, {rerank_sql()}, c AS (SELECT qid, {_NORMAL_SQL} AS q, {_FP} AS fp FROM top JOIN questions USING (qid) GROUP BY qid, text),
seq AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS nth FROM reranked QUALIFY nth < 10),
own AS (SELECT q, fp, max(qid) AS qid FROM c GROUP BY q, fp),
late AS (SELECT top.*, text FROM top JOIN questions USING (qid) WHERE NOT (qid % 5 = 0 AND rank = 1)),
f AS (SELECT l.qid, own.qid AS made FROM (SELECT qid, {_NORMAL_SQL} AS q, {_FP} AS fp FROM late GROUP BY qid, text) l LEFT JOIN own USING (q, fp)),
g AS (SELECT qid, made, CASE WHEN made IS NULL THEN 'miss' WHEN made % 48 >= 12 THEN 'hit' ELSE 'expired' END AS state FROM f)
SELECT l.qid, state, l.id, row_number() OVER (PARTITION BY l.qid ORDER BY s.nth NULLS LAST, rank, l.id) AS place, round(coalesce(s.score, l.score), 4) AS score FROM late l JOIN g ON g.qid = l.qid LEFT JOIN seq s ON state = 'hit' AND s.qid = g.made AND s.id = l.id QUALIFY place <= 10""",
    "chunks postings questions",
)
def rt18_cache(spark, d):
    """RT18: forty candidates of each question re-ranked and the ten best kept, at different hours; then the questions asked again
    in full-width signs, where some have lost a candidate and some orders are too old."""
    s = Store(spark)
    text = V.questions(spark, d).select("qid", F.col("text").alias("query"))
    top = s.put("top", ranked(bm25(spark, d), limit=40).select("qid", "id", "rank", "score")).join(text, "qid")
    made = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("qid") % 48).cast("int"))
    s.put("cache", orders(top, local_rerank(spark, d, top.select("qid", "id", "score")), 10, made))
    again = top.filter("not (qid % 5 = 0 and rank = 1)").withColumn("query", F.translate("query", PLAIN, WIDE))
    return reordered(again, s.get("cache"), 10, F.lit("2024-01-02 12:00:00").cast("timestamp"))
