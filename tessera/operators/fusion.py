"""Fusion, re-ranking, pinning and filtering of recalled chunks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine, doubles
from ..functions.vectors import nearest
from ..plans import views as V
from ..registry import query
from ..session import bounded, table
from .retrieval import BM25, GRAPH, GRAPH_VIEWS, PHR, best_bm25, graph_hits, name_hits, phrase_hits, ranked

RRF_K = 60
RANKED = f"""{BM25}, {PHR}, r1 AS (SELECT qid, id, file_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= 200),
r2 AS (SELECT qid, id, file_id, row_number() OVER (PARTITION BY qid ORDER BY n DESC, id) AS rank FROM phr QUALIFY rank <= 50)"""
FUSED = f"{RANKED}, fused AS (SELECT qid, id, file_id, round(sum(w / ({RRF_K} + rank)), 6) AS score FROM (SELECT *, 0.65::DOUBLE AS w FROM r1 UNION ALL SELECT *, 0.35::DOUBLE AS w FROM r2) GROUP BY qid, id, file_id)"


def lexical(spark, d) -> DataFrame:
    return best_bm25(spark, d, 200)


def phrases(spark, d) -> DataFrame:
    return ranked(phrase_hits(spark, d).withColumnRenamed("n", "score"), limit=50)


def rrf(sources: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """AG04, RT12: weighted reciprocal rank fusion of ranked recalls (qid, id, file_id, rank from 1)."""
    parts = [s.select("qid", "id", "file_id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for s, w in sources]
    return reduce(DataFrame.unionByName, parts).groupBy("qid", "id", "file_id").agg(F.round(F.sum("part"), 6).alias("score"))


def fused(spark, d) -> DataFrame:
    return rrf([(lexical(spark, d), 0.65), (phrases(spark, d), 0.35)])


#: Vector and lexical weight of each class of query (fixed values), and the patterns that tell a query's class, the first
#: match wins; patterns are a parameter.
WEIGHTS = {"factual": (0.35, 0.65), "semantic": (0.75, 0.25), "action": (0.55, 0.45), "hybrid": (0.60, 0.40)}
CLASSES = (("factual", "[0-9]"), ("semantic", "(^|[^a-z])(why|like|about)([^a-z]|$)"), ("action", "(^|[^a-z])(how|make|use)([^a-z]|$)"))
_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in CLASSES) + " ELSE 'hybrid' END"
_W_SQL = lambda i: "CASE class " + " ".join(f"WHEN '{k}' THEN {w[i]}::DOUBLE" for k, w in WEIGHTS.items()) + " END"


def query_class(text) -> F.Column:
    kind = F
    for name, pattern in CLASSES:
        kind = kind.when(F.lower(text).rlike(pattern), name)
    return kind.otherwise("hybrid")


def class_weight(kind, which: int) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, w in WEIGHTS.items() for x in (k, w[which])]), kind)


#: The four recalls of a query, ranked, as (qid, id, file_id, rank, source): words and phrase merged by their better rank;
#: the files' vectors against the question's; the graph; file names.
RECALLS = f"""{RANKED}, {GRAPH},
lex AS (SELECT qid, id, file_id, row_number() OVER (PARTITION BY qid ORDER BY r, id) AS rank FROM (SELECT qid, id, file_id, min(rank) AS r FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY qid, id, file_id) QUALIFY rank <= 200),
first_c AS (SELECT file_id, min(id) AS id FROM chunks GROUP BY file_id),
qd AS (SELECT qid, norm, unnest(range(0, len(v))) AS d, unnest(v) AS n FROM question_vectors), cd AS (SELECT id, file_id, norm, unnest(range(0, len(v))) AS d, unnest(v) AS n FROM vectors),
vec AS (SELECT qid, id, file_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM (SELECT qid, id, file_id, round(CAST(sum(qd.n * cd.n) AS DOUBLE) / (qd.norm * cd.norm), 6) AS s FROM qd JOIN cd ON qd.d = cd.d AND qd.n <> 0 AND cd.n <> 0 GROUP BY qid, id, file_id, qd.norm, cd.norm) WHERE s > 0 QUALIFY rank <= 50),
gra AS (SELECT qid, id, file_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM graph QUALIFY rank <= 50),
fil AS (SELECT qid, id, file_id, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id) AS rank FROM (SELECT qid, f.id AS file_id, count(*) AS hits FROM (SELECT DISTINCT qid, unnest(terms) AS term FROM questions) t JOIN files f ON contains(lower(f.name), t.term) GROUP BY qid, f.id) JOIN first_c USING (file_id) QUALIFY rank <= 50)"""
VIEWS = "files " + GRAPH_VIEWS + " vectors question_vectors"
FUSED4 = f"""{RECALLS}, cls AS (SELECT qid, {_W_SQL(0)} AS v, {_W_SQL(1)} AS b FROM (SELECT qid, {_CLASS_SQL} AS class FROM questions)),
fused AS (SELECT qid, id, file_id, round(sum(w / ({RRF_K} + rank)), 6) AS score FROM (SELECT lex.*, b AS w FROM lex JOIN cls USING (qid) UNION ALL SELECT vec.*, v FROM vec JOIN cls USING (qid) UNION ALL SELECT gra.*, v FROM gra JOIN cls USING (qid) UNION ALL SELECT fil.*, greatest(v, b) FROM fil JOIN cls USING (qid)) GROUP BY qid, id, file_id)"""


def first_chunks(spark, d) -> DataFrame:
    return V.chunks(spark, d).groupBy("file_id").agg(F.min("id").alias("id"))


def vector_hits(spark, d) -> DataFrame:
    """RT34, RT08: the 50 chunks nearest to each question by their hashed words, all chunks compared; only those with a
    positive cosine count."""
    near = nearest(V.question_vectors(spark, d), V.vectors(spark, d), 50).filter("score > 0")
    return ranked(near, limit=50).select("qid", "id", F.expr(f"id div {V.PLACES}").alias("file_id"), "score", "rank")


def file_hits(spark, d) -> DataFrame:
    asked = V.questions(spark, d).select("qid", F.explode("terms").alias("term")).distinct()
    hits = name_hits(V.files(spark, d).select("id", "name"), asked, "qid").groupBy("qid", F.col("id").alias("file_id")).agg(F.count("*").alias("score"))
    return ranked(hits.join(first_chunks(spark, d), "file_id"), limit=50)


def merged_words(spark, d) -> DataFrame:
    """Words and phrase in one list: each chunk at the better of its two ranks."""
    both = lexical(spark, d).select("qid", "id", "file_id", "rank").union(phrases(spark, d).select("qid", "id", "file_id", "rank"))
    best = both.groupBy("qid", "id", "file_id").agg(F.min("rank").alias("r"))
    w = Window.partitionBy("qid").orderBy("r", "id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 200")


def fused_four(spark, d) -> DataFrame:
    """RT12: the four recalls, weighted by the class of the query."""
    kind = V.questions(spark, d).select("qid", query_class(F.col("text")).alias("class"))
    weights = kind.select("qid", class_weight(F.col("class"), 0).alias("v"), class_weight(F.col("class"), 1).alias("b"))
    part = lambda df, w: df.join(weights, "qid").select("qid", "id", "file_id", (w / (RRF_K + F.col("rank"))).alias("part"))
    v, b = F.col("v"), F.col("b")
    parts = [part(merged_words(spark, d), b), part(vector_hits(spark, d), v), part(ranked(graph_hits(spark, d), limit=50), v), part(file_hits(spark, d), F.greatest(v, b))]
    return reduce(DataFrame.unionByName, parts).groupBy("qid", "id", "file_id").agg(F.round(F.sum("part"), 6).alias("score"))


@query("rt12_weighted_rrf", f"WITH {FUSED4.strip()} SELECT qid, id, file_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 30", VIEWS)
def rt12(spark, d):
    """RT12: fusion of words, vectors, graph and file names by weights of the query's class, three times ten best."""
    return ranked(fused_four(spark, d), limit=30)


@query("wn02_source_ranks", f"WITH {RECALLS.strip()} SELECT * FROM (SELECT qid, id, rank, 'words' AS source FROM lex UNION ALL SELECT qid, id, rank, 'vector' FROM vec UNION ALL SELECT qid, id, rank, 'graph' FROM gra UNION ALL SELECT qid, id, rank, 'name' FROM fil) WHERE rank <= 20", VIEWS)
def wn02(spark, d):
    """WN02: ranks from 1 within each query and source, the first twenty of each."""
    named = {"words": merged_words(spark, d), "vector": vector_hits(spark, d), "graph": ranked(graph_hits(spark, d), limit=50), "name": file_hits(spark, d)}
    parts = [df.filter("rank <= 20").select("qid", "id", "rank", F.lit(k).alias("source")) for k, df in named.items()]
    return reduce(DataFrame.union, parts)


@query("rt13_fixed_rrf", f"WITH {RECALLS.strip()} SELECT qid, id, round(sum(0.5::DOUBLE / ({RRF_K} + rank)), 6) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM vec UNION ALL SELECT * FROM gra UNION ALL SELECT * FROM fil) GROUP BY qid, id", VIEWS)
def rt13(spark, d):
    """RT13: fusion of the four recalls with fixed weights."""
    four = [merged_words(spark, d), vector_hits(spark, d), ranked(graph_hits(spark, d), limit=50), file_hits(spark, d)]
    return rrf([(r, 0.5) for r in four]).select("qid", "id", "score")


@query("so06_dual_index_merge", f"WITH {RANKED.strip()} SELECT qid, id, min(rank) AS rank, count(*) AS sources FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY qid, id", "chunks postings questions")
def so06(spark, d):
    """SO06: union of two indexes, best rank of each chunk."""
    both = lexical(spark, d).select("qid", "id", "rank").unionByName(phrases(spark, d).select("qid", "id", "rank"))
    return both.groupBy("qid", "id").agg(F.min("rank").alias("rank"), F.count("*").alias("sources"))


#: Votes against the chunks of a file: their half-life, the strength of the penalty, and the number that bars a chunk from the top.
HALF_LIFE, ALPHA, HARD = 7 * 86400.0, 0.5, 3
#: Codes of models in a query, and words by which a query points to a category (a parameter).
MODEL = "[a-z]{2,5}[ -]?[0-9]{2,6}"
DOMAINS = {"en": " the ", "fr": " les ", "de": " der ", "es": " los "}
_DOMAIN_SQL = "CASE f.category " + " ".join(f"WHEN '{k}' THEN contains(lower(q.text), '{w}')" for k, w in DOMAINS.items()) + " ELSE false END"
_PENALTY_SQL = f"pen AS (SELECT user_id AS file_id, 1 / (1 + {ALPHA}::DOUBLE * sum(exp(-ln(2) * (epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / {HALF_LIFE}::DOUBLE))) AS penalty FROM events WHERE event_type = 'error' GROUP BY user_id)"
PINNED = f"""{FUSED4}, {_PENALTY_SQL},
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM fused QUALIFY r <= 40),
pt AS (SELECT top.qid, top.id, top.file_id, top.r, round(top.score * coalesce(penalty, 1), 6) AS score, coalesce(penalty, 1) <= {1 / (1 + ALPHA * HARD)}::DOUBLE AS hard_down, content FROM top JOIN chunks c USING (id) LEFT JOIN pen ON pen.file_id = top.file_id),
words AS (SELECT pt.*, q.text, list_distinct(q.terms) AS terms, regexp_extract_all(lower(content), '{V.TOKEN}') AS w FROM pt JOIN questions q USING (qid)),
raw AS (SELECT *, coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN list_contains(w, t) THEN len(list_filter(w, lambda x: x = t)) / len(w) * 1000.0::DOUBLE + 5 WHEN len(list_filter(w, lambda x: contains(x, t))) > 0 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END)), 0) AS raw FROM words),
rer AS (SELECT *, round(0.6::DOUBLE * score / max(score) OVER q + 0.4::DOUBLE * CASE WHEN max(raw) OVER q > min(raw) OVER q THEN (raw - min(raw) OVER q) / (max(raw) OVER q - min(raw) OVER q) ELSE 0 END, 4) AS rerank FROM raw WINDOW q AS (PARTITION BY qid)),
pin AS (SELECT q.*, f.name, f.category, f.authority, f.deleted, CASE WHEN hard_down THEN 0 WHEN len(list_filter(regexp_extract_all(lower(q.text), '{MODEL}'), lambda m: regexp_matches(lower(content), '(^|[^a-z0-9])' || m || '($|[^a-z0-9])'))) > 0 THEN CASE WHEN f.authority >= 4 THEN 3 ELSE 2 END WHEN len(list_filter(terms, lambda t: contains(lower(f.name), t))) > 0 OR {_DOMAIN_SQL} THEN 1 ELSE 0 END AS prio FROM rer q JOIN files f ON f.id = q.file_id)"""


def penalties(spark, d) -> DataFrame:
    """RT15: penalty of a file from its decayed votes; the time of the search is a parameter."""
    age = F.lit(1706659200.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    votes = table(spark, d, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("file_id"))
    return votes.agg((1 / (1 + ALPHA * F.sum(F.exp(F.lit(-0.6931471805599453) * age / HALF_LIFE)))).alias("penalty"))


def penalised(spark, d) -> DataFrame:
    """The forty best of the fusion with their penalised scores; the order of the fusion stays."""
    top = ranked(fused_four(spark, d), limit=40, col="r").join(penalties(spark, d), "file_id", "left")
    p = F.coalesce("penalty", F.lit(1.0))
    return top.select("qid", "id", "file_id", "r", F.round(F.col("score") * p, 6).alias("score"), (p <= 1 / (1 + ALPHA * HARD)).alias("hard_down"))


def reranked(spark, d) -> DataFrame:
    """RT16 over the penalised: 0.6 of the score by the best, 0.4 of the terms' weight in the chunk."""
    asked = V.questions(spark, d).select("qid", "terms", "text")
    t = bounded(penalised(spark, d)).join(V.chunks(spark, d).select("id", "content"), "id").join(asked, "qid").withColumn("w", V.tokens(F.col("content")))
    n = lambda test: F.size(F.filter("w", test))
    one = lambda t: F.when(F.array_contains("w", t), n(lambda x: x == t) / F.size("w") * 1000.0 + 5).when(F.exists("w", lambda x: F.contains(x, t)), 2.5).otherwise(0.0)
    t = t.withColumn("raw", F.aggregate(F.transform("terms", one), F.lit(0.0), lambda s, x: s + x))
    w = Window.partitionBy("qid")
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    part = F.coalesce((F.col("raw") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))
    return t.withColumn("rerank", F.round(0.6 * F.col("score") / F.max("score").over(w) + 0.4 * part, 4))


def pinned(spark, d) -> DataFrame:
    """RT21, TK05: 3 for a model of the query in a chunk of high authority, 2 for one in another, 1 for a name or category
    that the query points to, 0 for the rest and whatever votes have barred."""
    f = V.files(spark, d).select(F.col("id").alias("file_id"), "name", "category", "authority", "deleted")
    t = reranked(spark, d).join(f, "file_id")
    low = F.lower("content")
    model = F.exists(F.regexp_extract_all(F.lower("text"), F.lit(MODEL), F.lit(0)), lambda m: F.regexp_like(low, F.concat(F.lit("(^|[^a-z0-9])"), m, F.lit("($|[^a-z0-9])"))))
    domain = F.lit(False)
    for k, word in DOMAINS.items():
        domain = domain | ((F.col("category") == k) & F.contains(F.lower("text"), F.lit(word)))
    named = F.exists("terms", lambda x: F.contains(F.lower("name"), x))
    prio = F.when(F.col("hard_down"), 0).when(model & (F.col("authority") >= 4), 3).when(model, 2).when(named | F.coalesce(domain, F.lit(False)), 1).otherwise(0)
    return t.withColumn("prio", prio.cast("long"))


@query("rt15_penalised", f"WITH {PINNED.strip()} SELECT qid, id, r, score, hard_down FROM pt", VIEWS)
def rt15(spark, d):
    """RT15: scores after the feedback penalty, and whether votes bar the chunk; not sorted anew."""
    return penalised(spark, d).select("qid", "id", "r", "score", "hard_down")


@query("rt21_exact_pin", f"WITH {PINNED.strip()} SELECT qid, id, CAST(prio AS BIGINT) AS prio, row_number() OVER (PARTITION BY qid ORDER BY prio DESC, rerank DESC, r) AS rank FROM pin", VIEWS)
def rt21(spark, d):
    """RT21: pinning of exact matches, the order of the re-rank within a level."""
    w = Window.partitionBy("qid").orderBy(F.desc("prio"), F.desc("rerank"), "r")
    return pinned(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).select("qid", "id", "prio", "rank")


@query("rt01_hybrid_search", f"WITH {PINNED.strip()} SELECT qid, id, name, category, score, rerank, CAST(prio AS BIGINT) AS prio, row_number() OVER (PARTITION BY qid ORDER BY prio DESC, rerank DESC, r) AS rank FROM pin WHERE NOT deleted AND authority >= 1 QUALIFY rank <= 10", VIEWS)
def rt01(spark, d):
    """RT01: four recalls, fusion by the query's class, penalty, re-rank, pin, filter by metadata, ten best."""
    kept = pinned(spark, d).filter("not deleted and authority >= 1")
    w = Window.partitionBy("qid").orderBy(F.desc("prio"), F.desc("rerank"), "r")
    return kept.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("qid", "id", "name", "category", "score", "rerank", "prio", "rank")


@query("tk05_priority", f"WITH {PINNED.strip()} SELECT qid, id, CAST(prio AS BIGINT) AS prio FROM pin", VIEWS)
def tk05(spark, d):
    """TK05: the level of each candidate before the stable sort."""
    return pinned(spark, d).select("qid", "id", "prio")


@query("tk04_rerank_cut", f"WITH {PINNED.strip()} SELECT qid, id, rerank, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, r) AS rank FROM rer QUALIFY rank <= 10", VIEWS)
def tk04(spark, d):
    """TK04: forty are re-ranked, ten stay."""
    w = Window.partitionBy("qid").orderBy(F.desc("rerank"), "r")
    return reranked(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("qid", "id", "rerank", "rank")


@query("rt14_backfill", f"WITH {FUSED4.strip()}, top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 10) SELECT qid, top.id, rank, coalesce(f.category, '') AS category, f.name FROM top LEFT JOIN files f ON f.id = top.file_id", VIEWS)
def rt14(spark, d):
    """RT14: metadata put back to ranked results."""
    f = V.files(spark, d).select(F.col("id").alias("file_id"), "category", "name")
    return ranked(fused_four(spark, d), limit=10).join(f, "file_id", "left").select("qid", "id", "rank", F.coalesce("category", F.lit("")).alias("category"), "name")


@query("pf04_relevance_gate", f"WITH {RANKED.strip()}, c AS (SELECT qid, count(*) AS lexical FROM r1 GROUP BY qid) SELECT q.qid, coalesce(lexical, 0) AS lexical, coalesce(lexical, 0) > 0 AS passes FROM questions q LEFT JOIN c USING (qid)", "chunks postings questions")
def pf04(spark, d):
    """PF04: whether lexical recall found anything for a query."""
    c = lexical(spark, d).groupBy("qid").agg(F.count("*").alias("lexical"))
    n = F.coalesce("lexical", F.lit(0))
    return V.questions(spark, d).join(c, "qid", "left").select("qid", n.alias("lexical"), (n > 0).alias("passes"))


@query("wn04_minmax", f"WITH {FUSED.strip()} SELECT qid, id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 4) AS norm FROM fused WINDOW w AS (PARTITION BY qid)", "chunks postings questions")
def wn04(spark, d):
    """WN04: scores scaled to 0..1 within a query."""
    w = Window.partitionBy("qid")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return fused(spark, d).select("qid", "id", F.round(F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0), 4).alias("norm"))


@query("ag03_file_hits", f"WITH {FUSED.strip()} SELECT * FROM (SELECT qid, file_id, count(*) AS hits, max(score) AS score FROM fused GROUP BY qid, file_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hits DESC, score DESC, file_id) <= 8", "chunks postings questions")
def ag03(spark, d):
    """AG03, TK06: results by file, eight best files."""
    g = fused(spark, d).groupBy("qid", "file_id").agg(F.count("*").alias("hits"), F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("hits"), F.desc("score"), "file_id")
    return g.withColumn("_n", F.row_number().over(w)).filter("_n <= 8").drop("_n")


GOLD = "gold AS (SELECT b.item_id AS qid, d.doc_id AS file_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def golden(spark, d) -> DataFrame:
    """Documents that hold the whole text of an item. They have its longest inner word among their own words, which makes
    the candidates; texts of one or two words are looked for everywhere."""
    q = V.questions(spark, d).select("qid", "text", V.anchor(F.col("text")).alias("term"))
    docs = V.documents(spark, d).select(F.col("doc_id").alias("file_id"), F.col("text").alias("whole"))
    words = docs.select("file_id", F.explode_outer(F.array_distinct(V.tokens(F.col("whole")))).alias("term"))
    met = words.join(q.filter("term is not null"), "term").select("qid", "file_id", "text").join(docs, "file_id").filter(F.contains("whole", "text"))
    short = docs.join(q.filter("term is null"), F.contains("whole", "text"))
    return met.select("qid", "file_id").union(short.select("qid", "file_id"))


#: Gains of the first ten ranks, summed up: the best that so many relevant files can give.
IDEAL = [round(sum(1 / math.log2(i + 1) for i in range(1, n + 1)), 12) for n in range(1, 11)]
METRICS = f"{FUSED.strip()}, {GOLD}, best AS (SELECT qid, file_id, max(score) AS s FROM fused GROUP BY qid, file_id), rk AS (SELECT qid, file_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, file_id) AS rank FROM best QUALIFY rank <= 10), rel AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid), met AS (SELECT rel.qid, rel.n AS relevant, count(rk.rank) AS found, round(coalesce(1.0 / min(rk.rank), 0), 6) AS rr, round(coalesce(sum(1 / log2(rk.rank + 1)), 0), 6) AS dcg, round(coalesce(sum(1 / log2(rk.rank + 1)), 0) / list_extract([{', '.join(f'{x}::DOUBLE' for x in IDEAL)}], CAST(least(rel.n, 10) AS BIGINT)), 6) AS ndcg FROM rel LEFT JOIN (SELECT rk.* FROM rk JOIN gold USING (qid, file_id)) rk ON rk.qid = rel.qid GROUP BY rel.qid, rel.n)"


def metrics(spark, d) -> DataFrame:
    """Recall, reciprocal rank, DCG and nDCG at ten of each question, against the passages known to be relevant."""
    gold = golden(spark, d)
    best = fused(spark, d).groupBy("qid", "file_id").agg(F.max("score").alias("s"))
    w = Window.partitionBy("qid").orderBy(F.desc("s"), "file_id")
    rk = best.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").join(gold, ["qid", "file_id"], "left_semi")
    rel = gold.groupBy("qid").agg(F.count("*").alias("relevant"))
    m = rk.groupBy("qid").agg(F.count("*").alias("found"), (1.0 / F.min("rank")).alias("rr"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    z, ideal = F.lit(0.0), F.element_at(F.array(*map(F.lit, IDEAL)), F.least("relevant", F.lit(10)).cast("int"))
    return rel.join(m, "qid", "left").select("qid", "relevant", F.coalesce("found", F.lit(0)).alias("found"), F.round(F.coalesce("rr", z), 6).alias("rr"), F.round(F.coalesce("dcg", z), 6).alias("dcg"), F.round(F.coalesce("dcg", z) / ideal, 6).alias("ndcg"))


@query("ag14_ir_metrics", f"WITH {METRICS} SELECT qid, relevant, found, rr, dcg, ndcg FROM met", "chunks postings questions")
def ag14(spark, d):
    """AG14: recall, reciprocal rank, DCG and nDCG at ten of each question."""
    return metrics(spark, d)


@query("ag14_macro", f"WITH {METRICS}, k AS (SELECT qid, {_CLASS_SQL} AS class FROM questions) SELECT class, count(*) AS questions, round(avg(found / relevant), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met JOIN k USING (qid) GROUP BY class", "chunks postings questions")
def ag14_macro(spark, d):
    """AG14: means of the questions of each class."""
    kind = V.questions(spark, d).select("qid", query_class(F.col("text")).alias("class"))
    m = metrics(spark, d).join(kind, "qid").groupBy("class")
    return m.agg(F.count("*").alias("questions"), F.round(F.avg(F.col("found") / F.col("relevant")), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
