"""Terms, boosts, references, citations and records of a query; files of several kinds as text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import cosine, doubles, ladder
from ..plans import views as V
from ..registry import example, query
from ..session import table
from ..sources import files as S
from .rules import ASKED_SQL, MODEL_RULE, asked
from .text import FOREIGN_SQL, normalize_han

CJK = "[一-鿿]"


@query("rt20_query_terms", f"WITH {ASKED_SQL}, a AS (SELECT qid, lower(text) AS t FROM q), w AS (SELECT qid, t, list_concat(list_filter(string_split(t, ' '), lambda x: length(x) >= 2), list_transform(list_filter(range(1, length(t)), lambda i: regexp_full_match(substring(t, i, 2), '{CJK}{{2}}')), lambda i: substring(t, i, 2))) AS l FROM a) SELECT qid, array_to_string(list_sort(list_distinct(CASE WHEN len(l) = 0 AND length(t) >= 2 THEN [t] ELSE l END)), '|') AS terms FROM w")
def rt20(spark, d):
    """RT20: words between blanks and pairs of Han characters, of two characters or more; the whole query where there is none."""
    t = F.lower("text")
    words = F.filter(F.split(t, " ", -1), lambda x: F.length(x) >= 2)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    every = F.concat(words, F.filter(pairs, lambda x: x.rlike(f"^{CJK}{{2}}$")))
    terms = F.when((F.size(every) == 0) & (F.length(t) >= 2), F.array(t)).otherwise(every)
    return asked(spark, d).select("qid", F.array_join(F.array_sort(F.array_distinct(terms)), "|").alias("terms"))


# Results to be boosted for one query (literal rows).
ROWS = ((1, "pa66 spec", "pa66.pdf", 1.0), (2, "nothing here", "list.xlsx", 2.0), (3, "the pa66 25 housing spec", "x.pdf", 0.5))
WANTED, MODELS = "pa66 spec", ("pa66",)
_TERMS = tuple(WANTED.split())
_HITS = " + ".join(f"CASE WHEN contains(text, '{t}') THEN 1 ELSE 0 END" for t in _TERMS)


@example("rt22_boosts", "WITH r(id, text, name, score) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{t}', '{n}', {s}::DOUBLE)" for i, t, n, s in ROWS) + f") SELECT id, round(score + CASE WHEN contains(text, '{WANTED}') THEN 5 ELSE 0 END + least({_HITS}, 5) + CASE WHEN contains(name, '{WANTED}') OR {' OR '.join(f"contains(name, '{t}')" for t in _TERMS)} THEN 3 ELSE 0 END + CASE WHEN contains(text, 'pa66') THEN 3 ELSE 0 END + CASE WHEN contains(name, 'pa66') THEN 5 ELSE 0 END, 2) AS score FROM r")
def rt22(spark, d):
    """RT22: additive boosts for the whole query, its terms, the file's name and models."""
    r = spark.createDataFrame(list(ROWS), "id long, text string, name string, score double")
    has = lambda c, w: F.contains(F.col(c), F.lit(w))
    one = lambda test, n: F.when(test, n).otherwise(0)
    hits = sum((one(has("text", t), 1) for t in _TERMS), F.lit(0))
    name = has("name", WANTED)
    for t in _TERMS:
        name = name | has("name", t)
    models = sum((one(has("text", m), 3) + one(has("name", m), 5) for m in MODELS), F.lit(0))
    return r.select("id", F.round(F.col("score") + one(has("text", WANTED), 5) + F.least(hits, F.lit(5)) + one(name, 3) + models, 2).alias("score"))


# Answers with the number of references each was given (literal rows).
ANSWERS = ((1, "see [1] and [2], also [7]", 5), (2, "no source", 3), (3, "[3][3][3]", 2), (4, "[10] [1]", 10), (5, "", 0))
ANSWERS_SQL = "a(id, text, refs) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{t}', {n})" for i, t, n in ANSWERS) + ")"


@example("rt30_grounding", f"WITH {ANSWERS_SQL}, n AS (SELECT *, list_distinct(list_transform(regexp_extract_all(text, '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS INTEGER))) AS c FROM a) SELECT id, CAST(len(c) AS BIGINT) AS cited, CAST(len(list_filter(c, lambda x: x > refs)) AS BIGINT) AS phantom, round(CASE WHEN len(c) = 0 THEN 0 ELSE len(list_filter(c, lambda x: x <= refs)) / len(c) END, 3) AS score, trim(CASE id WHEN 1 THEN replace(text, '[7]', '') WHEN 3 THEN replace(text, '[3]', '') ELSE text END) AS stripped FROM n")
def rt30(spark, d):
    """RT30: references that an answer cites, those it wasn't given, the grounded share, and the text without the phantoms."""
    a = spark.createDataFrame(list(ANSWERS), "id long, text string, refs int")
    cited = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))
    n = a.withColumn("c", cited).withColumn("bad", F.filter("c", lambda x: x > F.col("refs")))
    share = F.coalesce((F.size("c") - F.size("bad")) / F.nullif(F.size("c"), F.lit(0)), F.lit(0.0))
    stripped = F.aggregate("bad", F.col("text"), lambda s, x: F.replace(s, F.concat(F.lit("["), x.cast("string"), F.lit("]")), F.lit("")))
    return n.select("id", F.size("c").cast("long").alias("cited"), F.size("bad").cast("long").alias("phantom"), F.round(share, 3).alias("score"), F.trim(stripped).alias("stripped"))


@query("rt31_reference_context", "WITH c AS (SELECT DISTINCT file_id, content, min(chunk_index) AS pos FROM chunks GROUP BY file_id, content), b AS (SELECT *, least(length(content), 800) AS n, coalesce(sum(least(length(content), 800)) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM c) SELECT file_id, count(*) AS refs, md5(string_agg(substring(content, 1, 800), chr(10) ORDER BY pos)) AS digest FROM b WHERE held < 6000 GROUP BY file_id", "chunks")
def rt31(spark, d):
    """RT31: references without repeats, 800 characters each at most, until 6000 are reached."""
    c = V.chunks(spark, d).groupBy("file_id", "content").agg(F.min("chunk_index").alias("at"))
    w = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    b = c.withColumn("held", F.coalesce(F.sum(F.least(F.length("content"), F.lit(800))).over(w), F.lit(0))).filter("held < 6000")
    g = b.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("at", F.substring("content", 1, 800).alias("t")))).alias("r"))
    return g.select("file_id", F.size("r").cast("long").alias("refs"), F.md5(F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("digest"))


@query("rt37_cosine", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + 0.5::DOUBLE)), 6) END AS score FROM embeddings")
def rt37(spark, d):
    """RT37: cosine of two vectors, 0 where one has no length."""
    v = table(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("v"))
    other = F.transform("v", lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x + 0.5))
    return v.select("vec_id", F.round(cosine(F.col("v"), other), 6).alias("score"))


@query("rt32_stage_profile", "SELECT user_id, event_type AS stage, count(*) AS calls, round(sum(value), 4) AS ms, round(sum(value) / sum(sum(value)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, event_type")
def rt32(spark, d):
    """RT32: time of each stage of a profile and its share of the whole."""
    g = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum("value").alias("t"))
    return g.select("user_id", "stage", "calls", F.round("t", 4).alias("ms"), F.round(F.col("t") / F.sum("t").over(Window.partitionBy("user_id")), 6).alias("share"))


# Elements of a parsed document (literal rows): headings by level, tables as rows, lists, text.
ELEMENTS = ((1, 0, "heading", 2, "Scope"), (1, 1, "text", 0, "First."), (1, 2, "table", 0, "a|b;1|2"), (2, 0, "list", 0, "x;y"))


@example("tx17_elements", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), '## Scope' || chr(10) || 'First.' || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |'), (2, '- x' || chr(10) || '- y')) v(doc, text)")
def tx17(spark, d):
    """TX17: elements as Markdown, in their order; the expected texts are written out."""
    e = spark.createDataFrame(list(ELEMENTS), "doc long, at long, kind string, level int, body string")
    rows = F.split("body", ";")
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "body"))
    line = line.when(F.col("kind") == "table", F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.replace(r, F.lit("|"), F.lit(" | ")), F.lit(" |"))), "\n"))
    line = line.when(F.col("kind") == "list", F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r)), "\n")).otherwise(F.col("body"))
    g = e.select("doc", "at", line.alias("line")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    return g.select("doc", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


# Answers of a language model that should hold JSON (literal rows), and what is read from each.
REPLIES = ((1, '```json\n{"summary": "s", "tags": ["a"]}\n```'), (2, 'Sure: {"summary": "x"} done'), (3, "no json"), (4, ""), (5, '{"summary": '))


@example("tx18_json_replies", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 's', 1), (2, 'x', 0), (3, NULL, 0), (4, NULL, 0), (5, NULL, 0)) v(id, summary, tags)")
def tx18(spark, d):
    """TX18: JSON in a reply: fences are stripped, the text between the first and the last brace is read; what isn't JSON
    gives nulls. The model itself is outside."""
    r = spark.createDataFrame(list(REPLIES), "id long, reply string")
    inner = F.regexp_extract(F.regexp_replace("reply", "```(json)?", ""), r"(?s)\{.*\}", 0)
    o = F.from_json(inner, "summary string, tags array<string>")
    return r.select("id", o["summary"].alias("summary"), F.greatest(F.coalesce(F.size(o["tags"]), F.lit(0)), F.lit(0)).alias("tags"))


#: Parts of the quality score (fixed values).
HEADINGS = r"(^|\n)\s*(\d+\.)+\d*\s+\S|(^|\n)\s*[一二三四五六七八九十]+[、.]\s*\S|(^|\n)\s*第.{1,5}[章节]"
SCORE_SQL = f"""WITH t AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) / greatest(length(text), 1) AS valid, list_filter(regexp_extract_all(substring(text, 1, 5000), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]'), lambda w: true) AS words FROM documents),
p AS (SELECT doc_id, n, text, CASE WHEN valid >= 0.8 THEN 40 WHEN valid >= 0.6 THEN 30 WHEN valid >= 0.4 THEN 20 WHEN valid >= 0.2 THEN 10 ELSE 0 END AS a, len(list_filter(words, lambda w: length(w) >= 2)) / greatest(len(words), 1) AS multi, len(regexp_extract_all(text, '{HEADINGS}')) AS heads, len(regexp_extract_all(text, '\\|[^\n]*\\|[^\n]*\\|')) AS tables, len(regexp_extract_all(text, '\\n[ \\t]*\\n')) + 1 AS paras FROM t),
s AS (SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 0 ELSE a + CASE WHEN multi >= 0.6 THEN 30 WHEN multi >= 0.5 THEN 25 WHEN multi >= 0.4 THEN 15 WHEN multi >= 0.3 THEN 5 ELSE 0 END + CASE WHEN heads >= 3 THEN 8 WHEN heads >= 1 THEN 4 ELSE 0 END + CASE WHEN tables >= 3 THEN 6 WHEN tables >= 1 THEN 3 ELSE 0 END + CASE WHEN paras >= 5 THEN 6 WHEN paras >= 2 THEN 3 ELSE 0 END + CASE WHEN n < 100 THEN 0 WHEN n < 500 THEN 5 WHEN n <= 500000 THEN 10 ELSE 7 END END AS q FROM p)
SELECT doc_id, CAST(q AS BIGINT) AS quality, CASE WHEN q >= 80 THEN 'excellent' WHEN q >= 60 THEN 'good' WHEN q >= 40 THEN 'fair' ELSE 'poor' END AS label FROM s"""


@query("tx08_quality_score", SCORE_SQL)
def tx08(spark, d):
    """TX08: 0 to 100 from valid characters (40), words of several characters in the first 5000 (30), headings, tables and
    paragraphs (20) and length (10), with its band."""
    text = F.col("text")
    valid = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]", "")) / F.greatest(F.length(text), F.lit(1))
    words = F.regexp_extract_all(F.substring(text, 1, 5000), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"), F.lit(0))
    multi = F.size(F.filter(words, lambda w: F.length(w) >= 2)) / F.greatest(F.size(words), F.lit(1))
    heads, tables, paras = F.regexp_count(text, F.lit(HEADINGS)), F.regexp_count(text, F.lit(r"\|[^\n]*\|[^\n]*\|")), F.regexp_count(text, F.lit(r"\n[ \t]*\n")) + 1
    n = F.length(text)
    size = F.when(n < 100, 0).when(n < 500, 5).when(n <= 500000, 10).otherwise(7)
    q = ladder(valid, (0.8, 40), (0.6, 30), (0.4, 20), (0.2, 10)) + ladder(multi, (0.6, 30), (0.5, 25), (0.4, 15), (0.3, 5)) + ladder(heads, (3, 8), (1, 4)) + ladder(tables, (3, 6), (1, 3)) + ladder(paras, (5, 6), (2, 3)) + size
    s = V.documents(spark, d).select("doc_id", F.when(text.isNull() | (F.trim(text) == ""), 0).otherwise(q).cast("long").alias("quality"))
    return s.withColumn("label", F.when(F.col("quality") >= 80, "excellent").when(F.col("quality") >= 60, "good").when(F.col("quality") >= 40, "fair").otherwise("poor"))


@query("tx23_clean_chunks", f"SELECT c.id, c.file_id, c.chunk_index, trim(regexp_replace(regexp_replace(content, '{FOREIGN_SQL}', ' ', 'g'), '[ \t]+', ' ', 'g')) AS content FROM chunks c WHERE length(trim(content)) >= 10", "chunks")
def tx23(spark, d):
    """TX23: chunks normalised, short ones dropped, all other fields kept."""
    return V.chunks(spark, d).filter(F.length(F.trim("content")) >= 10).select("id", "file_id", "chunk_index", normalize_han(F.col("content")).alias("content"))


# Files as bytes (literal rows): name, content; and what the readers make of them.
FILES = (("a.txt", "plain text".encode()), ("b.md", "# 标题".encode()), ("c.txt", "中文内容".encode("gb18030")), ("d.dwg", b"\x00\x01AC1027"), ("e.bin", b"\x00" * 50 + b"x" * 50), ("f", b"no extension"), ("g.csv", "name,size\nA,1\nB,2\n".encode()), ("h.csv", "n;s\nx;\ny;2;9\n".encode()))
BACKENDS = {"txt": "text", "md": "markdown", "csv": "table", "html": "html", "htm": "html", "dwg": "drawing", "dxf": "drawing", "step": "drawing"}


def files_of(spark):
    return spark.createDataFrame([(n, bytearray(b)) for n, b in FILES], "name string, content binary")


@example("sc01_dispatch", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{b}')" for n, b in (("a.txt", "text"), ("b.md", "markdown"), ("c.txt", "text"), ("d.dwg", "drawing"), ("e.bin", "rejected"), ("f", "text"), ("g.csv", "table"), ("h.csv", "table"))) + ") v(name, backend)")
def sc01(spark, d):
    """SC01: a reader by the extension; unknown ones are read as text unless they look binary."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in BACKENDS.items() for x in kv]), ext)
    binary = F.udf(S.is_binary, "boolean", useArrow=True)
    return files_of(spark).select("name", F.coalesce(known, F.when(binary("content"), "rejected").otherwise("text")).alias("backend"))


@example("sc02_decode", "SELECT * FROM (VALUES ('a.txt', 'plain text'), ('b.md', '# 标题'), ('c.txt', '中文内容'), ('f', 'no extension')) v(name, text)")
def sc02(spark, d):
    """SC02: UTF-8, else GB 18030, else UTF-16, else with replacement marks; the expected texts are written out."""
    read = F.udf(S.decode, "string", useArrow=True)
    return files_of(spark).filter("name in ('a.txt', 'b.md', 'c.txt', 'f')").select("name", read("content").alias("text"))


@example("sc03_binary", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(n in ('d.dwg', 'e.bin')).lower()})" for n, _ in FILES) + ") v(name, is_binary)")
def sc03(spark, d):
    """SC03: more than a twentieth of the first 8192 bytes are 0."""
    binary = F.udf(S.is_binary, "boolean", useArrow=True)
    return files_of(spark).select("name", binary("content").alias("is_binary"))


@example("sc04_csv", "SELECT * FROM (VALUES ('g.csv', CAST(0 AS BIGINT), 'name=A' || chr(9) || 'size=1'), ('g.csv', 1, 'name=B' || chr(9) || 'size=2'), ('h.csv', 0, 'n=x'), ('h.csv', 1, 'n=y' || chr(9) || 's=2' || chr(9) || '9')) v(name, row, line)")
def sc04(spark, d):
    """SC04: rows of a CSV file as col=value, the separator found in the first line; empty cells go, cells beyond the header
    stand alone. The expected lines are written out."""
    rows = F.udf(S.csv_lines, "array<string>", useArrow=True)
    read = F.udf(S.decode, "string", useArrow=True)
    return files_of(spark).filter("name like '%.csv'").select("name", F.posexplode(rows(read("content"))).alias("row", "line")).select("name", F.col("row").cast("long").alias("row"), "line")


@example("sc14_drawings", "SELECT * FROM (VALUES ('d.dwg', 'd.dwg')) v(name, text)")
def sc14(spark, d):
    """SC14: of a drawing only the name is indexed."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return files_of(spark).filter(ext.isin(*[k for k, v in BACKENDS.items() if v == "drawing"])).select("name", F.col("name").alias("text"))


#: Messages of failed tasks (literal rows), and those that another try may mend.
FAILURES = ((1, "Connection reset by peer", 0), (2, "timeout after 30s", 2), (3, "timeout", 3), (4, "bad password", 0), (5, "HTTP 503", 1), (6, "database is locked", 1))
TRANSIENT = "(?i)timeout|timed out|connection|reset|refused|locked|5[0-9]{2}|temporar"


@example("st04_transient_errors", "WITH f(id, message, retries) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{m}', CAST({n} AS BIGINT))" for i, m, n in FAILURES) + f") SELECT id, CASE WHEN NOT regexp_matches(message, '{TRANSIENT}') THEN 'failed' WHEN retries >= 3 THEN 'dead' ELSE 'retrying' END AS state, CASE WHEN regexp_matches(message, '{TRANSIENT}') AND retries < 3 THEN CAST(5 * pow(2, retries) AS BIGINT) END AS wait_s FROM f")
def st04(spark, d):
    """ST04: errors that pass are retried after 5 x 2^n seconds, three times at most, then dead; others fail at once."""
    f = spark.createDataFrame(list(FAILURES), "id long, message string, retries long")
    passing, few = F.col("message").rlike(TRANSIENT), F.col("retries") < 3
    return f.select("id", F.when(~passing, "failed").when(~few, "dead").otherwise("retrying").alias("state"), F.when(passing & few, (F.pow(F.lit(2.0), "retries") * 5).cast("long")).alias("wait_s"))


@query("rt19_exact_models", f"WITH {ASKED_SQL} SELECT qid, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{MODEL_RULE}'))), '|') AS models FROM q")
def rt19(spark, d):
    """RT19: models, sizes and materials that a query names, whatever their case, once each."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(MODEL_RULE), F.lit(0))
    return asked(spark, d).select("qid", F.array_join(F.array_sort(F.array_distinct(found)), "|").alias("models"))
