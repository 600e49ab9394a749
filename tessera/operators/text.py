"""Text ingest: chunking, cleaning, quality, language, classification, parsing."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.passages import PARAGRAPHS_SQL, PASSAGES_SQL, SECTIONS_SQL, paragraphs, passages, sections
from ..plans import views as V
from ..registry import query
from ..session import table


def big(c) -> F.Column:
    return c.cast("long")


@query("tx03_chunks", "SELECT file_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(max(chunk_index) AS BIGINT) AS last_index FROM chunks GROUP BY file_id", "chunks")
def tx03(spark, d):
    """TX03: number and size of the stored passages of each file."""
    return V.chunks(spark, d).groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"), F.max("chunk_index").alias("last_index"))


@query("tx01_headings", SECTIONS_SQL)
def tx01(spark, d):
    """TX01: texts cut at headings."""
    s = V.documents(spark, d).select("doc_id", F.posexplode(sections(F.col("text"))).alias("section_id", "s"))
    return s.select("doc_id", F.col("section_id").cast("long").alias("section_id"), "s.heading", "s.body")


@query("tx03_paragraph_chunks", PASSAGES_SQL)
def tx03_passages(spark, d):
    """TX03: paragraphs packed to 400 characters within sections, with the beginning of the section."""
    p = V.documents(spark, d).select("doc_id", F.posexplode(passages(F.col("text"), parent=True)).alias("i", "p"))
    return p.select("doc_id", F.col("i").cast("long").alias("chunk_index"), "p.heading", "p.section_id", "p.section_text", "p.content")


@query("tx02_paragraphs", f"SELECT doc_id, CAST(len(l) AS BIGINT) AS paragraphs, CAST(coalesce(list_max(list_transform(l, lambda p: length(p))), 0) AS BIGINT) AS longest FROM (SELECT doc_id, {PARAGRAPHS_SQL % 'text'} AS l FROM documents)")
def tx02(spark, d):
    """TX02: paragraphs between blank lines, and the longest one's characters."""
    p = V.documents(spark, d).select("doc_id", paragraphs(F.col("text")).alias("l"))
    return p.select("doc_id", big(F.size("l")).alias("paragraphs"), big(F.coalesce(F.array_max(F.transform("l", F.length)), F.lit(0))).alias("longest"))


@query("rt34_text_vectors", "SELECT 'chunk' AS kind, id, array_to_string(v, ' ') AS v, round(norm, 6) AS norm, round(v[1] / norm, 6) AS first FROM vectors UNION ALL SELECT 'question', qid, array_to_string(v, ' '), round(norm, 6), round(v[1] / norm, 6) FROM question_vectors", "chunks vectors question_vectors")
def rt34(spark, d):
    """RT34: hashed words of all chunks and questions: sums by dimension, and the norm that makes them a unit vector."""
    both = V.vectors(spark, d).select(F.lit("chunk").alias("kind"), "id", "v", "norm").union(V.question_vectors(spark, d).select(F.lit("question"), "qid", "v", "norm"))
    unit = F.col("v")[0] / F.col("norm")
    return both.select("kind", "id", F.array_join(F.transform("v", lambda x: x.cast("string")), " ").alias("v"), F.round("norm", 6).alias("norm"), F.round(unit, 6).alias("first"))


@query("tx04_context_prefix", "SELECT c.id, substring('[' || f.name || ' | ' || f.category || '] ', 1, 80) || content AS text FROM chunks c JOIN files f ON f.id = c.file_id", "files chunks")
def tx04(spark, d):
    """TX04: chunk with its source in front."""
    f = V.files(spark, d).select(F.col("id").alias("file_id"), "name", "category")
    head = F.substring(F.concat(F.lit("["), "name", F.lit(" | "), "category", F.lit("] ")), 1, 80)
    return V.chunks(spark, d).join(f, "file_id").select("id", F.concat(head, "content").alias("text"))


@query("tx05_clean_with_fallback", "WITH g AS (SELECT file_id, id, length(regexp_replace(content, '[^a-zA-Z]', '', 'g')) * 2 >= length(content) AS good FROM chunks), n AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY file_id) AS kept FROM g) SELECT file_id, count(*) AS chunks, min(id) AS first_id FROM n WHERE good OR kept = 0 GROUP BY file_id", "chunks")
def tx05(spark, d):
    """TX05: drop chunks that are mostly not letters; a file that would lose all keeps all."""
    good = F.length(F.regexp_replace("content", "[^a-zA-Z]", "")) * 2 >= F.length("content")
    g = V.chunks(spark, d).select("file_id", "id", good.alias("good"))
    kept = F.sum(F.when(F.col("good"), 1).otherwise(0)).over(Window.partitionBy("file_id"))
    return g.withColumn("kept", kept).filter(F.col("good") | (F.col("kept") == 0)).groupBy("file_id").agg(F.count("*").alias("chunks"), F.min("id").alias("first_id"))


#: Private-use, kana and hangul ranges (fixed values).
FOREIGN = "[\\u3040-\\u30ff\\uac00-\\ud7af\\ue000-\\uf8ff]"
FOREIGN_SQL = "[\u3040-\u30ff\uac00-\ud7af\ue000-\uf8ff]"


def normalize_han(text, trad: str = "", simp: str = "") -> F.Column:
    """TX06: foreign scripts to space, characters of ``trad`` to those of ``simp`` 1:1 (no map is built in), blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(text, FOREIGN, " "), trad, simp) if trad else F.regexp_replace(text, FOREIGN, " "), "[ \\t]+", " "))


@query("tx06_normalize", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \t]+', ' ', 'g'))) AS digest FROM documents")
def tx06(spark, d):
    """TX06 without its map of traditional characters: foreign scripts to space, collapsed blanks."""
    return V.documents(spark, d).select("doc_id", F.md5(normalize_han(F.col("text"))).alias("digest"))


@query("tx07_han_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / greatest(length(text), 1), 4) AS han, length(text) > 50 AND length(regexp_replace(text, '[^一-鿿]', '', 'g')) < 0.3 * length(text) AS dropped FROM documents")
def tx07(spark, d):
    """TX07: share of Han characters; long texts without them are other languages."""
    han = F.length(F.regexp_replace("text", "[^一-鿿]", ""))
    return V.documents(spark, d).select("doc_id", F.round(han / F.greatest(F.length("text"), F.lit(1)), 4).alias("han"), ((F.length("text") > 50) & (han < F.length("text") * 0.3)).alias("dropped"))


QUALITY = "WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '[a-zA-ZÀ-ÿ0-9]+')) AS words, len(regexp_extract_all(text, '[a-zA-ZÀ-ÿ]')) AS letters, len(regexp_extract_all(text, '[.!?\n]')) AS marks, length(text) AS n FROM documents), s AS (SELECT doc_id, 40.0 * least(1, letters / greatest(n, 1)) + 30.0 * least(1, words * 6.0 / greatest(n, 1)) + least(20, marks) + CASE WHEN n >= 500 THEN 10 WHEN n >= 100 THEN 5 ELSE 0 END AS q FROM t) SELECT doc_id, round(q, 2) AS quality, CASE WHEN q >= 80 THEN 'excellent' WHEN q >= 60 THEN 'good' WHEN q >= 40 THEN 'fair' ELSE 'poor' END AS label FROM s"


@query("tx08_quality", QUALITY)
def tx08(spark, d):
    """TX08: quality of 0 to 100 from letters, words, structure and length, with its band."""
    n = F.greatest(F.length("text"), F.lit(1))
    letters, words, marks = (F.regexp_count("text", F.lit(p)) for p in ("[a-zA-ZÀ-ÿ]", "[a-zA-ZÀ-ÿ0-9]+", "[.!?\n]"))
    q = 40.0 * F.least(F.lit(1.0), letters / n) + 30.0 * F.least(F.lit(1.0), words * 6.0 / n) + F.least(F.lit(20), marks) + F.when(F.length("text") >= 500, 10).when(F.length("text") >= 100, 5).otherwise(0)
    t = V.documents(spark, d).select("doc_id", q.alias("q"))
    return t.select("doc_id", F.round("q", 2).alias("quality"), F.when(F.col("q") >= 80, "excellent").when(F.col("q") >= 60, "good").when(F.col("q") >= 40, "fair").otherwise("poor").alias("label"))


#: Segments that are sampled of a text, and the characters of each.
SEGMENTS, SEGMENT = 24, 800
#: Of the first 256 code points, those that count as readable; all others don't.
_READABLE = np.array([bool(re.match("[a-zA-ZÀ-ÿ0-9 ]", chr(i))) for i in range(256)])


def readable_shares(text: str | None) -> np.ndarray | None:
    """The share of readable characters in each of a text's segments, which begin at even steps and may overlap: counted once
    over the whole text, a segment's number is the difference between its ends."""
    if text is None:
        return None
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    upto = np.concatenate([[0], np.cumsum(_READABLE[np.minimum(code, 255)] & (code < 256))])
    begin = np.arange(SEGMENTS) * (len(code) // SEGMENTS)
    end = np.minimum(begin + SEGMENT, len(code))
    return (upto[end] - upto[begin]) / np.maximum(end - begin, 1)


def readable(text) -> F.Column:
    return F.pandas_udf(lambda s: s.map(readable_shares), "array<double>")(text)


@query("tx09_garble", "WITH s AS (SELECT doc_id, i, substring(text, CAST(i * (length(text) // 24) + 1 AS BIGINT), 800) AS seg FROM documents, range(0, 24) r(i)), q AS (SELECT doc_id, i, length(regexp_replace(seg, '[^a-zA-ZÀ-ÿ0-9 ]', '', 'g')) / greatest(length(seg), 1) AS ratio FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ratio, i) AS rn FROM q) SELECT doc_id, round(avg(ratio), 6) AS low, avg(ratio) < 0.45 AS garbled FROM o WHERE rn IN (2, 3) GROUP BY doc_id")
def tx09(spark, d):
    """TX09: median of the four least readable of 24 sampled segments; kept inside a row, so no shuffle."""
    return V.documents(spark, d).select("doc_id", F.array_sort(readable("text")).alias("r")).select("doc_id", ((F.col("r")[1] + F.col("r")[2]) / 2).alias("l")).select("doc_id", F.round("l", 6).alias("low"), (F.col("l") < 0.45).alias("garbled"))


@query("tx10_headers", "WITH l AS (SELECT source, regexp_extract(text, '^[^\n]*') AS line FROM documents), g AS (SELECT source, line, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source) SELECT g.source, line, n FROM g JOIN p USING (source) WHERE n >= greatest(3, 0.1 * pages)")
def tx10(spark, d):
    """TX10: first lines that recur over a source's documents, like page headers."""
    docs = V.documents(spark, d).select("source", F.regexp_extract("text", "^[^\n]*", 0).alias("line"))
    pages = docs.groupBy("source").agg(F.count("*").alias("pages"))
    return docs.groupBy("source", "line").agg(F.count("*").alias("n")).join(pages, "source").filter(F.col("n") >= F.greatest(F.lit(3.0), F.col("pages") * 0.1)).select("source", "line", "n")


#: Category dictionary: first match wins. A parameter; the default profile suits the test texts.
CATEGORIES = (("legal", ("license", "copyright")), ("contact", ("@", "http")), ("noise", ("###", "$$$")), ("prose", (". ",)))


@query("tx11_classify", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal' WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact' WHEN contains(text, '###') OR contains(text, '$$$') THEN 'noise' WHEN contains(text, '. ') THEN 'prose' ELSE 'other' END AS category FROM documents")
def tx11(spark, d):
    """TX11 over the test texts: dictionary classification, first match wins."""
    low, ladder = F.lower("text"), F
    for name, words in CATEGORIES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        ladder = ladder.when(hit, name)
    return V.documents(spark, d).select("doc_id", ladder.otherwise("other").alias("category"))


@query("tx14_segment", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+')) AS BIGINT) AS tokens, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+'))) AS BIGINT) AS distinct_tokens FROM documents")
def tx14(spark, d):
    """TX14: segmentation into tokens."""
    t = V.documents(spark, d).select("doc_id", V.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", big(F.size("t")).alias("tokens"), big(F.size(F.array_distinct("t"))).alias("distinct_tokens"))


@query("tx15_sanitize", "SELECT item_id, replace(regexp_replace(text, '[*^:{}]', '', 'g'), '\"', '\"\"') AS term FROM benchmark")
def tx15(spark, d):
    """TX15: query terms made safe for a phrase index."""
    return table(spark, d, "benchmark").select("item_id", F.replace(F.regexp_replace("text", "[*^:{}]", ""), F.lit('"'), F.lit('""')).alias("term"))


@query("tx19_keywords", "SELECT item_id, array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z]{3,}'), 1, 5), ' ') AS keywords FROM benchmark")
def tx19(spark, d):
    """TX19: first keywords of a query."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)), 1, 5), " ").alias("keywords"))


@query("tx20_script", "SELECT doc_id, CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[가-힯]') THEN 'ko' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(text, '[a-zA-Z]') THEN 'en' ELSE 'unknown' END AS script FROM documents")
def tx20(spark, d):
    """TX20: language by script."""
    s = F.when(F.col("text").rlike("[぀-ヿ]"), "ja").when(F.col("text").rlike("[가-힯]"), "ko").when(F.col("text").rlike("[一-鿿]"), "zh").when(F.col("text").rlike("[a-zA-Z]"), "en").otherwise("unknown")
    return V.documents(spark, d).select("doc_id", s.alias("script"))


@query("tx21_slugs", "SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN length(text) > 30 THEN substring(text, 1, 30) || '...' ELSE text END AS title FROM files", "files")
def tx21(spark, d):
    """TX21: slugs and shortened titles."""
    slug = F.btrim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-"))
    return V.files(spark, d).select("id", slug.alias("slug"), F.when(F.length("text") > 30, F.concat(F.substring("text", 1, 30), F.lit("..."))).otherwise(F.col("text")).alias("title"))


@query("tx16_markdown", "SELECT file_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS digest FROM chunks GROUP BY file_id", "chunks")
def tx16(spark, d):
    """TX16, TX17, SC25: a file's chunks in order, as one text."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))
    return V.chunks(spark, d).groupBy("file_id").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n")).alias("digest"))


@query("tx26_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def tx26(spark, d):
    """TX18, TX26: tolerant JSON parse; what doesn't parse is null."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def extract_json(text: str | None):
    """TX18: the first object or array of a reply that may be fenced or wrapped in prose; None if there is none."""
    if not text:
        return None
    body = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text.strip())
    for a, b in (("{", "}"), ("[", "]")):
        lo, hi = body.find(a), body.rfind(b)
        if 0 <= lo < hi:
            try:
                return json.loads(body[lo : hi + 1])
            except ValueError:
                continue
    return None


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.deep = [], 0

    def handle_starttag(self, tag, attrs):
        self.deep += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.deep = max(0, self.deep - 1)

    def handle_data(self, data):
        if not self.deep and data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts)


@query("sc05_html_text")
def sc05(spark, d):
    """SC05: page text without script, style and head; shorter than 20 characters is an error."""

    @F.pandas_udf("string")
    def parse(html: pd.Series) -> pd.Series:
        return html.map(html_text)

    t = table(spark, d, "pages").select("page_id", parse("html").alias("text"))
    return t.select("page_id", big(F.length("text")).alias("chars"), (F.length("text") >= 20).alias("ok"))


@query("pf13_noise_lines", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(l, '[#$%&*]{3}'))) AS BIGINT) AS clean_lines FROM documents")
def pf13(spark, d):
    """PF13, TX24: lines left without blanks and noise."""
    keep = F.filter(F.split("text", "\n", -1), lambda x: (F.trim(x) != "") & ~x.rlike("[#$%&*]{3}"))
    return V.documents(spark, d).select("doc_id", big(F.size(keep)).alias("clean_lines"))


@query("sc04_csv_lines", "SELECT c_custkey, 'name=' || c_name || chr(9) || 'segment=' || c_mktsegment AS line FROM customer")
def sc04(spark, d):
    """SC04: rows as col=value lines."""
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("\t", F.concat(F.lit("name="), "c_name"), F.concat(F.lit("segment="), "c_mktsegment")).alias("line"))


@query("sc14_extensions", "SELECT regexp_extract(url, '^[a-z]+') AS scheme, count(*) AS pages, count(*) FILTER (WHERE length(html) >= 20) AS parsed FROM pages GROUP BY ALL")
def sc14(spark, d):
    """Pages by the scheme of their by the source's kind."""
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+", 0).alias("scheme")).agg(F.count("*").alias("pages"), F.count(F.when(F.length("html") >= 20, 1)).alias("parsed"))
