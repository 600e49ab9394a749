"""Structure of pages and texts: headings by size, runs of rows and items, and page text without headers and footers.

A text's lines stay in its row: where a run begins is told by a line and the one before it, and a run is the slice from its
beginning to the next one's, so that the work is in proportion to the lines and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.passages import strip
from ..functions.vectors import let
from ..plans import views as V
from ..registry import query
from ..session import bounded, table

# Sizes that browsers give to tags, and the shares of the body's size from which a line is a heading.
SIZES = {"h1": 32.0, "h2": 24.0, "h3": 18.72, "h4": 16.0, "h5": 13.28, "h6": 10.72}
BODY, FIRST, SECOND, THIRD, SHORT = 16.0, 1.4, 1.2, 1.1, 100
HIDDEN = r"(?is)<!--.*?-->|<(script|style|head|title)\b.*?</(script|style|head|title)>"
BLOCKS = "h[1-6]|p|li|tr|div|article|section|nav|footer|ul|ol|table|br|body"
#: Kinds whose neighbours make one element.
RUNS = ("table", "list")


def blocks(html) -> Column:
    """text, size, bold and tag of each block of a page that has text."""
    parts = F.split(F.regexp_replace(html, HIDDEN, ""), rf"(?i)(?=<(?:{BLOCKS})\b)|(?i)(?<=</(?:h[1-6])>)|(?i)(?<=</(?:ul|ol|li|tr|div|article|section|nav|footer|table|p)>)", -1)

    def block(part):
        tag = F.lower(F.regexp_extract(part, r"^<([a-zA-Z0-9]+)", 1))
        text = strip(F.regexp_replace(F.regexp_replace(part, "(?s)<[^>]*>", ""), r"[ \t\n\f\r]+", " "))
        size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv]), tag), F.lit(BODY))
        return F.struct(text.alias("text"), size.alias("size"), (part.rlike(r"(?i)<(?:b|strong)\b") | tag.isin(*SIZES)).alias("bold"), tag.alias("tag"))

    return F.filter(F.transform(parts, block), lambda b: b["text"] != "")


def body_size(lines) -> Column:
    """SC11: the size that most characters have, of equals the smaller."""

    def of(lines):
        sizes = F.array_distinct(F.transform(lines, lambda b: b["size"]))
        weight = lambda s: F.aggregate(lines, F.lit(0), lambda n, b: n + F.when(b["size"] == s, F.length(b["text"])).otherwise(0))
        return F.coalesce(-F.array_max(F.transform(sizes, lambda s: F.struct(weight(s).alias("n"), (-s).alias("s"))))["s"], F.lit(BODY))

    return let(lines, of)


def level(size, bold, text, body) -> Column:
    """SC11: 1 to 3 for headings, else 0."""
    share = size / body
    return F.when(share >= FIRST, 1).when(share >= SECOND, 2).when(bold & (share >= THIRD) & (F.length(text) < SHORT), 3).otherwise(0)


def elements(lines) -> Column:
    """SC12: kind, level, text and rows of each element, from lines of kind, level and text. Neighbours of a kind in RUNS are one
    element; blank lines end a run and are none."""

    def of(lines):
        at = lambda i: F.get(lines, i - 1)
        follows = lambda i: (i > 1) & at(i)["kind"].isin(*RUNS) & (F.get(lines, i - 2)["kind"] == at(i)["kind"])

        def cut(starts):
            def element(start, j):
                run = F.slice(lines, start, F.coalesce(F.get(starts, j + 1), F.size(lines) + 1) - start)
                first = at(start)
                return let(run, lambda r: F.struct(first["kind"].alias("kind"), first["level"].alias("level"), F.array_join(F.transform(r, lambda x: x["text"]), "\n").alias("text"), F.size(r).alias("rows")))

            return F.filter(F.transform(starts, element), lambda e: e["kind"] != "blank")

        places = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines)))
        return let(F.filter(places, lambda i: ~F.coalesce(follows(i), F.lit(False))), cut)

    return let(lines, of)


def markdown_lines(text) -> Column:
    """kind, level and text of each line: headings, rows of pipe tables (cells between blanks and bars; separators are left
    out), blank lines, and the rest."""

    def line(raw):
        x = strip(raw)
        hashes = F.length(F.regexp_extract(x, "^(#{1,3}) ", 1))
        row = x.rlike(r"^\|.*\|")
        cells = F.regexp_replace(F.regexp_replace(x, r"^\|[ \t]*|[ \t]*\|$", ""), r"[ \t]*\|[ \t]*", " | ")
        kind = F.when(x == "", "blank").when(hashes > 0, "heading").when(row & x.rlike(r"^[|:\- \t]+$"), "separator").when(row, "table").otherwise("text")
        return F.struct(kind.alias("kind"), hashes.alias("level"), F.when(hashes > 0, strip(F.regexp_replace(x, "^#{1,3} ", ""))).when(row, cells).otherwise(x).alias("text"))

    return F.filter(F.transform(F.split(text, "\n", -1), line), lambda x: x["kind"] != "separator")


_SIZE_SQL = "CASE tag " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SIZES.items()) + f" ELSE {BODY}::DOUBLE END"
#: The same blocks without look-around: a mark before each opening and after each closing block.
BLOCKS_SQL = rf"""raw AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '(?i)(<(?:{BLOCKS})\b)', chr(1) || '\1', 'g'), '(?i)(</(?:h[1-6]|ul|ol|li|tr|div|article|section|nav|footer|table|p)>)', '\1' || chr(1), 'g'), chr(1)) AS l FROM pages),
part AS (SELECT page_id, unnest(l) AS part, generate_subscripts(l, 1) AS i FROM raw),
block AS (SELECT page_id, i, lower(regexp_extract(part, '^<([a-zA-Z0-9]+)', 1)) AS tag, regexp_matches(part, '(?i)<(?:b|strong)\b') AS b, trim(regexp_replace(regexp_replace(part, '(?s)<[^>]*>', '', 'g'), '[ \t\n\f\r]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM part),
line AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n, tag, text, {_SIZE_SQL} AS size, b OR tag IN ({', '.join(f"'{t}'" for t in SIZES)}) AS bold FROM block WHERE text <> ''),
body AS (SELECT page_id, size AS body FROM (SELECT page_id, size, sum(length(text)) AS w FROM line GROUP BY page_id, size) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY w DESC, size) = 1),
lev AS (SELECT page_id, n, tag, text, body, CASE WHEN size / body >= {FIRST}::DOUBLE THEN 1 WHEN size / body >= {SECOND}::DOUBLE THEN 2 WHEN bold AND size / body >= {THIRD}::DOUBLE AND length(text) < {SHORT} THEN 3 ELSE 0 END AS level FROM line JOIN body USING (page_id))"""


def page_lines(spark, d) -> DataFrame:
    """page_id, body and lines (kind, level, text) of each page."""

    def typed(parts):
        kind = lambda b, n: F.when(n > 0, "heading").when(b["tag"] == "tr", "table").when(b["tag"] == "li", "list").otherwise("text")
        line = lambda b, body: let(level(b["size"], b["bold"], b["text"], body), lambda n: F.struct(kind(b, n).alias("kind"), n.alias("level"), b["text"].alias("text")))
        return let(body_size(parts), lambda body: F.struct(body.alias("body"), F.transform(parts, lambda b: line(b, body)).alias("lines")))

    return table(spark, d, "pages").select("page_id", let(blocks(F.col("html")), typed).alias("p")).select("page_id", "p.body", "p.lines")


@query("sc11_page_markdown", f"WITH {BLOCKS_SQL} SELECT page_id, max(body) AS body, md5(string_agg(CASE WHEN level > 0 THEN repeat('#', level) || ' ' ELSE '' END || text, chr(10) ORDER BY n)) AS digest FROM lev GROUP BY page_id")
def sc11(spark, d):
    """SC11: pages as markdown, headings told by the size of most of the page's characters."""
    text = F.array_join(F.transform("lines", lambda x: F.concat(F.when(x["level"] > 0, F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "))).otherwise(""), x["text"])), "\n")
    return page_lines(spark, d).filter(F.size("lines") > 0).select("page_id", "body", F.md5(text).alias("digest"))



def _islands(key: str, rows: str) -> str:
    before = f"before AS (SELECT *, lag(kind) OVER (PARTITION BY {key} ORDER BY n) AS was FROM {rows})"
    run = f"run AS (SELECT *, sum(CASE WHEN kind IN ('table', 'list') AND was = kind THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY n) AS r FROM before)"
    one = f"one AS (SELECT {key}, r, min(kind) AS kind, min(level) AS level, string_agg(text, chr(10) ORDER BY n) AS text, count(*) AS rows FROM run GROUP BY {key}, r HAVING min(kind) <> 'blank')"
    return f"{before}, {run}, {one} SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY r) - 1 AS n, kind, CAST(level AS BIGINT) AS level, md5(text) AS digest, rows FROM one"


def _exploded(df: DataFrame, key: str) -> DataFrame:
    e = df.select(key, F.posexplode("e").alias("n", "e"))
    return e.select(key, F.col("n").cast("long").alias("n"), "e.kind", F.col("e.level").cast("long").alias("level"), F.md5("e.text").alias("digest"), F.col("e.rows").cast("long").alias("rows"))


@query("sc12_page_elements", f"WITH {BLOCKS_SQL}, typed AS (SELECT page_id, n, text, level, CASE WHEN level > 0 THEN 'heading' WHEN tag = 'tr' THEN 'table' WHEN tag = 'li' THEN 'list' ELSE 'text' END AS kind FROM lev), {_islands('page_id', 'typed')}")
def sc12(spark, d):
    """SC12: elements of each page: headings, tables, lists, texts."""
    return _exploded(page_lines(spark, d).select("page_id", elements(F.col("lines")).alias("e")), "page_id")


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = rf"""src AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
x AS (SELECT doc_id, n, trim(raw, {_TRIM}) AS x, length(regexp_extract(trim(raw, {_TRIM}), '^(#{{1,3}}) ', 1)) AS level FROM src),
typed AS (SELECT doc_id, n, level, CASE WHEN level > 0 THEN trim(regexp_replace(x, '^#{{1,3}} ', ''), {_TRIM}) WHEN regexp_matches(x, '^\|.*\|') THEN regexp_replace(regexp_replace(x, '^\|[ \t]*|[ \t]*\|$', '', 'g'), '[ \t]*\|[ \t]*', ' | ', 'g') ELSE x END AS text,
 CASE WHEN x = '' THEN 'blank' WHEN level > 0 THEN 'heading' WHEN regexp_matches(x, '^\|.*\|') AND regexp_matches(x, '^[|:\- \t]+$') THEN 'separator' WHEN regexp_matches(x, '^\|.*\|') THEN 'table' ELSE 'text' END AS kind FROM x),
kept AS (SELECT * FROM typed WHERE kind <> 'separator')"""


@query("sc12_text_elements", f"WITH {LINES_SQL}, {_islands('doc_id', 'kept')}")
def sc12_text(spark, d):
    """SC12: elements of each text: headings, pipe tables, lines."""
    return _exploded(V.documents(spark, d).select("doc_id", elements(markdown_lines(F.col("text"))).alias("e")), "doc_id")


#: A line is a header (or footer) of a file if so many of its pages begin (or end) with it, and so large a share.
LEAST, SHARE = 3, 0.3


def page_texts(pages: DataFrame, file: str, key: str, share: float = SHARE) -> DataFrame:
    """TX10: key and text of each page (file, key, text): without the headers and footers of its file and lines that are a page
    number, the lines that are left joined to a paragraph. Lines are counted before they are shuffled; which are headers is
    broadcast if they are few."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), strip), lambda x: x != "")
    p = pages.select(file, key, lines.alias("lines")).withColumns({"first": F.when(F.size("lines") >= 2, F.col("lines")[0]), "last": F.when(F.size("lines") >= 2, F.element_at("lines", -1))})
    size = pages.groupBy(file).agg(F.count("*").alias("_pages"))

    def often(line: str) -> DataFrame:
        n = p.filter(F.col(line).isNotNull()).groupBy(file, line).agg(F.count("*").alias("_n"))
        far = F.greatest(F.lit(float(LEAST)), F.col("_pages") * share)
        return bounded(n.join(size, file).filter((F.col("_n") >= far) & (F.col("_pages") >= LEAST)).select(file, line, F.lit(True).alias(f"is_{line}")))

    both = p.join(often("first"), [file, "first"], "left").join(often("last"), [file, "last"], "left")
    n = F.size("lines")
    gone = lambda x, i: (F.coalesce("is_first", F.lit(False)) & (i == 0)) | (F.coalesce("is_last", F.lit(False)) & (i == n - 1)) | x.rlike(r"^[-\s]*[0-9]{1,4}[-\s]*$")
    return both.select(key, F.array_join(F.filter("lines", lambda x, i: ~gone(x, i)), " ").alias("text"))


_PAGE_TEXT = f"""WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_TRIM})), lambda x: x <> '') AS l FROM documents),
size AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
h AS (SELECT source, l[1] AS line FROM l JOIN size USING (source) WHERE len(l) >= 2 AND pages >= {LEAST} GROUP BY source, l[1], pages HAVING count(*) >= greatest({LEAST}, pages * %s::DOUBLE)),
f AS (SELECT source, l[-1] AS line FROM l JOIN size USING (source) WHERE len(l) >= 2 AND pages >= {LEAST} GROUP BY source, l[-1], pages HAVING count(*) >= greatest({LEAST}, pages * %s::DOUBLE)),
m AS (SELECT doc_id, l, h.line IS NOT NULL AND len(l) >= 2 AS top, f.line IS NOT NULL AND len(l) >= 2 AS bottom FROM l LEFT JOIN h ON h.source = l.source AND h.line = l.l[1] LEFT JOIN f ON f.source = l.source AND f.line = l.l[-1])
SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: NOT ((top AND i = 1) OR (bottom AND i = len(l)) OR regexp_full_match(x, '[-\\s]*[0-9]{{1,4}}[-\\s]*'))), ' ')) AS digest, top, bottom FROM m"""
#: The share over the test tables, whose sources repeat few first lines.
SPARSE = 0.002


@query("tx10_page_text", f"SELECT doc_id, digest FROM ({_PAGE_TEXT % (SPARSE, SPARSE)})")
def tx10_text(spark, d):
    """TX10: whole texts as pages of their source, without headers, footers and page numbers."""
    docs = V.documents(spark, d).filter("text is not null").select("doc_id", "source", "text")
    return page_texts(docs, "source", "doc_id", SPARSE).select("doc_id", F.md5("text").alias("digest"))
