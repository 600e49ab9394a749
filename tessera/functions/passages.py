"""Sections, paragraphs and passages of a text, as Columns and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end nothing, a passage's characters, and those of the section that a passage remembers.
BLANK, SIZE, PARENT = " \t\n\x0b\f\r", 400, 2000
# The lines that count as headings.
HEADING = r"#{1,6}[ \t]+[^\n]|[一二三四五六七八九十]+[、，.][ \t]*[^\n]|第[一二三四五六七八九十百千]+[章节条款][^\n]"
#: What stands between two paragraphs.
GAP = r"\n[ \t\n\f\r]*\n"


def strip(c) -> Column:
    return F.btrim(c, F.lit(BLANK))


def sections(text) -> Column:
    """TX01: heading and body of each section. The first one is what stands before the first heading, whose heading is empty;
    a null text has none."""
    parts = F.split(F.concat(F.lit("\n"), text), rf"\n(?={HEADING})", -1)
    heading = lambda part, i: F.when(i > 0, strip(F.substring_index(part, "\n", 1))).otherwise("")
    body = lambda part, i: strip(F.when(i > 0, F.regexp_replace(part, r"^[^\n]*", "")).otherwise(part))
    return F.transform(parts, lambda part, i: F.struct(heading(part, i).alias("heading"), body(part, i).alias("body")))


def paragraphs(text) -> Column:
    """TX02: what stands between blank lines, without blank paragraphs."""
    return F.filter(F.transform(F.split(text, GAP, -1), strip), lambda p: p != "")


def pieces(body, size: int = SIZE) -> Column:
    """Passages of a section. The state of the fold is what is done and what waits: a paragraph joins what waits while both
    stay within ``size`` characters, else it takes its place; a longer one, where nothing waits, is cut to ``size``."""

    def step(state, p):
        done, waits = state["done"], state["waits"]
        full = (waits != "") & (F.length(waits) + F.length(p) > size)
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: strip(F.substring(p, i * size + 1, F.lit(size))))
        more = F.when(full, F.array(waits)).when(F.length(p) > size, F.filter(parts, lambda x: x != "")).otherwise(none)
        rest = F.when(full, p).when(F.length(p) > size, "").when(waits == "", p).otherwise(F.concat(waits, F.lit("\n"), p))
        return F.struct(F.concat(done, more).alias("done"), rest.alias("waits"))

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("waits"))
    return F.aggregate(paragraphs(body), start, step, lambda s: F.when(s["waits"] != "", F.array_append(s["done"], s["waits"])).otherwise(s["done"]))


def passages(text, parent: bool = False) -> Column:
    """TX03: heading, section_id and content of a text's passages in order, and with ``parent`` the beginning of their section."""

    def of(section, i):
        fields = [section["heading"].alias("heading"), i.cast("long").alias("section_id")]
        fields += [F.substring(section["body"], 1, PARENT).alias("section_text")] * parent
        return F.transform(pieces(section["body"]), lambda content: F.struct(*fields, content.alias("content")))

    return F.flatten(F.transform(sections(text), of))


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CUTS = f"list_filter(list_transform(range(0, CAST(ceil(length(p) / {SIZE}.0) AS BIGINT)), lambda i: trim(substring(p, CAST(i * {SIZE} + 1 AS BIGINT), {SIZE}), {_BLANK_SQL})), lambda x: x <> '')"
_WAITS = "string_split(acc, chr(1))[-1]"
PARAGRAPHS_SQL = f"list_filter(list_transform(regexp_split_to_array(%s, '{GAP}'), lambda p: trim(p, {_BLANK_SQL})), lambda p: p <> '')"
SECTIONS_SQL = f"""SELECT doc_id, CAST(s AS BIGINT) AS section_id, CASE WHEN s > 0 THEN trim(split_part(x, chr(10), 1), {_BLANK_SQL}) ELSE '' END AS heading, trim(CASE WHEN s > 0 THEN regexp_replace(x, '^[^\n]*', '') ELSE x END, {_BLANK_SQL}) AS body
 FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS s FROM (SELECT doc_id, string_split(regexp_replace(chr(10) || text, '\n({HEADING})', chr(2) || '\\1', 'g'), chr(2)) AS l FROM documents))"""
PASSAGES_SQL = f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_id, k) - 1 AS BIGINT) AS chunk_index, heading, section_id, substring(body, 1, {PARENT}) AS section_text, content
 FROM (SELECT *, unnest(l) AS content, generate_subscripts(l, 1) AS k FROM (SELECT *, list_filter(string_split(list_reduce({PARAGRAPHS_SQL % 'body'}, lambda acc, p: CASE WHEN {_WAITS} <> '' AND length({_WAITS}) + length(p) > {SIZE} THEN acc || chr(1) || p WHEN length(p) > {SIZE} THEN acc || array_to_string({_CUTS}, chr(1)) || chr(1) WHEN {_WAITS} = '' THEN acc || p ELSE acc || chr(10) || p END, ''), chr(1)), lambda x: x <> '') AS l
  FROM ({SECTIONS_SQL})))"""
