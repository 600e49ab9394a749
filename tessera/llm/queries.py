"""Queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import embedding_dedup, infilling, language_id, line_dedup, media, minhash, packing, personal_data, phrase_dedup, piece_sampling, suffix_dedup, token_count, whitening


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), keep_text=False)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document becomes a page: a heading, a figure that refers to the text's payload by digest, and a closing line.
    Payloads go to a media store once each; the page is parsed, its reference resolved, and the stored bytes read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    name = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    page = F.concat(F.lit("<article><h1>"), name, F.lit('</h1><figure><img src="sha256:'), F.sha2("text", 256), F.lit('"><figcaption>'), name, F.lit("</figcaption></figure><p>"), F.length("text").cast("string"), F.lit(" characters</p></article>"))
    sequences = media.parse_sequences(docs.select("doc_id", page.alias("html")), "doc_id", "html")
    back = media.read_back(media.resolve(sequences, media.store(docs, "text")))
    return back.select(F.col("page").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.learn(docs, ~held_out())
    out = language_id.predict(docs, net, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infilling.fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infilling.restored("output", "form"), 256).alias("restored_sha256"))


def _is(kind: str) -> Callable[[F.Column], F.Column]:
    return lambda span: span["kind"] == kind


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.written(base), 256).alias("base_sha256"), personal_data.written(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it is beyond a long; ``deviation_exact`` has it in any case."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumnsRenamed({"deviation": "deviation_exact"}).select("vec_id", "component", "n", F.expr("try_cast(deviation_exact AS long)").alias("deviation"), "whitened", "explained", "identity_error", "deviation_exact")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_embedding_near_dedup, op3_substring_dedup, op4_line_dedup, op5_media_columns, op6_minhash_near_dedup, op7_token_counts, op8_sentencepiece, op9_language_id, op10_packing, op11_fill_in_middle, op12_personal_data, op13_whitening)
}

_BYTES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, CAST(2 * i + 1 AS BIGINT), 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i > before + 100 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
cut AS (SELECT doc_id, n, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, n),
piece AS (SELECT doc_id, n, substring(h, CAST(2 * coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY n), 0) + 1 AS BIGINT), CAST(2 * (lo - coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY n), 0)) AS BIGINT)) AS x FROM cut JOIN d USING (doc_id)
 UNION ALL SELECT doc_id, 1e9, substring(h, CAST(2 * coalesce(top, 0) + 1 AS BIGINT)) FROM d LEFT JOIN (SELECT doc_id, max(hi) AS top FROM cut GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY n) AS x FROM piece GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM cut GROUP BY doc_id) c ON c.doc_id = d.doc_id"""

_WORDS = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 34], ' ')) AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS i FROM d WHERE len(l) >= 35)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(0, 35) t(k)),
word AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS x FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.x, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id"""

_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT vec_id, v FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = v.vec_id"""

_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS l, sha256('42:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, text, l, len(l) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(l[1:a], '') AS x, array_to_string(l[a + 1:b], '') AS y, array_to_string(l[b + 1:], '') AS z FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""

#: SQL of the operators that it can express, over whole tables of the size of sf0.01. Byte formats (5), tokenizers, networks
#: and packing (7 to 10), approximate candidates (4, 6), estimated reliabilities (12) and eigenvectors (13) are tested
#: against brute force, libraries and round trips.
ORACLE_SQL: dict[str, str] = {"op1_suffix_array_dedup": _BYTES, "op2_embedding_near_dedup": _VECTORS, "op3_substring_dedup": _WORDS, "op11_fill_in_middle": _MIDDLE}
