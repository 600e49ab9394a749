"""Interleaved document sequences with media columns.

``parse_sequences`` turns HTML into one row per element in reading order: struct (position, kind 'text' or
'media', text, digest, caption). ``resolve`` joins the media references to a media store by digest; the position
and the caption travel with the reference, so they stay aligned whatever order the join returns. ``store`` keeps
each distinct payload once, as 8-bit samples: a binary portable graymap (P5), 64 samples a row.

Defined results: null html gives no elements; texts and payloads of any length are taken whole; ties can't occur, as a page's
positions are distinct; a reference whose digest isn't in the store keeps its row with null
media; a null payload counts as empty; equal payloads share one stored form; repeated pages give repeated rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 64
ELEMENT = "position int, kind string, text string, digest string, caption string"
_SKIP = {"script", "style", "head", "noscript", "template"}
_BREAK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "figure", "figcaption", "header", "footer", "nav", "main", "blockquote", "pre", "hr", "body"}


class Reader(HTMLParser):
    """Collects text runs and media references in order; a figure's caption goes to the media inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.caption = [], [], []
        self.skip, self.in_caption, self.figure = 0, False, None

    def flush(self):
        run = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if run:
            self.out.append(["text", run, None, None])

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        if tag in _BREAK:
            self.flush()
        if tag == "figure":
            self.figure = len(self.out)
        elif tag == "figcaption":
            self.in_caption = True
        elif tag in ("img", "audio", "video", "source", "embed") and not self.skip:
            self.flush()
            src = a.get("src") or ""
            digest = a.get("data-sha256") or (src[7:] if src.startswith("sha256:") else None)
            self.out.append(["media", src, digest, a.get("alt")])

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption":
            self.in_caption = False
        elif tag == "figure" and self.figure is not None:
            self.flush()
            told = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            for e in self.out[self.figure :]:
                if e[0] == "media" and told:
                    e[3] = told
            self.caption, self.figure = [], None
        elif tag in _BREAK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.caption if self.in_caption and self.figure is not None else self.text).append(data)


def read_elements(html: str | None) -> list[dict]:
    if not html:
        return []
    r = Reader()
    r.feed(html)
    r.close()
    r.flush()
    return [{"position": i, "kind": k, "text": t if k == "text" else None, "digest": d, "caption": c} for i, (k, t, d, c) in enumerate(r.out)]


def parse_sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, elements: array of structs in reading order."""
    kind = pages.schema[id_col].dataType.simpleString()
    element = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read_elements(h) for h in b.column(1).to_pylist()], pa.list_(element))], ["page", "elements"])

    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(work, f"page {kind}, elements array<struct<{ELEMENT.replace(' ', ':').replace(',:', ',')}>>")


def padded(payload: bytes) -> bytes:
    """The payload with zero bytes up to a positive multiple of a row of samples."""
    return payload + bytes(-len(payload) % ROW or (0 if payload else ROW))


def to_graymap(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_graymap(stored: bytes) -> np.ndarray:
    """Samples (rows x 64) of a stored graymap."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", stored[:64])
    if not head:
        raise ValueError("not a graymap of 8-bit samples")
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(stored, np.uint8, width * height, head.end()).reshape(height, width)


def features(samples: np.ndarray) -> str:
    """Mean, deviation, and the mean of each quarter of the columns, of the samples."""
    cols = samples.mean(axis=0, dtype=np.float64).reshape(4, -1).mean(axis=1)
    return f"m={samples.mean(dtype=np.float64):.4f};s={float(samples.std(dtype=np.float64)):.4f};q=" + ",".join(f"{x:.4f}" for x in cols)


def store(payloads: DataFrame, payload_col: str) -> DataFrame:
    """digest, n_bytes, media: one row for each distinct payload; the digest is that of the payload as it came, so that
    payloads which differ only in final zero bytes stay apart."""

    def work(batches):
        for b in batches:
            digest, size, media, seen = [], [], [], set()
            for x in b.column(0):
                raw = x.as_py() or b""
                raw = raw.encode() if isinstance(raw, str) else raw
                d = hashlib.sha256(raw).hexdigest()
                if d in seen:
                    continue
                seen.add(d)
                digest.append(d)
                size.append(len(raw))
                media.append(to_graymap(padded(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["digest", "n_bytes", "media"])

    made = payloads.select(payload_col).mapInArrow(work, "digest string, n_bytes long, media binary")
    return made.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("media").alias("media"))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row per element, media resolved by digest: page, position, kind, text, digest, caption, n_bytes, media."""
    flat = sequences.select("page", F.explode("elements").alias("e")).select("page", "e.*")
    names = ["page", "position", "kind", "text", "digest", "caption", "n_bytes", "media"]
    found = flat.filter("digest is not null").join(media, "digest", "left").select(*names)
    # elements without a digest have nothing to be joined with
    return found.union(flat.filter("digest is null").select(*names[:-2], F.lit(None).cast("long"), F.lit(None).cast("binary")))


def read_back(resolved: DataFrame) -> DataFrame:
    """page, position, caption and what the stored bytes give: sizes, digests, checksum and features, of all media
    elements; null where the reference is not in the store."""
    kind = resolved.schema["page"].dataType.simpleString()

    def work(batches):
        for b in batches:
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            memo: dict[str, tuple] = {}
            for digest, media in zip(b.column(4).to_pylist(), b.column(5), strict=True):
                if (got := memo.get(digest)) is None:
                    if (stored := media.as_py()) is None:
                        memo[digest] = got = (None,) * 6
                    else:
                        samples = from_graymap(stored)
                        raw = samples.tobytes()
                        got = memo[digest] = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples))
                for k, v in zip(out, got, strict=True):
                    out[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["page", "position", "caption", "n_bytes", *out])

    have = resolved.filter("kind = 'media'").select("page", "position", "caption", "n_bytes", "digest", "media")
    return have.mapInArrow(work, f"page {kind}, position int, caption string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
