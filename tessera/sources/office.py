"""Text of zipped XML documents: books, letters, sheets and slides. Each file is read by itself in a task."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _open(content: bytes | None) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        return None


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def plain(html: str) -> str:
    """What a chapter shows: no scripts, styles or navigation, tags as line breaks."""
    html = re.sub(r"(?is)<(script|style|nav|head)\b.*?</\1\s*>", " ", html)
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in re.sub(r"<[^>]+>", "\n", html).splitlines())
    return "\n".join(x for x in lines if x)


def epub_text(content: bytes | None) -> str | None:
    """SC06: chapters of more than ten characters, in the order of their names; null for fewer than fifty in all."""
    if (z := _open(content)) is None:
        return None
    chapters = [plain(z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.lower().endswith((".xhtml", ".html", ".htm"))]
    text = "\n\n".join(c for c in chapters if len(c) > 10)
    return text if len(text) >= 50 else None


def docx_lines(content: bytes | None) -> list[str] | None:
    """SC07: paragraphs, headings by the level of their style, and tables as rows, in reading order."""
    if (z := _open(content)) is None or "word/document.xml" not in z.namelist():
        return None
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = []
    for e in ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body") or []:
        if e.tag == f"{_W}tbl":
            out += ["| " + " | ".join(said(c) for c in row.iter(f"{_W}tc")) + " |" for row in e.iter(f"{_W}tr")]
        elif e.tag == f"{_W}p" and (text := said(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"(?i)heading ?([1-6])", style.get(f"{_W}val", "") if style is not None else "")
            out.append("#" * int(level[1]) + f" {text}" if level else text)
    return out


def xlsx_rows(content: bytes | None) -> list[str] | None:
    """SC08: each sheet's rows, cells between bars; embedded pictures' formulas go."""
    if (z := _open(content)) is None:
        return None
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    out = []
    for n in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"):
        for row in ElementTree.fromstring(z.read(n)).iter(f"{_S}row"):
            cells = []
            for c in row.iter(f"{_S}c"):
                value = "".join(t.text or "" for t in c.iter(f"{_S}t")) or c.findtext(f"{_S}v", "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            line = " | ".join(re.sub(r"=DISPIMG\([^)]*\)", "", c) for c in cells)
            if line.strip(" |"):
                out.append(line)
    return out


def pptx_paragraphs(content: bytes | None) -> list[str] | None:
    """SC09: paragraphs of the slides, in the slides' order."""
    if (z := _open(content)) is None:
        return None
    slides = (ElementTree.fromstring(z.read(n)) for n in _numbered(z, r"ppt/slides/slide(\d+)\.xml"))
    return [t for s in slides for p in s.iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip())]
