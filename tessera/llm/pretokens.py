"""Cutting texts into the pieces of a byte-level BPE tokenizer."""

from __future__ import annotations

import re

import regex

#: The pattern of byte-level BPE (a fixed value of the tokenizer's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, numbers and white space among the first 256 characters, where ``re`` can take the place of Unicode classes.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\u0085\\u00a0"
_ANY = regex.compile(PATTERN)
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def cut(text: str) -> list[str]:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _ANY.findall(text)
    return _LATIN.findall(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]
