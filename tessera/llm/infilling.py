"""Fill-in-middle samples: texts cut at two units by a sparse index of checkpoints.

While the units of a text are counted, in slices, every STRIDE-th one leaves its number and the byte and code-point offset
of its end. A cut is found by a binary search among those checkpoints and a scan of at most STRIDE units from there; the
text is never cut into a list of units.

Defined results: null text counts as empty, an empty one has no units and stays plain; texts with a sentinel stay plain;
white space alone is one unit; rows are independent, so repeated rows and ties pass through, and a null id draws as the
empty string; texts of any length are cut whole; an empty table gives an empty result; columns not named in ``keep`` are
left out, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Units between two checkpoints.
STRIDE = 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: white space and the word after it, or the white space at the end of a text.
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Checkpoints:
    """Units of a text as UTF-8: their number ``n``, and the ends of every ``stride``-th one, in bytes and code points."""

    def __init__(self, raw: bytes, stride: int = STRIDE):
        self.raw, self.n = raw, 0
        units, ends, chars = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        data, points = np.frombuffer(raw, np.uint8), 0
        for at in range(0, len(data), kernels.STEP):
            part = data[at : at + kernels.STEP]
            blank = _BLANK[part]
            follows = np.empty(len(part), bool)
            follows[:-1] = blank[1:]
            last = at + len(part)
            follows[-1] = last == len(data) or _BLANK[data[last]]
            # words end before white space; the white space at the very end is a unit of its own
            end = np.flatnonzero(follows & ~blank)
            if last == len(data) and blank[-1]:
                end = np.append(end, len(part) - 1)
            start = (part & 0xC0) != 0x80
            pick = np.arange((-self.n - 1) % stride, len(end), stride)
            if len(pick):
                upto = end[pick] + 1
                units.append(self.n + pick + 1)
                ends.append(at + upto)
                # code points between checkpoints, summed up: one pass over the slice
                chars.append(points + np.cumsum(np.add.reduceat(start[: upto[-1]], np.append(0, upto[:-1]), dtype=np.int64)))
            self.n += len(end)
            points += int(np.count_nonzero(start))
        self.units, self.ends, self.chars = map(np.concatenate, (units, ends, chars))
        self.points = points

    def cut(self, unit: int) -> tuple[int, int]:
        """The end of the first ``unit`` units, in bytes and in code points."""
        if unit >= self.n:
            return len(self.raw), self.points
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        at = start = int(self.ends[k])
        for _ in range(unit - int(self.units[k])):
            at = _UNIT.match(self.raw, at).end()
        return at, int(self.chars[k]) + len(self.raw[start:at].decode())


def draws(id_col: str, seed: int) -> list[Column]:
    """h1 to h4: unsigned numbers of the first four groups of eight digits of a row's seeded digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, keep: list[str], seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain)
    and output, for every row. ``rate`` percent of the rows are rearranged, ``spm_rate`` percent of these as spm."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(s))
    h1, h2, h3, h4 = draws(id_col, seed)
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, text.alias("_text"), form.alias("_form"), h1.alias("_h1"), h2.alias("_h2"))
    width = len(kept)

    def work(batches):
        for b in batches:
            n, first, middle, made = [], [], [], []
            for text, form, h1, h2 in zip(*(b.column(width + i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                index = Checkpoints(raw)
                n.append(index.n)
                if form == "plain":
                    first.append(None)
                    middle.append(None)
                    made.append(text)
                    continue
                (at, x), (to, y) = (index.cut(u) for u in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
                first.append(x)
                middle.append(y - x)
                p, m, s = raw[:at].decode(), raw[at:to].decode(), raw[to:].decode()
                made.append(f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}" if form == "psm" else f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}")
            cols = [pa.array(n, pa.int64()), b.column(width + 1), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(made, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *cols], names)

    kinds = {f"_keep{i}": docs.schema[c].dataType.simpleString() for i, c in enumerate(keep)} | {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    names = list(kinds)
    out = rows.mapInArrow(kernels.tidy(work), ", ".join(f"`{c}` {t}" for c, t in kinds.items()))
    return out.toDF(*keep, *names[width:])


def restored(output, form) -> Column:
    """The text that an output of ``fill_in_middle`` was made from. No piece holds a sentinel, and a sentinel's end is none's
    beginning, so that the first and last ones are those that were put in."""
    output = F.col(output) if isinstance(output, str) else output
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(output)
