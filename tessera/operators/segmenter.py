"""Words of runs without blanks, by costs learned from the texts.

A word costs the logarithm of how rare it is among all words; a run is cut where the sum of its words' costs is least (a
shortest path over its places), and a letter that begins no word of the dictionary costs more than any word. The dictionary
holds the WORDS most frequent words (a stated bound), so that it can go to the tasks; counts are those of all texts.

Defined results: null and empty texts have no words; a run of any length takes time in proportion to it, and no more than
the longest word looks back; of paths of one cost the one with the longer last word is taken.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import views as V
from ..registry import query

#: Words of the dictionary, and characters of the longest.
WORDS, LONGEST = 50_000, 24
#: Characters of the runs that are cut side by side.
TOGETHER = 1 << 19


def learned(spark: SparkSession, d: str, words: int = WORDS) -> dict[str, float]:
    """The cost of each of the most frequent words."""
    terms = V.frequencies(spark, d).filter(F.length("term") <= LONGEST)
    total = terms.agg(F.sum("cf")).first()[0] or 1
    top = terms.orderBy(F.desc("cf"), "term").limit(words).select("term", "cf").toPandas()
    return {t: math.log(total / n) for t, n in zip(top["term"], top["cf"], strict=True)}


def beginnings(costs: dict[str, float]) -> set[str]:
    """What words of the dictionary begin with: beyond these no longer word need be looked for."""
    return {w[:n] for w in costs for n in range(1, len(w) + 1)}


def cut(run: str, costs: dict[str, float], begins: set[str] | None = None) -> list[str]:
    """The words of a run on the path of least cost: from each place to the ends of the words that begin there."""
    begins = beginnings(costs) if begins is None else begins
    stray = max(costs.values(), default=1.0) + 5.0
    best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
    for i in range(len(run)):
        here = best[i]
        one = here + costs.get(run[i], stray)
        if one < best[i + 1]:
            best[i + 1], back[i + 1] = one, i
        # places come in order, so that of equal paths the one with the longer last word is there first
        for end in range(i + 2, min(i + LONGEST, len(run)) + 1):
            w = run[i:end]
            if w not in begins:
                break
            c = costs.get(w)
            if c is not None and here + c < best[end]:
                best[end], back[end] = here + c, i
    out, i = [], len(run)
    while i:
        out.append(run[back[i] : i])
        i = back[i]
    return out[::-1]


class Tree(NamedTuple):
    """The words of a dictionary by their letters: the node that a letter leads to from a node (0: none; 1: the first), the cost of
    the word that ends at a node, that of each letter alone, and the number of each letter (0: in no word)."""

    onward: np.ndarray
    price: np.ndarray
    alone: np.ndarray
    number: np.ndarray


def tree(costs: dict[str, float]) -> Tree:
    words = [w for w in costs if len(w) <= LONGEST]
    letters = sorted({c for w in words for c in w})
    number = np.zeros(max(map(ord, letters), default=0) + 2, np.uint16)
    of = {c: i for i, c in enumerate(letters, 1)}
    for c, i in of.items():
        number[ord(c)] = i
    nodes, steps = {"": 1}, []
    for w in words:
        at = 1
        for n in range(1, len(w) + 1):
            to = nodes.get(w[:n])
            if to is None:
                to = nodes[w[:n]] = len(nodes) + 1
                steps.append((at, of[w[n - 1]], to))
            at = to
    onward = np.zeros((len(nodes) + 1, len(letters) + 1), np.int32)
    if steps:
        a, c, b = np.array(steps).T
        onward[a, c] = b
    price = np.full(len(nodes) + 1, np.inf)
    price[[nodes[w] for w in words]] = [costs[w] for w in words]
    stray = max(costs.values(), default=1.0) + 5.0
    return Tree(onward, price, np.array([stray, *(costs.get(c, stray) for c in letters)]), number)


def words_from(s: np.ndarray, at: np.ndarray, t: Tree):
    """For each length from 2 on: the length, which of the places ``at`` words of it begin at, and their costs. Behind a run is a 0."""
    which, node = np.arange(len(at), dtype=np.int32), t.onward[1][s[at]]
    for n in range(2, LONGEST + 1):
        node = t.onward[node, s[at + (n - 1)]]
        held = node > 0
        alive = np.count_nonzero(held)
        if not alive:
            return
        if alive < 0.8 * len(at):
            which, at, node = which[held], at[held], node[held]
        cost = t.price[node]
        word = cost < np.inf
        if word.any():
            yield n, which[word], cost[word]


def cut_side_by_side(s: np.ndarray, begin: np.ndarray, size: np.ndarray, t: Tree, found: np.ndarray) -> None:
    """``cut`` of several runs, the longest first, one place of all of them at a time; marks in ``found`` where words end."""
    runs, steps = len(size), int(size[0])
    open_ = runs - np.searchsorted(size[::-1], np.arange(steps), "right")  # runs that have a place
    off = np.concatenate([[0], np.cumsum(open_)])
    place = np.repeat(np.arange(steps, dtype=np.int32), open_)
    run = (np.arange(off[-1]) - off[place]).astype(np.int32)
    at = begin[run] + place
    alone = t.alone[s[at]]
    lengths, which, cost = [], [], []
    for n, w, c in words_from(s, at, t):
        lengths.append(np.full(len(w), n, np.uint8))
        which.append(w)
        cost.append(c)
    wide = int(lengths[-1][0] if lengths else 1) + 1
    back = np.ones(off[-1], np.uint8)
    ring = np.full((wide, runs), np.inf)
    ring[0] = 0.0
    flat = ring.reshape(-1)
    if lengths:
        n, w, c = np.concatenate(lengths), np.concatenate(which), np.concatenate(cost)
        order = np.argsort(place[w], kind="stable")
        n, w, c = n[order], w[order], c[order]
        since, lane, end = place[w], run[w], place[w] + n
        slot, mark = end % wide * runs + lane, off[end - 1] + lane
        bounds = np.searchsorted(since, np.arange(steps + 1))
    for i in range(steps):
        here, after, m = ring[i % wide], ring[(i + 1) % wide], open_[i]
        x, y = off[i], off[i + 1]
        # as in cut(): the first of equal paths stays, and places come in order
        one = here[:m] + alone[x:y]
        less = one < after[:m]
        back[x:y][less] = 1
        np.copyto(after[:m], one, where=less)
        if lengths and bounds[i] < bounds[i + 1]:
            part = slice(bounds[i], bounds[i + 1])
            to, sums = slot[part], here[lane[part]] + c[part]
            less = sums < flat[to]
            flat[to[less]] = sums[less]
            back[mark[part][less]] = n[part][less]
        here.fill(np.inf)
    lane, at = np.arange(runs), size.astype(np.int64)
    while len(lane):
        found[begin[lane] + at - 1] = True
        at = at - back[off[at - 1] + lane]
        left = at > 0
        lane, at = lane[left], at[left]


def word_ends(text: str, size: np.ndarray, costs: dict[str, float], t: Tree | None = None, begins: set[str] | None = None) -> np.ndarray:
    """Whether a word of ``cut`` ends with a character, for each of the text of all runs (of ``size`` characters each, one at
    least), which are cut side by side in groups of like length and about TOGETHER characters; few long ones one by one."""
    t = tree(costs) if t is None else t
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    begin = np.cumsum(size + 1) - (size + 1)
    own = np.ones(len(code) + len(size), bool)
    own[begin + size] = False
    s = np.zeros(len(own) + LONGEST, np.uint16)
    s[: len(own)][own] = t.number[np.minimum(code, len(t.number) - 1)]
    found = np.zeros(len(own), bool)
    order = np.argsort(-size, kind="stable")
    group = np.cumsum(size[order]) // TOGETHER
    for part in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ():
        if size[part].sum() >= 2 * size[part[0]]:
            cut_side_by_side(s, begin[part], size[part], t, found)
            continue
        for i in part:
            first = begin[i] - i  # runs before it have a 0 each
            ends = np.cumsum([len(w) for w in cut(text[first : first + size[i]], costs, begins)])
            found[begin[i] + ends - 1] = True
    return found[own]


def found_again(df: DataFrame, key: str, runs: str, costs: dict[str, float]) -> DataFrame:
    """key, words, found, right of each row's ``runs``, an array of words that are written as one run: how many words it holds,
    how many ``cut`` finds in it, and how many ends of these are ends of those."""
    sent = df.sparkSession.sparkContext.broadcast(costs)

    def work(batches):
        costs = sent.value
        t, begins = tree(costs), beginnings(costs)
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(1)
            words = own.flatten().cast(pa.large_string())
            count = own.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64))
            last = np.concatenate([[0], np.cumsum(count)])
            place = np.concatenate([[0], ends])[last]
            data, at = words.buffers()[2], np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
            text = data[at[0] : at[-1]].to_pybytes().decode()
            some = np.diff(place) > 0
            found = word_ends(text, np.diff(place)[some], costs, t, begins)
            share = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), pa.array(share(found, place)), pa.array(share(found[ends - 1], last))], names=["key", "words", "found", "right"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(runs).alias("runs")).mapInArrow(work, f"key {kind}, words bigint, found bigint, right bigint").withColumnRenamed("key", key)


@query("tx14_learned_segments")
def tx14_learned(spark: SparkSession, d: str) -> DataFrame:
    """TX14: each line of the texts as one run, its words found again: how many words stood there, how many were found, and how
    many ends are those of words that stood there."""
    line = lambda x: V.tokens(x)
    docs = V.documents(spark, d).filter("text is not null").select("doc_id", F.filter(F.transform(F.split("text", "\n", -1), line), lambda w: F.size(w) > 0).alias("lines"))
    rows = docs.select("doc_id", F.explode("lines").alias("own"))
    each = found_again(rows, "doc_id", "own", learned(spark, d))
    return each.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum("found").alias("found"), F.sum("right").alias("right"))
