"""Segmentation by a learned dictionary: least cost against all ways to cut, and words of texts found again."""

import itertools
import random
import shutil

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import segmenter
from tessera.plans import views as V

DATA = "/root/testdata/sf0.001"


def test_least_cost():
    r = random.Random(3)
    costs = {"a": 3.0, "ab": 2.5, "abc": 4.0, "bc": 1.5, "c": 2.0, "cab": 2.2, "ba": 5.0}
    stray = max(costs.values()) + 5
    price = lambda words: sum(costs.get(w, stray if len(w) == 1 else 1e9) for w in words)
    for _ in range(200):
        run = "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
        ways = []
        for cuts in itertools.product((0, 1), repeat=len(run) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
            ways.append([run[a:b] for a, b in zip(at, at[1:])])
        got = segmenter.cut(run, costs)
        assert "".join(got) == run and abs(price(got) - min(map(price, ways))) < 1e-9
    assert segmenter.cut("", costs) == [] and "".join(segmenter.cut("x" * 50_000, costs)) == "x" * 50_000


def test_words_found_again(spark):
    n = segmenter.tx14_learned(spark, DATA).groupBy().sum("words", "found", "right").first()
    print(n)
    # of the ends of words that stood there, and of those that were found
    assert n["sum(right)"] / n["sum(words)"] > 0.8 and n["sum(right)"] / n["sum(found)"] > 0.8


def test_runs_side_by_side_are_cut_as_one_by_one(monkeypatch):
    r = random.Random(11)
    for letters in ("ab", "abcdé", "aß漢𝒳"):
        words = {"".join(r.choice(letters) for _ in range(r.choice([1, 2, 2, 3, 4, 7, 24]))) for _ in range(60)}
        costs = {w: float(r.randint(1, 9)) for w in words}  # many paths of one cost
        runs = ["".join(r.choice(letters + "z") for _ in range(r.choice([1, 2, 5, 30, 90]))) for _ in range(150)] + ["".join(r.choice(letters) for _ in range(3000))]
        size = np.array([len(x) for x in runs])
        ends = [np.cumsum([len(w) for w in segmenter.cut(x, costs)]) for x in runs]
        want = np.zeros(size.sum(), bool)
        want[np.concatenate([e + at - 1 for e, at in zip(ends, np.cumsum(size) - size)])] = True
        for together in (50, 1 << 19):
            monkeypatch.setattr(segmenter, "TOGETHER", together)
            assert (segmenter.word_ends("".join(runs), size, costs) == want).all()
    assert segmenter.word_ends("xy", np.array([1, 1]), {}).all() and not len(segmenter.word_ends("", np.array([], int), {"a": 1.0}))


def test_many_runs_are_not_cut_letter_by_letter(monkeypatch):
    def never(*a):
        raise AssertionError("one run by itself")

    monkeypatch.setattr(segmenter, "cut", never)
    size = np.full(2000, 100)
    found = segmenter.word_ends("abc" * (size.sum() // 3) + "ab", size, {"abc": 1.0, "a": 2.0, "b": 2.0, "c": 2.0})
    assert len(found) == size.sum() and found[99] and found[-1]


def test_words_are_counted_without_postings(spark, tmp_path):
    shutil.copy(f"{DATA}/documents.parquet", tmp_path)
    want = sorted(segmenter.tx14_learned(spark, DATA).collect())
    assert sorted(segmenter.tx14_learned(spark, str(tmp_path)).collect()) == want
    assert {k[1] for k in V._stored if any(str(tmp_path) in f for f in k[2])} == {"chunks", "frequencies"}
    assert V.frequencies(spark, str(tmp_path)).exceptAll(V.terms(spark, DATA).select("term", "cf")).isEmpty()
    assert V.frequencies(spark, str(tmp_path)).agg(F.sum("cf")).first() == V.terms(spark, DATA).agg(F.sum("cf")).first()
