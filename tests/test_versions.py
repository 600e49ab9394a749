"""Page histories against a plain loop, slugs one after another, orders that are kept, the gate's cases."""

import random

from pyspark.sql import functions as F

from tessera.operators import storage
from tessera.operators import versions as P
from tessera.operators.tables import Store


def by_hand(edits):
    """Pages and their history, edit by edit."""
    pages, history = {}, []
    for page, at, *fields in sorted(edits, key=lambda e: e[:2]):
        old = pages.get(page)
        if old is None:
            title, content, status, by = fields
            pages[page] = [1, title, content or "", status, P.BY if by is None else by]
            history.append((page, 1, content or "", P.BY if by is None else by))
        elif any(f is not None for f in fields):
            history.append((page, old[0] + 1, fields[1] or old[2], fields[3] or old[4]))
            pages[page] = [old[0] + 1, *(o if f is None else f for o, f in zip(old[1:], fields))]
    return pages, history


def test_histories(spark):
    rng = random.Random(5)
    some = lambda *v: rng.choice([None, *v])
    # half of all edits are of one page, whose edits lie in several blocks
    edits = [(rng.choice([1, rng.randrange(2, 9)]), at, some("a", "b"), some("", "x", "yy", "zzz"), some("done"), some("", "u", "v")) for at in range(400)]
    pages, history = by_hand(edits)
    df = spark.createDataFrame(edits, P.EDITS)
    once = P.page_history(df, step=16)
    assert sorted(map(tuple, once.select("page_id", "version", "kept", "kept_by").collect()), key=lambda r: r[:2]) == sorted(history, key=lambda r: r[:2])
    s = Store(spark)
    for lo, hi in ((0, 150), (150, 151), (151, 400)):
        P.apply_edits(s, df.filter((F.col("at") >= lo) & (F.col("at") < hi)))
    assert sorted(map(tuple, s.get("versions").select("page_id", "version", "content", "changed_by").collect()), key=lambda r: r[:2]) == sorted(history, key=lambda r: r[:2])
    assert {r["page_id"]: [r[c] for c in P.PAGE[1:]] for r in s.get("pages").collect()} == pages
    P.apply_edits(s, df.limit(0))
    assert s.get("pages").count() == len(pages)
    assert P.page_history(spark.createDataFrame([(None, 1, "t", None, None, None), (1, None, "t", None, None, None)], P.EDITS)).count() == 0


def test_slugs(spark):
    titles = ["A b", "a-b", "a b 1", "A B!", "a b-3", "a, b", "", None, "--", "untitled 1", "a b", "Größe 7", "größe-7", "电镀 工艺", "x" * 5000]
    rows = [(i, t) for i, t in enumerate(titles)]
    got = {r["page_id"]: r["slug"] for r in P.unique_slugs(spark.createDataFrame(rows, "page_id long, title string"), step=4).collect()}
    assert len(set(got.values())) == len(titles)
    assert [got[i] for i in range(8)] == ["a-b", "a-b-2", "a-b-1", "a-b-4", "a-b-3", "a-b-5", "untitled", "untitled-2"]
    assert got[9] == "untitled-1" and got[11] == "größe-7" and got[12] == "größe-7-1" and got[13] == "电镀-工艺"
    assert P.unique_slugs(spark.createDataFrame([], "page_id long, title string")).count() == 0


def test_orders(spark):
    assert [r[0] for r in spark.createDataFrame([("　ＡＢ  ｃ１ ",), ("ab\tC1",), (None,)], "t string").select(P.normal_query(F.col("t"))).collect()] == ["ab c1", "ab c1", ""]
    cand = spark.createDataFrame([(1, "Ab  c", i, r, 1.0 / r) for r, i in enumerate((7, 8, 9, 5), 1)] + [(2, "ab c", i, r, 1.0) for r, i in enumerate((8, 7), 1)], "qid long, query string, id long, rank long, score double")
    best = spark.createDataFrame([(1, 9, 0.91234), (1, 7, 0.5), (1, 8, 0.1), (1, 5, 0.05)], "qid long, id long, score double")
    at = lambda t: F.lit(t).cast("timestamp")
    cache = P.orders(cand, best, 2, at("2024-01-01 00:00:00"))
    assert cache.count() == 1
    rows = lambda now, k=3: sorted((r["qid"], r["place"], r["id"], r["state"], r["score"]) for r in P.reordered(cand, cache, k, at(now)).collect())
    # the length wanted is part of the key
    assert {r[3] for r in rows("2024-01-01 01:00:00")} == {"miss"}
    assert rows("2024-01-02 00:00:00", 2) == [(1, 1, 9, "hit", 0.9123), (1, 2, 7, "hit", 0.5), (2, 1, 8, "miss", 1.0), (2, 2, 7, "miss", 1.0)]
    assert rows("2024-01-02 00:00:01", 2)[:2] == [(1, 1, 7, "expired", 1.0), (1, 2, 8, "expired", 0.5)]
    assert P.purged(cache, at("2024-01-02 00:00:01")).count() == 0 and P.purged(cache, at("2024-01-02 00:00:00")).count() == 1
    short = cache.withColumn("seq", F.slice("seq", 1, 1)).withColumn("created_at", F.lit(None).cast("timestamp"))
    assert sorted((r["place"], r["id"]) for r in P.reordered(cand.filter("qid = 1"), short, 2, at("2030-01-01")).collect()) == [(1, 9), (2, 7)]
    assert P.reordered(cand.limit(0), cache, 2, at("2024-01-01")).count() == 0


def test_gate(spark):
    rows = [("a.TXT", "x"), ("d/b.exe", "x"), ("c.md", ""), ("c.md", None), (None, "x"), (".txt", "x"), ("e.csv", "é" * (1 << 19) + "x"), ("f.tar.json", "{}"), ("g.pdf/h", "x")]
    got = [r["verdict"] for r in storage.upload_gate(spark.createDataFrame(rows, "name string, content string"), 1).collect()]
    assert got == ["ok", "unsupported", "empty", "empty", "unsupported", "unsupported", "too_large", "ok", "unsupported"]
