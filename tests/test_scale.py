"""What a query may shuffle or store, and brute force for the ways that were made for it."""

import hashlib
import random
import re
import shutil
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import vectors
from tessera.operators import fusion, graph, retrieval, rules, segmenter, text, upkeep
from tessera.plans import views as V
from tessera.session import shared_dir

registry.load()
DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrases_of_any_number_of_words(spark):
    text = [r["low"] for r in V.chunks(spark, DATA).orderBy("id").limit(40).select(F.lower("content").alias("low")).collect()]
    words = [w for w in text[3].split() if w.isalpha()]
    found = [text[0][10:60].strip(), " ".join(text[3].split()[2:4]), words[0], words[1][1:3], ".", ". ", "no such words anywhere in it", "zzqqx"]
    q = spark.createDataFrame(list(enumerate(found)), "qid int, phrase string")
    ids = {(r["qid"], r["id"]) for r in retrieval.phrase_candidates(spark, DATA, q).collect()}
    want = {(r["qid"], r["id"]) for r in V.chunks(spark, DATA).join(q, F.contains(F.lower("content"), F.col("phrase"))).select("qid", "id").collect()}
    assert {q for q, _ in want} >= {0, 1, 2, 3, 4, 5} and want <= ids


def test_no_row_is_stored_for_each_character(spark):
    registry.QUERIES["rt06_phrase"](spark, DATA).collect()
    folder = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    rows = {k[1]: spark.read.parquet(path).count() for k, path in V._stored.items() if path.startswith(folder)}
    words = V.chunks(spark, DATA).agg(F.sum("words")).first()[0]
    assert max(rows.values()) <= words


@pytest.mark.parametrize("name", ["wn01_file_cap", "rt05_bm25"])
def test_scores_are_added_up_where_the_file_lies(spark, name):
    assert not re.search(r"Exchange hashpartitioning\(qid#\d+L, (id|file_id)#", plan(registry.QUERIES[name](spark, DATA)))


def test_digests_of_many_rows(spark):
    rows = spark.range(200_000).select(F.col("id").alias("event_id"), F.lit("a").alias("kind"))
    snapshots = upkeep.Snapshots(spark, ["event_id"], "kind")
    snapshots.take(0, rows)
    total = sum(int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) for i in range(200_000))
    got = snapshots.verified(0).first()
    assert total >= 1 << 63 and got["whole"] and got["digest"] == (total + (1 << 63)) % (1 << 64) - (1 << 63)


def test_vectors_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "COMPARED", 3)
    monkeypatch.setattr(vectors, "ROWS", 60)
    for name in ("rt08_vector", "pf03_vector_threshold", "jn12_query_vectors", "rt29_semantic_cache", "tk10_relevant_results"):
        df = registry.QUERIES[name](spark, DATA)
        assert "NestedLoop" not in plan(df) and "CartesianProduct" not in plan(df)
        want = duckdb.connect().execute(registry.ORACLES[name].replace("FROM embeddings", f"FROM '{DATA}/embeddings.parquet'"))
        names = [x[0] for x in want.description]
        near = lambda rows: sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows)
        assert near(tuple(r) for r in df.select(*names).collect()) == near(want.fetchall())


def test_vectors_without_length_are_at_zero(spark):
    kind = "qid bigint, score double, id bigint"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id bigint, v array<double>")
    queries = spark.createDataFrame([(7, [2.0, 0.0])], "qid bigint, v array<double>")
    got = vectors.compared(queries, rows, lambda qid, about, score: vectors.leading(qid, about, score, 5), kind)
    assert {(r["id"], r["score"]) for r in got.collect()} == {(1, 1.0), (2, 0.0), (3, 0.0)}


def test_pairs_are_listed_where_the_chunk_lies(spark):
    df = registry.QUERIES["jn10_pairs_in_chunk"](spark, DATA)
    assert df.columns == ["chunk_id", "source", "target"] and "Exchange" not in plan(df)
    weights = df.groupBy("source", "target").agg(F.count("*").alias("weight"))
    assert sorted(map(tuple, weights.collect())) == sorted(map(tuple, V.edges(spark, DATA).collect()))


class Counted(dict):
    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)


def test_runs_are_cut_without_looking_for_words_that_nothing_begins():
    costs = Counted({"a": 2.0, "ab": 1.0, "abc": 2.5, "c": 1.5, "bc": 1.0, "abcdefghijklmnopqrst": 9.0})
    run = "abcabxbc" * 50
    assert segmenter.cut("abc", costs) == ["abc"] and segmenter.cut("abxbc", costs) == ["ab", "x", "bc"]
    costs.asked = 0
    assert "".join(segmenter.cut(run, costs)) == run and costs.asked < 4 * len(run)


def test_words_are_counted_in_one_way_through_them(spark):
    words = [f"w{i * i % 20011}" for i in range(60_000)]
    df = spark.createDataFrame([(1, words), (2, [])], "id int, w array<string>").select("id", F.sort_array("w").alias("w"))
    got = {r["id"]: r["n"] for r in df.select("id", vectors.counts(F.col("w")).alias("n")).collect()}
    assert got == {1: dict(Counter(words)), 2: {}}


def test_vectors_of_words_by_brute_force(spark):
    rows = [["a", "b", "a", "ab", "ñu"], [], None, [f"w{i}" for i in range(300)]]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, w array<string>")
    for r in df.select("id", vectors.hashed(F.col("w")).alias("h")).collect():
        v = [0] * vectors.DIMENSIONS
        for w in rows[r["id"]] or ():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            v[h % vectors.DIMENSIONS] += 1 if h // vectors.DIMENSIONS % 2 == 0 else -1
        assert r["h"]["v"] == v and r["h"]["norm"] == (None if rows[r["id"]] is None else sum(x * x for x in v) ** 0.5)


@pytest.mark.parametrize("name", ["tx09_garble", "wn11_segment_ratios"])
def test_segments_are_counted_over_the_text_once(spark, name):
    assert "regexp_replace" not in plan(registry.QUERIES[name](spark, DATA))


def test_readable_shares_by_brute_force():
    draw = random.Random(3)
    for n in (0, 1, 23, 24, 25, 799, 801, 5000):
        t = "".join(draw.choice("aZ9 é×ÿ\u0100\n.汉😀\x00") for _ in range(n))
        want = []
        for i in range(24):
            seg = t[i * (n // 24) : i * (n // 24) + 800]
            want.append(len(re.sub("[^a-zA-ZÀ-ÿ0-9 ]", "", seg)) / max(len(seg), 1))
        assert list(text.readable_shares(t)) == want
    assert text.readable_shares(None) is None


def test_texts_without_names_are_passed_over_by_one_test(spark):
    bits = [*rules.MATERIALS, *rules.CONNECTORS, *rules.PROCESSES, *rules.PARAMS, "温度范围: -40 ~ 125", "GB/T 2423.1-2008", "QC/T\n1067", "iso 916", "mlg12-3", "xMLG7", "_PP", "ſPP", "中", "-", ".", "a"]
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice(bits) + draw.choice(["", " ", "-", "a"]) for _ in range(draw.randint(0, 4)))) for i in range(2000)] + [(-1, None)]
    t = F.col("text")
    df = spark.createDataFrame(rows, "id long, text string")
    every = [rules.word_test(t, n) for n in (*rules.MATERIALS, *rules.CONNECTORS, *rules.PROCESSES)]
    every += [t.rlike(p) for p in (f"(?i){rules.CONNECTOR_SERIES}", f"(?i){rules.STANDARDS}", *rules.PARAMS.values(), rules.TEMPERATURE)]
    hit = F.lit(False)
    for e in every:
        hit = hit | e
    left_out = ~(t.rlike(rules.HAN) | t.rlike(rules.NAMED) | t.rlike(rules.NUMBERED))
    assert df.filter(hit).filter(left_out).isEmpty() and not df.filter(left_out).isEmpty()
    assert re.search(r"Filter [^\n]*RLIKE", plan(rules.rule_entities(df)))


def test_near_names_by_brute_force():
    draw = random.Random(7)
    for band in (0, 3, 100):
        c, p = ([(draw.randint(0, 40), draw.choice("abcdef") + k) for _ in range(60)] for k in "cp")
        want = {}
        for i, x in c:
            for j, y in p:
                if abs(i - j) <= band:
                    want[x, y] = min(abs(i - j), want.get((x, y), band))
        assert {(x, y): far for x, near in graph.near_names(c, p, band).items() for y, far in near.items()} == want


def test_pairs_of_a_file_go_around_once_as_lists(spark):
    got = plan(registry.QUERIES["gr08_spec_edges"](spark, DATA))
    assert len(re.findall(r"Exchange hashpartitioning", got)) == 2 and not re.search(r"Exchange hashpartitioning\([^)]*target", got)


def neighbourhood(edges, center, hops, most):
    """What ``local_graphs`` returns for one number of hops, step by step."""
    n = max(1, min(hops, graph.FARTHEST))
    near, hop, todo = {}, {center: 0}, [center]
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for x in todo:
        for y in sorted(near.get(x, ()) if hop[x] < n else ()):
            if y not in hop:
                hop[y] = hop[x] + 1
                todo.append(y)
    met = [(a, b, w) for a, b, w in edges if min(hop.get(a, n), hop.get(b, n)) < n]
    weight = Counter()
    for a, b, w in met:
        weight.update({a: 101 if w >= 3 else 1})
        weight.update({b: 101 if w >= 3 else 1})
    kept = sorted(hop, key=lambda x: (hop[x] > 0, -weight[x], x))[:most]
    ins, outs = (Counter(e[i] for e in met if e[0] in kept and e[1] in kept) for i in (1, 0))
    return {(hops, x, hop[x], ins[x] + outs[x], ins[x], outs[x], len(hop)) for x in kept}


def test_neighbourhoods_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graph, "BITS", 16)
    draw = random.Random(2)
    for many, most in ((110, 5), (60, 40), (300, 40)):
        pairs = {tuple(sorted((f"n{draw.randint(0, 80)}", f"n{int(draw.random() ** 3 * 80)}"))) for _ in range(many)}
        rows = [(a, b, draw.randint(1, 4)) for a, b in sorted(pairs) if a != b]
        e = spark.createDataFrame(rows, "source string, target string, weight bigint")
        for center in (rows[0][0], "nowhere"):
            got = graph.local_graphs(e, spark.createDataFrame([(center,)], "name string"), (1, 2, 3, 9), most)
            assert {tuple(r) for r in got.collect()} == set().union(*(neighbourhood(rows, center, h, most) for h in (1, 2, 3, 9)))
    assert graph.local_graphs(e, spark.createDataFrame([], "name string"), (1, 2)).isEmpty()


def test_walks_keep_no_copies_of_edges(spark, monkeypatch):
    V.edges(spark, DATA)

    def never(df):
        raise AssertionError("a checkpoint")

    monkeypatch.setattr(graph, "cut", never)
    assert registry.QUERIES["gr14_hops"](spark, DATA).count()


def test_relevant_pairs_are_not_sorted(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vectors, "HELD", (50, 2))
    draw = random.Random(4)
    v = [[draw.random(), draw.random(), 0.0] for _ in range(230)]
    v[50], v[100], v[150] = [-1.0, -1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, -1.0]  # one other, of many at less, is to be found
    rows = spark.createDataFrame([(i, x, i % 10) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    df = registry.QUERIES["tk10_relevant_results"](spark, str(tmp_path))
    # what is ranked is cut to two a query before; the pairs go from where they are found into the result
    assert "WindowGroupLimit" in plan(df) and "CoGroup" not in plan(df) and len(re.findall(r"Exchange", plan(df))) == 3
    want = duckdb.connect().execute(registry.ORACLES["tk10_relevant_results"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'"))
    assert [x[0] for x in want.description] == df.columns
    near = lambda rows: sorted((q, i, round(s, 4)) for q, i, s in rows)
    got = near(df.collect())
    assert got == near(want.fetchall()) and sum(q == 50 for q, _, _ in got) == 2


def test_foremost_of_blocks():
    r = np.random.default_rng(6)
    for k in (1, 3, 40):
        score, ids = r.integers(0, 6, (7, 90)).astype(float), r.permutation(1000)[:90]
        score[score == 0], score[6] = -np.inf, -np.inf
        top = vectors.Foremost(7, k)
        for i in range(0, 90, 20):
            top.add(score[:, i : i + 20], ids[i : i + 20])
        want = [(q, i) for q in range(7) for _, i in sorted((-s, i) for s, i in zip(score[q], ids) if s > 0)[:k]]
        assert list(zip(top.query, top.ids)) == want


def test_words_are_scored_where_the_file_lies_and_cut_there(spark, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    twice = docs.limit(40).withColumn("doc_id", F.lit(7).cast("bigint"))  # documents of one id
    docs.union(twice).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (DATA, str(tmp_path)):
        for held, limit in ((2_000_000, 200), (3000, 5)):
            monkeypatch.setattr(retrieval, "SCORES", held)
            near = lambda df: sorted((r["qid"], r["rank"], r["id"], r["file_id"], round(r["score"], 5)) for r in df.collect())
            assert near(retrieval.best_bm25(spark, d, limit)) == near(retrieval.ranked(retrieval.bm25(spark, d), limit=limit))
    assert re.search(r"MapInArrow", plan(fusion.lexical(spark, DATA))) and "HashAggregate" not in plan(fusion.lexical(spark, DATA))


def test_what_is_stored_of_chunks(spark):
    got = V.postings(spark, DATA).select("id", "file_id", "chunk_index", "words", "term", "tf")
    assert spark.read.parquet(V._stored[V._seen(spark, DATA, "postings")]).columns == ["id", "words", "term", "tf", "part"]
    c = V.chunks(spark, DATA).select("id", "file_id", "chunk_index", "words", F.explode(V.tokens(F.col("content"))).alias("term"))
    want = c.groupBy(*c.columns).agg(F.count("*").alias("tf"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    h = vectors.hashed(V.content_words(F.col("content")))
    want = V.chunks(spark, DATA).select("id", "file_id", h.alias("h")).select("id", "file_id", "h.v", "h.norm").filter("norm > 0")
    got = V.vectors(spark, DATA)
    assert got.dtypes == want.dtypes and got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_what_is_looked_for_goes_to_the_chunks(spark):
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        assert "SortMergeJoin" not in plan(registry.QUERIES["rt10_graph_recall"](spark, DATA))
        assert not re.search(r"Exchange hashpartitioning\(id#", plan(fusion.reranked(spark, DATA)))
    finally:
        spark.conf.set(size, before)


def test_a_task_keeps_its_files_open(spark, monkeypatch, tmp_path):
    # Spark goes over to sorting as soon as a task has as many writers as it may have
    shutil.copy(f"{DATA}/documents.parquet", tmp_path)
    conf, told = type(spark.conf), []
    before = conf.set
    monkeypatch.setattr(conf, "set", lambda self, key, value: (told.append((key, value)), before(self, key, value))[1])
    V.postings(spark, str(tmp_path))
    most = [int(value) for key, value in told if key.endswith("maxConcurrentOutputFileWriters")]
    assert max(most) > V.PARTS and most[-1] == 0
