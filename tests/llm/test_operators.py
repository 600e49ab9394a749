"""The ten operators against brute force, libraries, round trips and edge rows, on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import components, embedding_dedup, language_id, line_dedup, media, minhash, packing, phrase_dedup, piece_sampling, suffix_dedup, token_count

BPE = P.path("byte_bpe_50k.json")
EDGE = [None, "", " ", "a", "ab" * 300, "x" * 500, "the the " * 120, "a b\n\tc  " * 90, "日本 🙂 ▁ <|endoftext|> \x00é" * 12, "\n\n\n"]


def texts(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(70))
    out = []
    for i in range(n):
        t = " ".join(r.choice(words) for _ in range(r.randint(30, 160)))
        if i % 5 == 0:
            t = t[:200] + " " + passage + " " + t[200:]
        out.append(t)
    return out + [out[3], out[3], out[7] + " more"] + EDGE


def table(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    # columns with names that operators use inside
    return df.selectExpr("*", "1 as start", "'x' as id", "2 as _text", "3 as component") if extra else df


def test_suffix_dedup(spark):
    rows = texts()
    seen, want = set(), {}
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        want[i] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(table(spark, rows, True)).collect()}
    assert got == want


def test_suffix_dedup_long_and_binary(spark, monkeypatch):
    r = random.Random(2)
    every = "".join(map(chr, range(1, 128))) * 3 + "".join(chr(x) for x in range(0x80, 0x800))
    long = "".join(r.choice("acgt") for _ in range(40_000))
    monkeypatch.setattr("tessera.llm.kernels.STEP", 4096)
    got = suffix_dedup.remove_repeats(table(spark, [long, every, long[5000:9000], every, "y" + every])).collect()
    gone = {x["doc_id"]: x["n_removed"] for x in got}
    assert gone[0] == 0 and gone[2] == 4000 and gone[3] == len(every.encode()) and gone[4] == len(every.encode())


def complements(n=1024):
    """Two strings of n characters whose polynomial hashes modulo a power of two are equal."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_equal_hashes_are_not_equal_runs(spark):
    a, b = complements()
    words = " ".join(f"w{i}" for i in range(34))
    rows = [f"{words} {a}", f"{words} {b}", f"{words} {a}"]
    got = {x["doc_id"]: x["n_removed"] for x in phrase_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == {0: 35, 1: 0, 2: 35}
    r = random.Random(13)
    noise = lambda n: "".join(r.choice("ghijklmnop") for _ in range(n))
    rows = [noise(r.randint(0, 40)) + (a, b)[i % 2][r.randint(0, 3) :] + noise(r.randint(0, 40)) for i in range(60)]
    seen, want = set(), {}
    for i, t in enumerate(rows):
        gone = set()
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(t[k : k + 100])
        want[i] = len(gone)
    assert {x["doc_id"]: x["n_removed"] for x in suffix_dedup.remove_repeats(table(spark, rows)).collect()} == want


def test_phrase_dedup(spark):
    rows = texts(3)
    count, at = Counter(), []
    for i, t in enumerate(rows):
        w = phrase_dedup.WORD.findall(t or "")
        for k in range(len(w) - 34):
            x = tuple(w[k : k + 35])
            count[x] += 1
            at.append((i, k, x))
    gone = {}
    for i, k, x in at:
        if count[x] > 1:
            gone.setdefault(i, set()).update(range(k, k + 35))
    for r in phrase_dedup.remove_repeats(table(spark, rows, True)).collect():
        w = phrase_dedup.WORD.findall(rows[r["doc_id"]] or "")
        out = gone.get(r["doc_id"], set())
        kept = " ".join(x for i, x in enumerate(w) if i not in out)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(out), hashlib.sha256(kept.encode()).hexdigest())
    assert phrase_dedup.cut_out("a b  c\nd", [(1, 3)]) == "a d"


def test_texts_of_one_id(spark):
    """Ids that stand for several texts, rows given twice, negative and null ids: the window operators against brute force, where
    the texts of an id are documents in the order of their digests."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(3)]
    text = lambda: " ".join(r.choice([*passage, *(" ".join(word() for _ in range(30)) for _ in range(3))]) for _ in range(r.randint(1, 6)))
    rows = [(r.choice([-3, 1, 1, 1, 2, 7]), text()) for _ in range(40)] + [(2, ""), (2, None), (1, passage[0] + " " + passage[0]), (1, "short other text")]
    rows += rows[:12] + [(8, rows[0][1]), (None, passage[1]), (None, passage[1]), (None, None)]
    texts_ = sorted({(i, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows if i is not None})
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    seen, gone, count = set(), {}, Counter()
    for i, h, t in texts_:
        raw = t.encode()
        out = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                out[k : k + 100] = True
            seen.add(w)
        gone[i, h] = out
        words = phrase_dedup.WORD.findall(t)
        count.update(tuple(words[k : k + 35]) for k in range(len(words) - 34))
    want, want_words = [], []
    for i, t in rows:
        raw, words = (t or "").encode(), phrase_dedup.WORD.findall(t or "")
        out = gone.get((i, digest(raw)), np.zeros(len(raw), bool))
        edges = np.diff(np.concatenate([[0], out.astype(int), [0]]))
        want.append((i, len(raw), int(out.sum()), int((edges == 1).sum()), digest(bytes(np.frombuffer(raw, np.uint8)[~out]))))
        hit = {x for k in range(len(words) - 34) if i is not None and count[tuple(words[k : k + 35])] > 1 for x in range(k, k + 35)}
        want_words.append((i, len(words), len(hit), digest(" ".join(w for k, w in enumerate(words) if k not in hit).encode())))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, phrase_dedup.remove_repeats(df).collect()), key=str) == sorted(want_words, key=str)
    clash = df.selectExpr("*", "1 as _tie", "2 as _id", "3 as _text", "4 as _i")
    assert sorted(map(tuple, suffix_dedup.remove_repeats(clash).collect()), key=str) == sorted(want, key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [b + rng.normal(size=16) * 0.05 for b in base for _ in range(3)] + [base[0]] * 3
    vec = [[float(x) for x in v] for v in rows] + [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, []]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(list(enumerate(vec)), "vec_id long, embedding array<double>")).collect()}
    u = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert [got[i]["n_links"] for i in range(len(rows))] == near.sum(1).tolist()
    for i in range(len(rows), len(vec)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    root = groups_of(len(rows), zip(*np.nonzero(near)))
    assert [(got[i]["component_id"], got[i]["kept"]) for i in range(len(rows))] == [(root[i], root[i] == i) for i in range(len(rows))]


def groups_of(n, pairs):
    """The least member of each one's group."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = sorted((find(int(a)), find(int(b))))
        root[b] = a
    return [find(i) for i in range(n)]


def test_embeddings_dense_topic(spark):
    """Many vectors about one direction, planted pairs among them: links by brute force in blocks."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=64) + rng.normal(size=(3000, 64)) * 0.37
    v[1:400:2] = v[0:400:2] + rng.normal(size=(200, 64)) * 0.25
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i][0] for i in range(len(v)))
    assert near.sum() > 150 and found >= 0.9 * near.sum()
    assert all(got[i][0] <= near[i].sum() for i in range(len(v)))


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x["id"]: x["component"] for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if x != 7 or True and any(7 in e and e[0] != e[1] for e in edges)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_minhash(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(20):
        w = [word() for _ in range(300)]
        v = list(w)
        v[10] = word()
        rows += [" ".join(w), " ".join(v)]
    rows += [rows[0], *EDGE]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(table(spark, rows, True)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == i and got[i + 1] == i for i in range(0, 40, 2)) and got[40] == 0
    assert all(got[41 + i] == 41 + i for i in range(len(EDGE)))


def test_minhash_crowded_bucket(spark, monkeypatch):
    """Many texts that share a passage without being alike, near copies among them: the same groups by pairs alone."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(120))
    rows = [passage + " " + " ".join(word() for _ in range(r.randint(18, 45))) for _ in range(150)]
    rows += [t + " " + word() for t in rows[:20]]
    df = table(spark, rows)
    groups = lambda: {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df).collect()}
    by_prefix = groups()
    assert all(by_prefix[i] == by_prefix[150 + i] for i in range(20))
    monkeypatch.setattr(components, "PARTNERS", 1 << 30)
    assert by_prefix == groups()


def test_minhash_exact_frequencies(spark, monkeypatch):
    """Texts of common shingles, with a tenth of rare ones each, are apart, also where the table of places tells nothing."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(300))
    rows = [passage + " " + " ".join(word() for _ in range(30)) for _ in range(30)]
    rows.append(rows[4] + " " + word())
    monkeypatch.setattr(minhash, "document_frequencies", lambda *_: np.full(minhash.PLACES, 5))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i for i in range(30)} | {30: 4}


def test_weighted_samples_match_weighted_jaccard():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 48, 200).astype(np.uint64)
    a, b = rng.uniform(1, 5, 200).astype(np.float32), rng.uniform(1, 5, 200).astype(np.float32)
    row = np.repeat([0, 1], 200)
    got = minhash.samples(row, np.concatenate([h, h]), np.concatenate([a, b]), 2, 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[1]).mean() - want) < 0.04


def test_lines(spark):
    a = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [a + "\nown line one", a.upper() + "!\nown line two", None, "", "...", "own line one"]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(spark, rows, True)).collect()}
    assert got[1]["kept"] == "own line two" and got[0]["kept"] == rows[0] and got[5]["kept"] == ""
    assert got[2]["kept"] is None and got[2]["n_lines"] == 0 and got[4]["kept"] == "..."
    r = random.Random(7)
    for _ in range(300):
        x, y = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            e = [i]
            for j, k in enumerate(y, 1):
                e.append(min(d[j] + 1, e[j - 1] + 1, d[j - 1] + (c != k)))
            d = e
        assert line_dedup.edit_distance(x, y) == d[-1]


def test_lines_changed(spark):
    """Lines with one changed word, or one character where lines are short: all pairs at similarity 0.8 are found."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 8)))
    rows = []
    for size in (6, 10, 20, 30, 50):
        for _ in range(60):
            w = [word() for _ in range(size)]
            v = list(w)
            v[r.randrange(size)] = word()
            rows.append((" ".join(w), " ".join(v)))
    for size in (5, 6, 8, 10):
        for _ in range(40):
            w = "".join(r.choice("abcdefghijklmnopqrst") for _ in range(size))
            at = r.randrange(size)
            rows.append((w, w[:at] + r.choice("uvwxyzé") + w[at + 1 :]))
    like = [line_dedup.alike(*p) for p in rows]
    assert sum(like) > 400
    got = {x["doc_id"]: x["kept"] for x in line_dedup.dedup_lines(table(spark, [t for p in rows for t in p])).collect()}
    found = [got[2 * i + 1] == "" for i in range(len(rows))]
    assert not any(f and not k for f, k in zip(found, like, strict=True))
    assert sum(found) >= 0.99 * sum(like)
    assert all(got[2 * i] for i in range(300))


def test_media(spark):
    html = "<p>One <b>two</b></p><figure><img src='sha256:d1'><figcaption>Cap</figcaption></figure><script>no</script><p>End</p><img src='sha256:zz'>"
    pages = spark.createDataFrame([(1, html), (2, None)], "p long, h string")
    made = media.store(spark.createDataFrame([("payload",), (None,), ("payload",)], "t string"), "t")
    assert made.count() == 2
    rows = media.resolve(media.parse_sequences(pages, "p", "h"), made.limit(0)).orderBy("position").collect()
    assert [(r["kind"], r["text"], r["digest"], r["caption"]) for r in rows] == [("text", "One two", None, None), ("media", None, "d1", "Cap"), ("text", "End", None, None), ("media", None, "zz", None)]
    for raw in (b"", b"a", b"x" * 64, b"y" * 65):
        assert media.from_graymap(media.to_graymap(media.padded(raw))).tobytes() == raw + bytes((-len(raw) % 64) or (0 if raw else 64))


def test_tokens_and_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = texts(8)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in rows]
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(table(spark, rows, True), BPE).collect()}
    assert got == {i: len(x) for i, x in enumerate(ids)}
    pieces = packing.pack(table(spark, rows, True), BPE, capacity=64, group_docs=16).collect()
    held, whole = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == held.get(p["sequence_id"], 0) and p["length"] > 0
        held[p["sequence_id"]] = p["offset"] + p["length"]
        part = (ids[p["doc_id"]] + [0])[p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
        whole.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    assert max(held.values()) <= 64 and sum(held.values()) / (64 * len(held)) > 0.9
    for i, spans in whole.items():
        assert sum(n for _, n in spans) == len(ids[i]) + 1
    assert set(whole) == set(range(len(rows)))


def test_first_fit_is_first():
    sizes = np.array([5, 7, 3, 2, 9, 1, 4, 4])
    bins, _ = packing.first_fit_decreasing(sizes, 10)
    room, want = [10] * 8, {}
    for i in np.argsort(-sizes, kind="stable"):
        want[i] = next(b for b in range(8) if room[b] >= sizes[i])
        room[want[i]] -= sizes[i]
    assert [want[i] for i in range(8)] == bins.tolist()


def test_pieces(spark):
    rows = texts(9)
    m = P.path("piece_bpe_32k.model")
    a, b = (sorted(piece_sampling.encode_column(table(spark, rows, True).repartition(n), m).collect(), key=lambda r: r["doc_id"]) for n in (1, 5))
    assert all(r["lossless"] for r in a) and [r["ids"] for r in a] == [r["ids"] for r in b]


def test_language(spark):
    r = random.Random(10)
    word = {"en": "the and of that with".split(), "fr": "été où ça même déjà".split(), "de": "über für größe daß schön".split()}
    rows = [(i, " ".join(r.choice(word[k]) for _ in range(60)), k) for i in range(60) for k in [list(word)[i % 3]]] + [(100, None, "en"), (101, "123 ...", "fr"), (102, "the and of", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.learn(df, df["doc_id"] % 5 != 0)
    got = {x["doc_id"]: x for x in language_id.predict(df, net, ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:60]) and all(0 <= x["score"] <= 1 for x in got.values())
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "en"
    assert language_id.learn(df.limit(0), df["doc_id"] > 0) is None


@pytest.mark.parametrize("op", [suffix_dedup.remove_repeats, phrase_dedup.remove_repeats, line_dedup.dedup_lines, minhash.near_duplicates, lambda d: token_count.count_tokens(d, BPE), lambda d: packing.pack(d, BPE)])
def test_empty_and_null_ids(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = op(spark.createDataFrame([(None, "a b c"), (None, None), (1, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert len(rows) == 4


def weighted_jaccard_groups(rows, similarity=0.8):
    words = [(t or "").lower().split() for t in rows]
    grams = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    df = Counter(g for c in grams for g in c)
    weight = [{g: n * np.log1p(len(rows) / df[g]) for g, n in c.items()} for c in grams]
    total = [sum(w.values()) for w in weight]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            shared = sum(min(x, weight[j][g]) for g, x in weight[i].items() if g in weight[j])
            if grams[i] and grams[j] and shared >= similarity * (total[i] + total[j] - shared):
                pairs.append((i, j))
    return groups_of(len(rows), pairs)


def test_minhash_brute_force(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(60)]
    rows = [None, "", "one two"]
    for _ in range(40):
        w = [word() for _ in range(r.randint(40, 250))]
        w[5:5] = shared[: r.choice([0, 0, 30, 60])]
        rows.append(" ".join(w))
        for _ in range(r.choice([0, 1, 2])):
            v = list(w)
            for _ in range(r.choice([1, 2, 4, 8])):
                v[r.randrange(len(v))] = word()
            rows.append(" ".join(v))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == weighted_jaccard_groups(rows)


def line_groups(rows):
    """What op 4 should keep of each text, by comparing all lines with all."""
    lines, first = [], {}
    for i, t in enumerate(rows):
        for k, f in enumerate(line_dedup.normal_lines(t or "")):
            if f:
                first.setdefault(f.decode(), (i, k))
    lines = list(first)
    root = groups_of(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if line_dedup.alike(lines[i], lines[j])])
    keeper = {}
    for i, f in enumerate(lines):
        keeper[root[i]] = min(keeper.get(root[i], first[f]), first[f])
    number = {f: i for i, f in enumerate(lines)}
    out = []
    for i, t in enumerate(rows):
        forms = line_dedup.normal_lines(t or "")
        kept = [x for k, (x, f) in enumerate(zip((t or "").split("\n"), forms)) if not f or keeper[root[number[f.decode()]]] == (i, k)]
        out.append(t if t is None else "\n".join(kept))
    return out


def line_rows(seed=31, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 8)))
    common = [" ".join(word() for _ in range(r.randint(4, 30))) for _ in range(12)]
    rows = [None, "", "...", "x", "É" * 600 + "\n" + "É" * 590]
    for _ in range(n):
        held = []
        for _ in range(r.randint(1, 6)):
            w = (r.choice(common) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(3, 40)))).split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = word()
            held.append(" ".join(w).capitalize() + r.choice([".", "", "!"]))
        rows.append("\n".join(held))
    return rows


def test_lines_brute_force(spark):
    rows = line_rows()
    got = {x["doc_id"]: x["kept"] for x in line_dedup.dedup_lines(table(spark, rows, True)).collect()}
    want = line_groups(rows)
    same = sum(got[i] == want[i] for i in range(len(rows)))
    # candidates are drawn, so that a pair may be missed; nothing else is ever dropped
    assert same >= 0.95 * len(rows)
    assert all(len(got[i] or "") >= len(want[i] or "") for i in range(len(rows)))


def test_lines_of_one_passage_are_no_rows_for_each_pair(spark, monkeypatch):
    """Lines that share a passage without being alike: pairs that become rows grow with the lines, not with their square; and those
    that are alike are found."""
    r = random.Random(35)
    own = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = own(52)
    rows = [own(36) + passage for _ in range(200)]
    rows += [rows[i][:7] + "é" + rows[i][8:] for i in range(0, 200, 20)]
    rows = [t if i % 2 else t.upper() for i, t in enumerate(rows)]
    made, compare = [], components.compare_stars
    monkeypatch.setattr(components, "compare_stars", lambda stars, *x: made.append(stars.count()) or compare(stars, *x))
    monkeypatch.setattr(components, "BLOCK", 16)
    got = {x["doc_id"]: x["kept"] for x in line_dedup.dedup_lines(table(spark, rows, True)).collect()}
    want = line_groups(rows)
    assert sum(got[i] == want[i] for i in range(len(rows))) >= 0.97 * len(rows)
    assert all(len(got[i]) >= len(want[i]) for i in range(len(rows)))
    assert sum(made) <= 10 * len(rows)


def test_lines_of_a_block():
    """All alike pairs of different groups are joined, whatever the counts of characters leave out."""
    r = random.Random(36)
    rows = []
    for _ in range(30):
        line = "".join(r.choice("abcé ü中") for _ in range(r.randint(1, 60)))
        for _ in range(3):
            v = list(line)
            for _ in range(r.randint(0, len(v) // 4)):
                v[r.randrange(len(v))] = r.choice("abcdé")
            rows.append("".join(v))
    n = len(rows)
    columns = [np.array([len(t) for t in rows]), *np.zeros((2, n), np.int64)]
    own = np.arange(n)
    want = groups_of(n, [(i, j) for i in range(n) for j in range(i) if line_dedup.alike(rows[i], rows[j])])
    assert groups_of(n, list(zip(*line_dedup.linked_lines(own, None, columns, rows, 0.8), strict=True))) == want
    # two blocks meet, and each is met in itself elsewhere
    half = own % 2
    links = [(i, j) for i, j in zip(*line_dedup.linked_lines(own, half, columns, rows, 0.8), strict=True)]
    assert all(half[i] != half[j] for i, j in links)
    for k in (0, 1):
        at = np.flatnonzero(half == k)
        links += [(at[i], at[j]) for i, j in zip(*line_dedup.linked_lines(own[at], None, [c[at] for c in columns], [rows[i] for i in at], 0.8), strict=True)]
    assert groups_of(n, links) == want


def test_simhashes_of_a_block():
    """Bits of SimHashes are counted whatever their signs."""
    line = "".join(random.Random(37).choice("abcdefgh ") for _ in range(300))
    one, other = np.array([-1, 5, 7, 9, -3]), np.array([0, -6, -8, -9, 4])
    for x in one.tolist():
        for y in other.tolist():
            columns = [np.array([300, 300]), np.array([x, y]), np.array([0, 0])]
            close = ((x ^ y) & (1 << 64) - 1).bit_count() <= line_dedup.APART
            assert line_dedup.linked_lines(np.array([1, 2]), None, columns, [line, line[:-1] + "z"], 0.8) == (([0], [1]) if close else ([], []))


def test_simhash_and_bounds():
    r = random.Random(32)
    rows = [x for t in line_rows(33) if t for x in t.split("\n")]
    forms = [f.encode() for f in rows if f.strip()]
    sims = line_dedup.simhashes(forms)
    again = np.concatenate([line_dedup.simhashes([f]) for f in forms])
    assert (sims == again).all()
    for _ in range(300):
        a, b = r.choice(rows), r.choice(rows)
        longer = max(len(a), len(b), 1)
        assert line_dedup.alike(a, b) == (line_dedup.edit_distance(a, b) <= 0.2 * longer + 1e-9)


def corpus(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_media_query(spark, tmp_path):
    from tessera.llm import queries

    rows = [t if t is None else t[:3000] for t in EDGE] + ["é" * 32, "y" * 64, "y" * 65, "y" * 64, "<b>&amp;</b>"]
    where = corpus(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in enumerate(rows)] + [(None, "no id", None, None, None)])
    got = {x["doc_id"]: x for x in queries.op5_media_columns(spark, where).collect()}
    assert len(got) == len(rows) + 1
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        x = got[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (x["media_bytes"], x["media_sha256"], x["caption"]) == (len(stored), hashlib.sha256(stored).hexdigest(), f"document {i}")
    assert got[len(EDGE) + 1]["feature"] == got[len(EDGE) + 3]["feature"]


def test_unresolved_media_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "<p>t</p><img src='sha256:nope'>"), (2, None)], "p long, h string")
    made = media.store(spark.createDataFrame([("x",)], "t string"), "t")
    rows = media.read_back(media.resolve(media.parse_sequences(pages, "p", "h"), made)).collect()
    assert [(r["page"], r["position"], r["payload_bytes"]) for r in rows] == [(1, 1, None)]


def test_piece_samples_follow_the_lattice():
    m = piece_sampling.model(P.path("piece_bpe_32k.model"))
    piece = {}
    for text in ("there", "aan"):
        n = 6000
        got = Counter(tuple(x.tolist()) for x in piece_sampling.sample(m, [text] * n, piece_sampling.row_seeds(list(range(n)), 3), 0.2))
        lat = piece_sampling.Lattices(m, [text], 0.2)
        # weights of all paths by enumeration, from the pieces and scores of the model
        score = {int(i): s for i, s in zip(m.id, m.score)}
        names = {i: m.bytes_of[i].decode() for i in score}
        by_text = {}
        for i, t in names.items():
            by_text.setdefault(t, i)
        paths = {}

        def walk(at, ids, weight):
            if at == len(text):
                paths[tuple(ids)] = np.exp(0.2 * weight)
                return
            for end in range(at + 1, len(text) + 1):
                i = by_text.get(text[at:end])
                if i is not None:
                    walk(end, [*ids, i], weight + score[i])

        walk(0, [], 0.0)
        total = sum(paths.values())
        assert set(got) <= set(paths) and len(lat.frm) >= len(text)
        assert all(abs(got[p] / n - w / total) < 0.03 for p, w in paths.items())
        piece[text] = got


def test_long_word_is_one_lattice():
    m = piece_sampling.model(P.path("piece_bpe_32k.model"))
    text = "there" * 2000
    ids = piece_sampling.sample(m, [text], piece_sampling.row_seeds([1], 3), 0.2)[0]
    assert piece_sampling.decode(m, ids.tolist()) == text and len(piece_sampling.words_of(text)) == 1


@pytest.mark.parametrize("op", [lambda d: piece_sampling.encode_column(d, P.path("piece_bpe_32k.model")), lambda d: language_id.predict(d, None, ["doc_id"]), lambda d: media.read_back(media.resolve(media.parse_sequences(d, "doc_id", "text"), media.store(d, "text")))])
def test_empty_tables_and_null_ids_of_the_rest(spark, op):
    kind = "doc_id long, text string"
    assert op(spark.createDataFrame([], kind)).count() == 0
    rows = op(spark.createDataFrame([(None, "<img src='sha256:a'>"), (None, None), (1, "<img src='sha256:a'>"), (1, "<img src='sha256:a'>")], kind)).collect()
    assert len(rows) in (3, 4)


def test_embeddings_empty_and_null_ids(spark):
    kind = "vec_id long, embedding array<double>, rep string, raw long"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], "x", 1), (1, [1.0, 2.0], "x", 1), (1, [1.0, 2.0], "x", 1), (2, None, "x", 1)], kind)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in rows) == [("1", 1), ("1", 1), ("2", 0), ("None", 0)]


def test_repeated_rows_are_packed_in_many_groups(spark):
    rows = [(5, "some words to pack")] * 300 + [(None, "no id")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, BPE, group_docs=20).collect()
    assert len(got) == 600 and len({r["sequence_id"] >> 32 for r in got}) > 20


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the and of\nthe and of", "x", 1, 2, 3)], "doc_id long, text string, lang_pred string, row long, _drop long, dropped long")
    out = line_dedup.without_lines(df, line_dedup.repeated_lines(df)).select("row.*").collect()
    assert out[0].asDict() == {"doc_id": 1, "text": "the and of", "lang_pred": "x", "row": 1, "_drop": 2, "dropped": 3}
    assert language_id.predict(df, None, ["doc_id", "lang_pred"]).collect()[0]["lang_pred"] == "und"


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on its own input, with null, empty, letterless, long and repeated rows."""
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    r = random.Random(41)
    word = {"en": "the and of that with this from".split(), "fr": "été où ça même déjà leur".split(), "de": "über für größe daß schön nicht".split()}
    rows = []
    for i in range(90):
        k = list(word)[i % 3]
        rows.append((i, "\n".join(" ".join(r.choice(word[k]) + r.choice("abcdefgh") * r.randint(0, 4) for _ in range(r.randint(8, 30))) for _ in range(4)), k))
    for i in range(0, 40, 10):  # a passage that recurs within long lines which are not alike
        rows[i] = (i, rows[i][1].replace("\n", " ") + " " + " ".join(rows[40][1].split()[:45]) + " " + rows[i + 1][1].replace("\n", " "), rows[i][2])
    passage = " ".join("".join(r.choice("acegi") for _ in range(5)) + "the" for _ in range(60))
    rows += [(100 + j, rows[j][1] + " and", "en") for j in range(0, 9, 3)]
    rows += [(200 + j, "the of and " + rows[j][1].split("\n")[0][::-1] + " " + passage + " the end of " + str(j), "en") for j in range(6)]
    rows += [(300, None, "en"), (301, "", "fr"), (302, "123 ...", "de"), (303, "the and of that " * 3000, "en"), (0, rows[0][1], "en"), (None, "with this from that of the", "en")]
    where = corpus(spark, tmp_path, [(i, t, k, "s", None if t is None else len(t)) for i, t, k in rows])
    docs, seen = spark.read.parquet(f"{where}/documents.parquet"), []
    for name, stage in C.STAGES:
        docs = stage(spark, docs, where)
        docs.write.mode("overwrite").parquet(f"{where}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{where}/{name.replace(' ', '_')}")
        seen.append(docs)
        if name != "packing":
            assert docs.columns == C.COLUMNS
    texts_of = lambda d: [(x["doc_id"], x["text"]) for x in d.collect()]
    first, lines, near, cut, packed = map(lambda d: texts_of(d) if "text" in d.columns else d.collect(), seen)
    assert {i for i, _ in first} >= set(range(90)) | {303} and not {300, 301, 302} & {i for i, _ in first}
    # line dedup: exactly what comparing all lines leaves, but for lines that candidates miss
    ids = sorted({i for i, _ in first if i is not None})
    by = dict((i, t) for i, t in first if i is not None)
    want = dict(zip(ids, line_groups([by[i] for i in ids])))
    got = {i: t for i, t in lines if i is not None}
    assert sum(got.get(i, "") == want[i] or not any(c.isalnum() for c in want[i]) for i in ids) >= 0.9 * len(ids)
    ids = sorted(got)
    root = weighted_jaccard_groups([got[i] for i in ids])
    assert sorted(i for i, _ in near if i is not None) == [ids[i] for i, g in enumerate(root) if g == i]
    assert sum(passage in t for _, t in cut) <= 1
    # substring dedup: the words that no recurring window covers
    split = {i: phrase_dedup.WORD.findall(x) for i, x in near if i is not None}
    times = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    left = {}
    for i, w in split.items():
        gone = {k + n for k in range(len(w) - 34) if times[tuple(w[k : k + 35])] > 1 for n in range(35)}
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    assert {i: phrase_dedup.WORD.findall(x) for i, x in cut if i is not None} == {i: w for i, w in left.items() if w}
    t = Tokenizer.from_file(BPE)
    want = Counter()
    for i, text in cut:
        want[i] += len(t.encode(text, add_special_tokens=False).ids) + 1
    have, room = Counter(), Counter()
    for p in packed:
        have[p["doc_id"]] += p["length"]
        room[p["sequence_id"]] += p["length"]
    assert have == want and max(room.values()) <= 1024
    empty = corpus(spark, tmp_path / "none", [])
    assert C.run(spark, empty).count() == 0
