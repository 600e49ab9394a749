"""Fill-in-middle samples against a list of units, and round trips."""

import hashlib
import random
import re

from tessera.llm import infilling

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_checkpoints(monkeypatch):
    r = random.Random(1)
    for step in (7, 50, 1 << 20):
        monkeypatch.setattr("tessera.llm.kernels.STEP", step)
        for _ in range(400):
            text = "".join(r.choice("ab é日🙂 \n\t\x0b\x1c\x00") for _ in range(r.randint(0, 200)))
            units = UNIT.findall(text)
            for stride in (1, 3, 64):
                index = infilling.Checkpoints(text.encode(), stride)
                assert (index.n, index.points) == (len(units), len(text))
                assert len(index.units) == len(units) // stride + 1
                for u in {0, len(units), r.randint(0, len(units))}:
                    before = "".join(units[:u])
                    assert index.cut(u) == (len(before.encode()), len(before))


def sample(i, text):
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    a, b = sorted(h % (len(units) + 1) for h in (h1, h2))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_samples(spark):
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcé🙂<PSM>") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 300))) for _ in range(150)]
    texts += [None, "", " ", "\n\n\n", "a", "x" * 100_000, "<P> marked", "a <S", " lead and trail \t", "w " * 60_000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "2 as _text", "3 as output")
    out = infilling.fill_in_middle(docs, ["doc_id", "form"])
    assert out.columns == ["doc_id", "form", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = infilling.fill_in_middle(docs, ["doc_id"])
    got = sorted(out.select("*", infilling.restored("output", "form").alias("back")).collect(), key=str)
    want = sorted(((i, *sample(i, t or ""), t or "") for i, t in rows), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(docs.limit(0), ["doc_id"]).collect() == []
