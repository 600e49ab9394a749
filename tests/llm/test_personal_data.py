"""Personal data: base rules against ``re``, estimates against a plain loop, looser spans that were planted."""

import math
import random
import re

from pyspark.sql import functions as F

from tessera.llm import personal_data as pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(number) <= 19 and luhn(number)):
                continue
            if kind == "phone" and not 8 <= len(number) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PARTS = ["a@b.c", "a@b.c_d@e.f", "@", "x.y%z@host-1.example.com", "1.2.3.4", "001.255.0.256", "1.2.3.4.5.6.7.8", "4111111111111111", "4111-1111 1111 1111", "7536784127813050 4845168114407329", "+1 (930) 555-2361", "+12", "+1 2 3 4 5 6 7.", "the", "é🙂", "mail: ", " at ", " dot ", "12", " ", ".", "jo (at) host (dot) com", "2001:db8::1", "12:30:45"]


def test_base_rules(spark):
    r = random.Random(4)
    rows = ["".join(r.choice("0123456789. -+()@a_🙂é:") for _ in range(r.randint(0, 120))) for _ in range(400)]
    rows += ["".join(r.choice(PARTS) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 14))) for _ in range(400)]
    rows += ["", None, "0" * 1000, "1 " * 5000, "a" * 100_000 + "@", "a." * 50_000, "x@" + "a." * 50_000 + "b", "4111111111111111," * 1500]
    docs = spark.createDataFrame([*enumerate(rows), (3, rows[3]), (None, rows[5])], "doc_id long, text string").selectExpr("*", "1 as spans", "'x' as id", "2 as kind")
    out = pii.find_personal_data(docs).select("doc_id", "spans", pii.written(F.filter("spans", lambda s: s["base"])).alias("base")).collect()
    assert len(out) == len(rows) + 2
    for row in out:
        text = rows[5 if row["doc_id"] is None else row["doc_id"]] or ""
        assert row["base"] == base(text)
        spans = sorted((s["start"], s["end"], s["base"]) for s in row["spans"])
        own = [s for s in spans if not s[2]]
        for s in own:  # added spans overlap nothing
            assert all(s is x or x[1] <= s[0] or x[0] >= s[1] for x in spans if len(spans) < 300)
    assert pii.find_personal_data(docs.limit(0)).collect() == []


def test_running_sums(spark):
    for n in (0, 1, 256, 257, 1000):
        values = F.filter(F.sequence(F.lit(0), F.lit(n)), lambda v: v > 0)
        got = spark.range(1).select(pii.running(values, lambda a, b: a + b, F.lit(0)).alias("r")).first()["r"]
        assert got == [i * (i + 1) // 2 for i in range(n)]


def planted(seed):
    """Texts with personal data written in other ways, and with numbers that are none."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(n, first):
        body = first + num(n - 1 - len(first))
        return next(body + d for d in "0123456789" if luhn(body + d))

    rows = []
    for _ in range(60):
        a, b = card(16, "4"), card(16, "51")
        rows += [
            (f"paid with card {a} {b} today", [a, b]),
            (f"my card is {a[:4]}.{a[4:8]}.{a[8:12]}.{a[12:]} thanks", [f"{a[:4]}.{a[4:8]}.{a[8:12]}.{a[12:]}"]),
            (f"write to jo{num(2)} (at) example (dot) com please", None),
            (f"the host is 2001:db8:{num(2)}::{num(1)} here", None),
            (f"call us, tel (2{num(2)}) 555-{num(4)} or later", None),
            (f"mail jo{num(2)}@mail.example.com or call +1 (2{num(2)}) 555-{num(4)}, host 10{num(1)}.20.30.40, card {a}", []),
            (f"version 12:{r.randint(10, 59)}:{r.randint(10, 59)} of 2024-05-{r.randint(10, 28)}, order 9{num(15)}x, page 12", []),
            (f"token = \"{num(5)}b{num(14)}c{num(9)}\" and serial 17-{num(3)}-{num(2)}", []),
        ]
    return rows


def test_added_spans(spark):
    rows = planted(5)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: [rows[r["doc_id"]][0][s["start"] : s["end"]] for s in r["spans"] if not s["base"]] for r in pii.find_personal_data(docs).collect()}
    hits = wrong = due = 0
    for i, (_, want) in enumerate(rows):
        if want is None:
            due, hits = due + 1, hits + (len(got[i]) == 1)
        else:
            due, hits, wrong = due + len(want), hits + len(set(want) & set(got[i])), wrong + len(set(got[i]) - set(want))
    assert hits >= 0.9 * due and wrong <= 0.01 * due, (hits, due, wrong)


def test_estimates(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted(6))], "doc_id long, text string")
    seen = pii.patterns(pii.candidates(docs, "doc_id", "text"))
    odds, ratio = pii.reliabilities(seen, rounds=7)
    rows = [(r["kind"], r["votes"], r["n"]) for r in seen.collect()]
    width = len(pii.LABELERS)
    o, t = [0.0] * 4, {(k, j, v): float(v) for k in range(4) for j in range(width) for v in (-1, 0, 1)}
    for _ in range(7):
        true = {key: pii.PRIOR[0][key[2] + 1] for key in t}
        false = {key: pii.PRIOR[1][key[2] + 1] for key in t}
        count = [[1.0, 1.0] for _ in range(4)]
        for k, votes, n in rows:
            p = 1 / (1 + math.exp(-(o[k] + sum(t[k, j, v] for j, v in enumerate(votes)))))
            count[k][0] += n * p
            count[k][1] += n * (1 - p)
            for j, v in enumerate(votes):
                true[k, j, v] += n * p
                false[k, j, v] += n * (1 - p)
        o = [math.log(a / b) for a, b in count]
        share = lambda side, k, j, v: side[k, j, v] / sum(side[k, j, x] for x in (-1, 0, 1))
        t = {(k, j, v): math.log(share(true, k, j, v) / share(false, k, j, v)) for k, j, v in t}
    assert all(abs(a - b) < 1e-6 for a, b in zip(odds, o, strict=True))
    assert all(abs(a - t[k, j, v]) < 1e-6 for a, (k, j, v) in zip(ratio, [(k, j, v) for k in range(4) for j in range(width) for v in (-1, 0, 1)], strict=True))
