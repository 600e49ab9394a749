"""Whitening against numpy over all rows, and edge rows."""

import numpy as np

from tessera.llm import whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as x", "3 as w", "4 as deviation")


def test_whiten(spark):
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(vec)] + [(300, vec[0].tolist()), (300, vec[0].tolist()), (None, vec[1].tolist())]
    odd = [(400, None), (401, []), (402, [float("nan")] * 12), (403, [None] + [1.0] * 11), (404, [float("inf")] * 12), (405, [1.0] * 3)]
    got = whitening.whiten(table(spark, rows + odd)).collect()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows])
    n = len(x)
    c = x - x.mean(0)
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    dev = {}
    for (i, _), row in zip(rows, x.tolist(), strict=True):
        dev.setdefault(i, sum((n * a - s) ** 2 for a, s in zip(row, x.sum(0).tolist(), strict=True)))
    sign = {}
    for r in got:
        k = r["component"] - 1
        assert int(r["deviation"]) == dev[r["vec_id"]]
        assert abs(r["explained"] - e[k] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-9
        at = next(j for j, (i, _) in enumerate(rows) if i == r["vec_id"])
        want = c[at] @ u[:, k] / np.sqrt(e[k])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
        if abs(want) > 1e-3:
            sign.setdefault(k, set()).add(np.sign(want) == np.sign(r["whitened"]))
    assert all(len(s) == 1 for s in sign.values())


def test_few_directions(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect() == []
    flat = whitening.whiten(table(spark, [(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [8.0, 5.0])])).collect()
    assert [r["component"] for r in flat] == [1, 1, 1] and {round(r["explained"], 9) for r in flat} == {1.0}
    # of two lengths with as many vectors the longer stays; entries of any size are bounded
    both = whitening.whiten(table(spark, [(1, [1.0]), (2, [2.0]), (3, [1.0, 1e300]), (4, [2.0, -1e300])])).collect()
    assert {r["vec_id"] for r in both} == {3, 4}


def test_deviations_beyond_a_long():
    far = np.array([[1 << 40, -(1 << 41)], [3, 4]])
    assert whitening.deviations(far) == [(1 << 80) + (1 << 82), 25]
