"""Decoding, rejection and packing against plain Python."""

from pyspark.sql import functions as F

from tessera.operators.ranking import packs
from tessera.sources.files import read_texts


def test_read_texts(spark, tmp_path):
    for name, data in {"a": "é ok".encode(), "b": "后面".encode("gb18030"), "c": b"", "d": b"\0" * 90 + b"x"}.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r["path"][-5]: (r["text"], r["rejected"]) for r in read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a": ("é ok", False), "b": ("后面", False), "d": (None, True)}


def test_packs(spark):
    rows = [None, "", "\n \n", "x" * 900, "a" * 399 + "\nb\nc", "\n".join("w" * n for n in (100, 200, 150, 400, 1, 399, 2))]

    def count(text):
        n = run = 0
        for p in (text or "").split("\n"):
            if p.strip():
                if run and run + len(p) > 400:
                    n, run = n + 1, 0
                run += len(p)
        return n + (run > 0)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string")
    got = {r["i"]: r["n"] for r in df.select("i", packs(F.col("t")).alias("n")).collect()}
    assert got == {i: count(t) for i, t in enumerate(rows)}
