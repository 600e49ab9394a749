"""Appends by batches, and rules with keyed state, over small streams."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import archives, upkeep
from tessera.streaming.appends import BatchLog
from tessera.streaming.state import PROVIDER, Breaker, RateLimit, keyed


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_a_batch_that_comes_again(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v long")
    assert log.read("a", "v long").count() == 0
    log.write(0, a=rows(1, 2))
    log.write(1, a=rows(3))
    log._write("a", rows(9), 2)  # an attempt that broke off before its line in the log
    assert sorted(r["v"] for r in log.read("a", "v long").collect()) == [1, 2, 3]
    log.write(1, a=rows(4, 5))
    log.write(2, a=rows(6))
    assert sorted(r["v"] for r in log.read("a", "v long").collect()) == [1, 2, 4, 5, 6]
    assert sorted(r["v"] for r in log.read("a", "v long", before=2).collect()) == [1, 2, 4, 5]


def test_bytes_follow_the_input(spark, tmp_path):
    """Ten batches of like pages, one of them twice: the last writes as much as the first."""
    log = BatchLog(spark, str(tmp_path / "t"))
    write = archives.page_ingest(spark, log)
    grown = [0]
    for n in (0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9):
        text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(250)), lambda i: F.md5(F.concat_ws("-", i.cast("string"), F.col("id").cast("string"), F.lit(str(n))))))
        write(spark.range(8).select(F.col("id").alias("doc_id"), F.lit(n).alias("page"), text.alias("text")), n)
        grown.append(size(tmp_path))
    steps = [b - a for a, b in zip(grown, grown[1:])]
    assert max(steps[:5] + steps[6:]) < 1.3 * steps[0] and abs(steps[5]) < 0.3 * steps[0]
    got = log.read("chunks", archives.CHUNK_ROWS).groupBy("file_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.countDistinct("chunk_index").alias("d")).collect()
    assert len(got) == 8 and all(r["n"] == r["d"] == r["last"] + 1 for r in got)


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield
    spark.conf.set(name, before)


def told(spark, tmp_path, rule, kind, *batches):
    """What a rule tells about events (user, id, second, ok) that arrive in batches."""
    for b in batches:
        df = spark.createDataFrame([(u, i, t, ok) for u, i, t, ok in b], "user_id long, event_id long, t double, ok boolean")
        df.select("user_id", "event_id", F.timestamp_seconds("t").alias("ts"), "ok").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = keyed(stream, "user_id", rule, kind, "10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination()
    return {r["event_id"]: r[rule.value] for r in spark.read.parquet(str(tmp_path / "out")).collect()}


END = [(-1, -1, 1e6, True)]


def test_rate_limit(spark, tmp_path, state_store):
    first = [(1, 1, 100.0, True), (1, 3, 104.0, True), (1, 2, 102.0, True), (2, 4, 100.0, True)]
    # 3 comes again while it waits; 5 is out of order; 6 is more than the delay behind, once 100.0 to 190.0 have passed
    second = [(1, 3, 104.0, True), (1, 5, 103.0, True), (1, 7, 190.0, True)]
    third = [(1, 6, 101.0, True), (1, 8, 230.0, True)]
    got = told(spark, tmp_path, RateLimit(2, 60_000_000), "boolean", first, second, third, END)
    assert got == {1: True, 2: True, 5: False, 3: False, 4: True, 7: True, 8: True}


def test_breaker(spark, tmp_path, state_store):
    events = [(1, 1, 100.0, False), (1, 2, 101.0, False), (1, 3, 102.0, True), (1, 4, 170.0, False), (1, 5, 180.0, True), (1, 6, 240.0, True), (1, 7, 241.0, True)]
    got = told(spark, tmp_path, Breaker(2, 60_000_000), "string", events[:3], events[3:], END)
    assert got == {1: "closed", 2: "closed", 3: "open", 4: "half-open", 5: "open", 6: "half-open", 7: "closed"}


def test_ancestors_and_circles(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (7, 8), (8, 7), (9, 99)], "id long, parent long")
    got = {r["id"]: (r["depth"], r["chain"]) for r in upkeep.ancestors(tree, guard=5).collect()}
    assert got[4] == (4, ":1:2:3:4:") and got[1] == (1, ":1:") and got[9] == (1, ":9:") and got[7] == (5, ":7:8:7:8:7:")


def test_sketches_add_up(spark):
    rows = spark.range(5000).select((F.col("id") % 24).alias("hour"), (F.pow(F.lit(1.002), F.col("id")) - 1).alias("v"))
    parts = upkeep.sketch(rows, ["hour"], "v")
    got = upkeep.quantiles(parts.withColumn("all", F.lit(1)).select("all", "bucket", "n"), ["all"]).first()
    exact = sorted(r["v"] for r in rows.collect())
    for p, q in zip(("p50", "p95", "p99"), upkeep.QUANTILES):
        assert abs(got[p] - exact[-(-int(5000 * q) // 1) - 1]) <= 0.011 * got[p]
    assert got["count"] == 5000
