"""Ancestors by doubling, quantile sketches that add up, and snapshots with a manifest."""

from __future__ import annotations

import math
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..session import cut, shared_dir, table

#: The longest chain of ancestors.
GUARD = 50


def ancestors(tree: DataFrame, guard: int = GUARD) -> DataFrame:
    """SC21: id, depth, chain (``:root: ... :id:``) of each row (id, parent) of a tree. Each round appends to a row's chain that of
    the row it ends at, so that chains double; rows in a circle, and longer chains, end after ``guard`` folders."""
    up = tree.select("id", "parent", F.array(F.col("id").cast("string")).alias("path"))
    known = tree.select(F.col("id").alias("known"))
    at = cut(up.join(known, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("next"), "path"))
    for _ in range(math.ceil(math.log2(guard))):
        if at.filter("next is not null").isEmpty():
            break
        far = at.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("path").alias("_path"))
        step = at.join(far, F.col("next") == F.col("_id"), "left")
        at = cut(step.select("id", F.when(F.col("next").isNotNull(), F.col("_next")).alias("next"), F.concat(F.coalesce("_path", F.array().cast("array<string>")), "path").alias("path")))
    last = F.slice("path", F.greatest(F.size("path") - guard + 1, F.lit(1)), F.lit(guard))
    return at.select("id", F.size(last).cast("long").alias("depth"), F.concat(F.lit(":"), F.array_join(last, ":"), F.lit(":")).alias("chain"))


@query("sc21_ancestors", f"WITH RECURSIVE tree(id, parent) AS (SELECT p_partkey, p_partkey // 3 FROM part), walk(id, up, depth, path) AS (SELECT id, parent, 1, ':' || id || ':' FROM tree UNION ALL SELECT walk.id, tree.parent, depth + 1, ':' || tree.id || path FROM walk JOIN tree ON tree.id = walk.up WHERE depth < {GUARD}) SELECT id, CAST(max(depth) AS BIGINT) AS depth, arg_max(path, depth) AS chain FROM walk GROUP BY id")
def sc21(spark, d):
    """SC21: the chain of ancestors of each folder of a tree."""
    return ancestors(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("parent")))


#: The relative error of a sketch's quantiles, and its base: a bucket b holds values in (base^(b-1), base^b].
ERROR = 0.01
BASE = (1 + ERROR) / (1 - ERROR)
QUANTILES = (0.5, 0.95, 0.99)


def sketch(rows: DataFrame, by: list, value: str) -> DataFrame:
    """AG12: ``by``, bucket, n: how many values lie in each bucket; values of zero or less are bucket null. Sketches of parts add
    up to that of the whole; a group has some 115 buckets for each factor of ten between its values."""
    bucket = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value)) / math.log(BASE)).cast("int"))
    return rows.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by``, count, and an estimate of each of QUANTILES within ERROR of the value of that rank."""
    whole = sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    upto = whole.withColumns({"upto": F.sum("n").over(w.orderBy(F.asc_nulls_first("bucket"))), "count": F.sum("n").over(w)})
    middle = F.coalesce(2 * F.pow(F.lit(BASE), F.col("bucket")) / (BASE + 1), F.lit(0.0))
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.col("count") * q), middle)).alias(f"p{round(q * 100)}") for q in QUANTILES]
    return upto.groupBy(*by).agg(F.first("count").alias("count"), *at)


def _quantile_sql(of: str, q: float) -> str:
    return f"min(CASE WHEN upto >= ceil(count * {q}::DOUBLE) THEN {of} END)"


_P = [f"p{round(q * 100)}" for q in QUANTILES]
_EXACT = ", ".join(f"abs({p} - list_sort(l)[CAST(ceil(len(l) * {q}::DOUBLE) AS BIGINT)]) <= {ERROR * 1.0001} * list_sort(l)[CAST(ceil(len(l) * {q}::DOUBLE) AS BIGINT)] AS {p}_close" for p, q in zip(_P, QUANTILES, strict=True))


@query("ag12_quantiles", f"""WITH hour AS (SELECT event_type, date_trunc('hour', ts) AS h, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / {math.log(BASE)!r}::DOUBLE) AS INTEGER) END AS bucket, count(*) AS n FROM events GROUP BY ALL),
day AS (SELECT event_type, date_trunc('day', h) AS day, bucket, sum(n) AS n FROM hour GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY event_type, day ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY event_type, day) AS count FROM day),
q AS (SELECT event_type, day, CAST(max(count) AS BIGINT) AS count, {', '.join(f"{_quantile_sql(f'coalesce(2 * pow({BASE!r}::DOUBLE, bucket) / {BASE + 1!r}::DOUBLE, 0)', q)} AS {p}" for p, q in zip(_P, QUANTILES, strict=True))} FROM u GROUP BY event_type, day),
e AS (SELECT event_type, date_trunc('day', ts) AS day, list(value) AS l FROM events GROUP BY ALL)
SELECT event_type, day, count, {', '.join(f'round({p}, 4) AS {p}' for p in _P)}, {_EXACT} FROM q JOIN e USING (event_type, day)""")
def ag12_quantiles(spark, d):
    """AG12: medians and tails of a day from the sketches of its hours, and whether they are within the stated error of the
    exact values."""
    events = table(spark, d, "events").select("event_type", "ts", "value")
    hours = sketch(events, ["event_type", F.date_trunc("hour", "ts").alias("hour")], "value")
    day = F.date_trunc("day", "hour")
    got = quantiles(hours.withColumn("day", day).select("event_type", "day", "bucket", "n"), ["event_type", "day"])
    w = Window.partitionBy("event_type", "day").orderBy("value")
    exact = events.withColumn("day", F.date_trunc("day", "ts")).withColumns({"rank": F.row_number().over(w), "total": F.count("*").over(Window.partitionBy("event_type", "day"))})
    exact = exact.groupBy("event_type", "day").agg(*[F.min(F.when(F.col("rank") >= F.ceil(F.col("total") * q), F.col("value"))).alias(f"x{p}") for p, q in zip(_P, QUANTILES, strict=True)])
    close = [(F.abs(F.col(p) - F.col(f"x{p}")) <= ERROR * 1.0001 * F.col(f"x{p}")).alias(f"{p}_close") for p in _P]
    return got.join(exact, ["event_type", "day"]).select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "count", *[F.round(p, 4).alias(p) for p in _P], *close)


#: Upper bounds of a latency histogram, and what stands for more than the last (fixed values).
BOUNDS, BEYOND = (50, 100, 200, 500, 1000, 2000, 5000, 10000), 99999


@query("ag12_bucket_quantiles", f"WITH h AS (SELECT event_type, CASE {' '.join(f'WHEN value * 20 <= {b} THEN {b}' for b in BOUNDS)} ELSE {BEYOND} END AS bound, count(*) AS n, sum(value * 20) AS s FROM events GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bound) AS upto, sum(n) OVER (PARTITION BY event_type) AS count FROM h) SELECT event_type, CAST(max(count) AS BIGINT) AS count, round(sum(s) / max(count), 1) AS average, {', '.join(f'CAST(min(CASE WHEN upto >= count * {q}::DOUBLE THEN bound END) AS BIGINT) AS {p}' for p, q in zip(_P, QUANTILES, strict=True))} FROM u GROUP BY event_type")
def ag12_buckets(spark, d):
    """AG12: average and the buckets of the median and the tails, milliseconds being twenty times the value."""
    ms = F.col("value") * 20
    bound = F
    for b in BOUNDS:
        bound = bound.when(ms <= b, b)
    h = table(spark, d, "events").groupBy("event_type", bound.otherwise(BEYOND).alias("bound")).agg(F.count("*").alias("n"), F.sum(ms).alias("s"))
    w = Window.partitionBy("event_type")
    u = h.withColumns({"upto": F.sum("n").over(w.orderBy("bound")), "count": F.sum("n").over(w)})
    at = [F.min(F.when(F.col("upto") >= F.col("count") * q, F.col("bound"))).cast("long").alias(p) for p, q in zip(_P, QUANTILES, strict=True)]
    return u.groupBy("event_type").agg(F.max("count").alias("count"), F.round(F.sum("s") / F.max("count"), 1).alias("average"), *at)


class Snapshots:
    """SK13: numbered copies of a table, each with a manifest: rows and an order-free digest of each partition."""

    def __init__(self, spark: SparkSession, keys: list[str], partition: str):
        self.spark, self.keys, self.partition = spark, keys, partition
        self.root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/snapshots-{uuid.uuid4().hex}"
        self.numbers: list[int] = []

    def digest(self, rows: DataFrame) -> DataFrame:
        """Partition, rows, digest: the sum of the rows' own digests, so that neither order nor files matter. A sum beyond 64 bits
        goes on from the least number."""
        row = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys])), 1, 12), 16, 10).cast("decimal(20,0)")
        around = F.lit(Decimal(1 << 64))
        left = F.col("digest") % around
        digest = F.when(left >= Decimal(1 << 63), left - around).otherwise(left).cast("long")
        return rows.groupBy(self.partition).agg(F.count("*").alias("rows"), F.sum(row).alias("digest")).withColumn("digest", digest)

    def take(self, number: int, rows: DataFrame) -> None:
        rows.select(*dict.fromkeys([*self.keys, self.partition])).write.partitionBy(self.partition).parquet(f"{self.root}/{number}/rows")
        self.digest(rows).write.parquet(f"{self.root}/{number}/manifest")
        self.numbers.append(number)

    def verified(self, number: int) -> DataFrame:
        """Each partition of the manifest with ``whole``: whether it is there as it was."""
        due = self.spark.read.parquet(f"{self.root}/{number}/manifest")
        there = self.digest(self.spark.read.parquet(f"{self.root}/{number}/rows")).withColumnsRenamed({"rows": "_rows", "digest": "_digest"})
        whole = F.coalesce((F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest")), F.lit(False))
        return due.join(there, self.partition, "left").select(F.lit(number).cast("long").alias("snapshot"), self.partition, "rows", "digest", whole.alias("whole"))

    def retained(self, most: int = 7) -> DataFrame:
        """Every partition of every snapshot, and whether the snapshot is kept: the last ``most`` that are whole. A damaged one
        takes no place, so that no older whole one goes for it."""
        every = None
        for n in self.numbers:
            every = self.verified(n) if every is None else every.union(self.verified(n))
        every = cut(every)
        state = every.groupBy("snapshot").agg(F.min("whole").alias("complete"))
        last = state.filter("complete").orderBy(F.desc("snapshot")).limit(most).select("snapshot", F.lit(True).alias("kept"))
        return every.join(last, "snapshot", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


_ROW = "CAST('0x' || md5(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type))[1:12] AS BIGINT)"
#: Snapshots taken, and the one that loses rows.
TAKEN, DAMAGED = 9, 4


@query("sk13_snapshots", f"WITH s AS (SELECT unnest(range(0, {TAKEN})) AS snapshot), e AS (SELECT snapshot, event_type, event_id, {_ROW} AS h FROM s, events WHERE event_id % {TAKEN} <= snapshot), m AS (SELECT snapshot, event_type, count(*) AS rows, CAST(sum(h) AS BIGINT) AS digest FROM e GROUP BY ALL) SELECT snapshot, event_type, rows, digest, NOT (snapshot = {DAMAGED} AND event_type = 'error') AS whole, snapshot > 0 AND snapshot <> {DAMAGED} AS kept FROM m")
def sk13_snapshots(spark, d):
    """SK13: nine growing copies of the events, of which one has lost a partition: the manifest tells it, and seven whole ones stay."""
    s = Snapshots(spark, ["event_id", "user_id", "event_type"], "event_type")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    for n in range(TAKEN):
        s.take(n, events.filter(F.col("event_id") % TAKEN <= n))
    half = events.filter((F.col("event_type") == "error") & (F.col("event_id") % TAKEN < DAMAGED - 1))
    half.write.partitionBy("event_type").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{s.root}/{DAMAGED}/rows")
    return s.retained()
