"""Connected groups of verified links, all in DataFrames: neither links nor members ever reach the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, shuffle_partitions
from .kernels import tidy

#: Members that one hub is compared with in one task; a hub with more is dealt to several tasks.
STAR = 256
#: Links that one task handles, about, in a step of ``connected``.
LINKS = 50_000
#: Pairs for each member of the mixed buckets, up to which they are compared pair by pair rather than with further hubs.
PARTNERS = 2
#: Further hubs of one bucket in one turn.
HUBS = 4
#: Members of one block of a bucket in ``compare_blocks``.
BLOCK = 64
#: Prepared texts that a task keeps for members that come again.
REMEMBERED = 2000


def connected(edges: DataFrame) -> DataFrame:
    """id, component (its least id) of all ids in edges (a, b), by alternating large-star and small-star steps.

    Each step points nodes at their least neighbour: min() combines before the shuffle, and the join with it can be
    split where one node has most of the edges. Chains shrink by half a round; stars end in two. Nulls and
    self-links are ignored, repeated links count once."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = (now.count(),)
    while True:
        # few links need few tasks, and fewer files between them
        few = lambda df, n=max(1, -(-mark[0] // LINKS)): df.coalesce(n)
        now = few(now)
        both = now.union(now.select("v", "u"))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        root = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(root, "u")
        now = cut(few(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()))
        # two numbers tell whether anything changed
        n = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(n) == mark:
            break
        mark = tuple(n)
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """id, component once further links (a, b) join groups: only the links between groups are connected, not their members."""
    name = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"own_{c}"))
    ends = cut(links.join(name("a"), "a", "left").join(name("b"), "b", "left").select("a", "b", F.coalesce("own_a", "a").alias("x"), F.coalesce("own_b", "b").alias("y")))
    joined = connected(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("_old"), F.col("component").alias("_new"))
    every = groups.select("id", "component").union(ends.select(F.col("a").alias("id"), F.col("x").alias("component"))).union(ends.select("b", "y")).distinct()
    return every.join(joined, F.col("component") == F.col("_old"), "left").select("id", F.coalesce("_new", "component").alias("component"))


def compare_stars(stars: DataFrame, texts: DataFrame, prepare: Callable, similar: Callable) -> DataFrame:
    """Links (a, b) among the pairs of ``stars`` (hub, member, distinct) that pass similar(prepare(text), prepare(text)).

    Texts (id, text) travel to their hub; the hub's own comes first in each sorted run, so a task holds one hub and
    one batch of members at a time. A hub with many members is dealt to several tasks."""
    size = stars.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    members = stars.join(size, "hub").select("hub", F.col("member").alias("id"), F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"))
    hubs = size.select("hub", F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    routed = members.union(hubs).join(texts, "id").select("hub", "salt", "id", "text")
    ready = routed.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("id") != F.col("hub"), "id")

    def work(batches):
        at, hub = None, None
        known: dict = {}  # members come back under other hubs

        def ready_text(i, text):
            if i not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[i] = prepare(text)
            return known[i]

        for b in batches:
            a, c = [], []
            for h, s, i, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (h, s) != at:
                    at, hub = (h, s), (ready_text(i, text) if h == i else None)
                    if h == i:
                        continue
                if hub is not None and h != i and similar(hub, ready_text(i, text)):
                    a.append(h)
                    c.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return ready.mapInArrow(tidy(work), "a long, b long")


def compare_blocks(buckets: DataFrame, texts: DataFrame, extra: list[str], linked: Callable) -> DataFrame:
    """Links (a, b) among the members of each of ``buckets`` (key, id, own, ``extra``, distinct) whose groups ``own`` differ.

    Pairs never become rows: members travel with their texts to their bucket, and linked(own, block, columns of ``extra``, texts)
    names the linked pairs of members i < j, as two lists of places. Members of a bucket of more than BLOCK are dealt to blocks,
    and each two blocks meet in a task (of a fixed number: little to read can be much to compare); ``block`` tells which pairs are another task's (those of equal blocks), or is None."""
    blocks = buckets.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = buckets.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = ["key", "lo", "hi"]
    members = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "own", *extra)
    ready = members.join(texts.select("id", "text"), "id").select(*at, "block", "id", "own", "text", *extra).repartition(4 * shuffle_partitions(buckets.sparkSession), *at).sortWithinPartitions(*at, "id")

    def work(batches):
        held, last = None, None

        def links():
            id_, own, block = (held.column(c).to_numpy() for c in ("id", "own", "block"))
            i, j = linked(own, block if last[1] != last[2] else None, [held.column(c).to_numpy() for c in extra], held.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(id_[i], pa.int64()), pa.array(id_[j], pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy() for k in range(3)]
            begin = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in now], axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(begin, begin[1:], strict=False):
                key, part = tuple(x[lo] for x in now), pa.table(b.slice(lo, hi - lo))
                if key == last:
                    held = pa.concat_tables([held, part])
                    continue
                if held is not None:
                    yield links()
                held, last = part, key
        if held is not None:
            yield links()

    return ready.mapInArrow(tidy(work), "a long, b long")


def groups_from_buckets(buckets: DataFrame, texts: DataFrame | Callable, allowed: Callable, prepare: Callable, similar: Callable, extra: list[str], narrow: tuple[Callable, Callable] | None = None, pairs: DataFrame | None = None, turns: int = 20, linked: Callable | None = None) -> DataFrame:
    """id, component of all ids that a verified link joins to another.

    texts: id and text, or a function that makes them for some stars. buckets: key, id and ``extra`` columns that ``allowed(left, right)`` (a Column of two prefixes) needs; it must hold
    for every pair that is similar. First each member of a bucket is compared with the bucket's least id, found in one
    sorted pass; that settles groups of copies in linear work. While buckets still hold many pairs of different groups,
    members outside a bucket's largest group are compared with a few more of that group, which takes in most of a large
    group whose texts are not all like its least one. Then only pairs of one bucket that are still in different groups
    are compared, all of them, so no link that could join two groups is lost.

    pairs: further (hub, member) to be compared, of buckets that aren't among ``buckets``. turns: how often further hubs are
    tried before the pairs that are left; it changes the work, not the groups.

    linked: how the pairs that are left are compared within their buckets (see ``compare_blocks``), in place of one by one.

    narrow: for buckets that hold many unlike texts, which hubs don't thin out, (keys, bound): keys(ids, texts) gives
    rows (key, id, ``extra``, suffix) so that similar texts share a key at which bound(left, right) holds as well."""
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.struct("id", *extra)
    led = cut(buckets.withColumn("hub", F.first(packed).over(w)).filter("hub.id <> id"))
    ok = allowed(lambda c: F.col(f"hub.{c}"), F.col)
    # one group's buckets have many pairs of hub and member in common
    met = cut(led.select(F.col("hub"), "id", *extra).distinct())
    stars = met.filter(ok).select(F.col("hub.id").alias("hub"), F.col("id").alias("member"))
    stars = cut(stars if pairs is None else stars.union(pairs).distinct())
    text_of = texts if callable(texts) else lambda _: texts
    links = cut(compare_stars(stars, text_of(stars), prepare, similar))
    groups = cut(connected(links))
    # buckets where some member didn't join the least id's group
    name = groups.select("id", F.col("component").alias("own"))
    lead = groups.select(F.col("id").alias("lead_id"), F.col("component").alias("lead_own"))
    apart = met.select("id", F.col("hub.id").alias("lead_id")).join(name, "id", "left").join(lead, "lead_id", "left")
    open_ = apart.filter(F.coalesce("own", "id") != F.coalesce("lead_own", "lead_id")).select(F.col("id").alias("_id"), F.col("lead_id").alias("_lead"))
    mixed = led.join(open_, (F.col("id") == F.col("_id")) & (F.col("hub.id") == F.col("_lead")), "left_semi").select("key").distinct()
    shared = led.select("key", "id", *extra).union(led.select("key", "hub.*").distinct())
    rest = cut(shared.join(mixed, "key", "left_semi").join(name, "id", "left").withColumn("own", F.coalesce("own", "id")))
    tried, turn, before = stars, 0, None
    while True:
        size = rest.groupBy("key", "own").agg(F.count("*").alias("n"))
        per = size.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("square"), F.max_by("own", F.struct("n", "own")).alias("main")).filter("n * n > square")
        left, members = per.agg(F.sum((F.col("n") * F.col("n") - F.col("square")) / 2), F.sum("n")).first()
        many = (left or 0) > PARTNERS * (members or 0)
        if not many or turn >= turns or (before and left > before * 0.9):
            break
        turn, before = turn + 1, left
        # by the turn's hash, so that each turn has other hubs; min() combines before the shuffle
        drawn = F.xxhash64("id", F.lit(turn))
        main = rest.join(per.select("key", "main"), "key").filter(F.col("own") == F.col("main"))
        hubs = main.groupBy("key", "main", F.pmod(drawn, F.lit(HUBS)).alias("_k")).agg(F.min(F.struct(drawn.alias("_h"), packed.alias("hub"))).alias("_d")).select("key", "main", "_d.hub")
        pair = rest.join(hubs, "key").filter(F.col("own") != F.col("main")).filter(ok).select(F.col("hub.id").alias("hub"), F.col("id").alias("member")).distinct()
        pair = pair.withColumn("_lo", F.least("hub", "member")).withColumn("_hi", F.greatest("hub", "member"))
        fresh = cut(pair.join(tried.select(F.col("hub").alias("_lo"), F.col("member").alias("_hi")), ["_lo", "_hi"], "left_anti"))
        found = cut(compare_stars(fresh.select("hub", "member"), text_of(fresh.select("hub", "member")), prepare, similar))
        if found.isEmpty():
            break
        tried = tried.union(fresh.select(F.col("_lo").alias("hub"), F.col("_hi").alias("member")))
        groups = cut(merged(groups, found))
        name = groups.select("id", F.col("component").alias("own"))
        rest = cut(rest.drop("own").join(name, "id", "left").withColumn("own", F.coalesce("own", "id")))
    if linked:
        mixed = cut(rest.join(per.select("key"), "key", "left_semi"))
        found = cut(compare_blocks(mixed, text_of(mixed.select(F.col("id").alias("hub"), F.col("id").alias("member"))), extra, linked))
        return groups if found.isEmpty() else merged(groups, found)
    left, right = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    close = allowed(left, right)
    if many and narrow:
        keys, bound = narrow
        ids = cut(rest.select("id", "own").distinct())
        rest = cut(keys(ids.select("id"), text_of(ids.select(F.col("id").alias("hub"), F.col("id").alias("member")))).join(ids, "id"))
        close = close & bound(left, right)
    x, y = rest.alias("x"), rest.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.own") != F.col("y.own")) & (F.col("x.id") < F.col("y.id")) & close)
    more = cut(cross.select(F.col("x.id").alias("hub"), F.col("y.id").alias("member")).distinct().join(tried, ["hub", "member"], "left_anti"))
    if more.isEmpty():
        return groups
    second = compare_stars(more, text_of(more), prepare, similar)
    return merged(groups, cut(second))
