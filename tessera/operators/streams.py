"""Windows over time, stateful rules, and the task machine; batch forms of what ``streaming`` runs continuously."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..session import table


@query("st01_sliding_counter", "SELECT w AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts) - INTERVAL 2 HOUR, date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)]) AS w FROM events) GROUP BY w")
def st01(spark, d):
    """ST01: sliding windows (three hours by one)."""
    w = F.window("ts", "3 hours", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("st13_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st13(spark, d):
    """ST13: tumbling windows."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("st13_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def st13_sessions(spark, d):
    """ST13: session windows with a gap of twelve hours."""
    s = F.session_window("ts", "12 hours")
    return table(spark, d, "events").groupBy("user_id", s.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def allow_calls(times: list[float], most: int = 5, span: float = 60.0) -> list[bool]:
    """ST02: a sliding log; denied calls are not recorded."""
    kept: list[float] = []
    out = []
    for t in times:
        kept = [k for k in kept if k > t - span]
        ok = len(kept) < most
        if ok:
            kept.append(t)
        out.append(ok)
    return out


@query("st02_rate_limit", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w(user_id, n, event_id, allowed, kept) AS (
 SELECT user_id, n, event_id, true, [t] FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, event_id, len(live) < 5, CASE WHEN len(live) < 5 THEN list_append(live, t) ELSE live END
 FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(w.kept, lambda k: k > e.t - 129600) AS live FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT event_id, allowed FROM w""")
def st02(spark, d):
    """ST02: 5 calls a user in 36 hours, by a state that a frame can't express."""

    def limit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        ok = allow_calls((pdf["ts"].astype("int64") / 1e9).tolist() if str(pdf["ts"].dtype).startswith("datetime64[ns") else [t.timestamp() for t in pdf["ts"]], 5, 36 * 3600)
        return pd.DataFrame({"event_id": pdf["event_id"], "allowed": ok})

    return table(spark, d, "events").select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(limit, "event_id long, allowed boolean")


def breaker(events: list[tuple[float, bool]], most: int = 5, rest: float = 60.0) -> list[str]:
    """ST03: state before each call: closed, open or half-open; (time, success) events in order."""
    fails, opened, out = 0, None, []
    for t, ok in events:
        state = "closed" if opened is None else "half-open" if t - opened >= rest else "open"
        out.append(state)
        if state == "open":
            continue
        if ok:
            fails, opened = 0, None
        else:
            fails += 1
            if state == "half-open" or fails >= most:
                opened = t
    return out


@query("st03_circuit_breaker", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w(user_id, n, event_id, state, fails, opened) AS (
 SELECT user_id, n, event_id, 'closed', CASE WHEN ok THEN 0 ELSE 1 END, CAST(NULL AS DOUBLE) FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, event_id, state, CASE WHEN state = 'open' THEN fails WHEN ok THEN 0 ELSE fails + 1 END, CASE WHEN state = 'open' THEN opened WHEN ok THEN NULL WHEN state = 'half-open' OR fails + 1 >= 2 THEN t ELSE opened END
 FROM (SELECT e.user_id, e.n, e.event_id, e.ok, e.t, w.fails, w.opened, CASE WHEN w.opened IS NULL THEN 'closed' WHEN e.t - w.opened >= 86400 THEN 'half-open' ELSE 'open' END AS state FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT event_id, state FROM w""")
def st03(spark, d):
    """ST03: a breaker for each user over events, errors being failures."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        return pd.DataFrame({"event_id": pdf["event_id"], "state": breaker([(t.timestamp(), k != "error") for t, k in zip(pdf["ts"], pdf["event_type"])], 2, 86400.0)})

    return table(spark, d, "events").select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandas(run, "event_id long, state string")


@query("st04_retries", "SELECT event_id, CAST(event_id % 5 AS BIGINT) AS retries, CASE WHEN event_type = 'error' AND event_id % 5 < 3 THEN 'retrying' WHEN event_type = 'error' THEN 'dead' ELSE 'done' END AS state, CASE WHEN event_type = 'error' AND event_id % 5 < 3 THEN CAST(5 * pow(2, event_id % 5) AS BIGINT) END AS wait_s FROM events")
def st04(spark, d):
    """ST04: backoff of 5 x 2^n seconds, three retries, then dead."""
    n, bad = F.col("event_id") % 5, F.col("event_type") == "error"
    state = F.when(bad & (n < 3), "retrying").when(bad, "dead").otherwise("done")
    return table(spark, d, "events").select("event_id", n.alias("retries"), state.alias("state"), F.when(bad & (n < 3), (F.pow(F.lit(2.0), n) * 5).cast("long")).alias("wait_s"))


@query("st09_no_progress", "WITH g AS (SELECT user_id, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, event_id FROM g WHERE gap > INTERVAL 24 HOUR")
def st09(spark, d):
    """ST09: gaps beyond the timeout."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    return table(spark, d, "events").select("user_id", "event_id", gap.alias("gap")).filter(F.col("gap") > 86400 * 1_000_000).select("user_id", "event_id")
