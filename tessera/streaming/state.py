"""Rules with a state for each key, as stateful processors over event time.

Events wait in their key's state until the watermark has passed them, and are then taken in the order of their time and
id, so that the order of arrival doesn't matter within the watermark's delay. Defined results: an event that comes later
than that is dropped; one that comes again while it waits counts once, and one that comes again afterwards is late. What a
key holds is bounded by the rule (the calls within the span, or two numbers) and by the events of the delay; a timer
clears a key whose calls have all left the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Events (event_id, at: microseconds, ok) of a key in their order, each given to ``step`` with the rule's state."""

    state_schema = ""
    value = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "event_id long", "at long, ok boolean")
        self.held = handle.getValueState("held", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for b in rows:
            for event, at, ok in zip(b["event_id"].tolist(), b["at"].tolist(), b["ok"].tolist(), strict=True):
                if at > passed:
                    self.pending.updateValue((event,), (at, ok))
                    first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((v[0], k[0], v[1]) for k, v in self.pending.iterator())
        due = [e for e in waiting if e[0] <= upto]
        state = tuple(self.held.get()) if self.held.exists() else self.start()
        out = []
        for at, event, ok in due:
            told, state = self.step(state, at, ok)
            out.append((event, told))
            self.pending.removeKey((event,))
        if len(due) < len(waiting):
            self.handle.registerTimer(-(-waiting[len(due)][0] // 1000))
        until = self.until(state)
        if until is not None and until <= upto and len(due) == len(waiting):
            self.held.clear()
        elif due:
            self.held.update(state)
            if until is not None:
                self.handle.registerTimer(max(-(-until // 1000), upto // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["event_id", self.value])

    def close(self) -> None:
        pass


class RateLimit(Ordered):
    """ST02: at most ``most`` calls within ``span`` microseconds; those denied are not recorded."""

    state_schema, value = "calls array<long>", "allowed"

    def __init__(self, most: int, span: int):
        self.most, self.span = most, span

    def start(self) -> tuple:
        return ([],)

    def step(self, state: tuple, at: int, ok: bool):
        calls = [c for c in state[0] if c > at - self.span]
        allowed = len(calls) < self.most
        return allowed, ([*calls, at] if allowed else calls,)

    def until(self, state: tuple):
        return state[0][-1] + self.span if state[0] else None


class Breaker(Ordered):
    """ST03: opened by ``most`` failures one after another; after ``rest`` microseconds one call is let through, which closes
    or opens it again. Tells the state before each call."""

    state_schema, value = "fails int, opened long", "state"

    def __init__(self, most: int, rest: int):
        self.most, self.rest = most, rest

    def start(self) -> tuple:
        return (0, -1)

    def step(self, state: tuple, at: int, ok: bool):
        fails, opened = state
        now = "closed" if opened < 0 else "half-open" if at - opened >= self.rest else "open"
        if now == "open":
            return now, (fails, opened)
        if ok:
            return now, (0, -1)
        return now, (fails + 1, at if now == "half-open" or fails + 1 >= self.most else opened)

    def until(self, state: tuple):
        return None


def keyed(events: DataFrame, key: str, rule: Ordered, kind: str, late: str) -> DataFrame:
    """event_id and what ``rule`` tells (of type ``kind``) for a stream of events (``key``, event_id, ts, ok)."""
    at = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return at.groupBy(key).transformWithStateInPandas(rule, f"event_id long, {rule.value} {kind}", "Append", "EventTime")
