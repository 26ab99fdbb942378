"""Stateful operators on streams of keyed events, with state in the state store.

Input rows are (key BIGINT, seq BIGINT, ts TIMESTAMP, value STRING, number DOUBLE). Each operator is one processor of
`transformWithState`: it sorts a key's rows of a micro-batch by (ts, seq), steps its state and emits rows; state is
bounded per key and expires. What a task holds at once is a key's rows of one micro-batch, so the source's limit for a
micro-batch bounds it. Rows that come with a time before the newest one seen are late: they are emitted as `late`
where an operator says so and are otherwise left out. Given the rows in order, every operator gives the result of its
batch twin in operators.sequence. Silences are told by timers of the event time, values expire by processing time.
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# processors also go to a Python process of the driver that gets no files sent, so they carry their code with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "key bigint, seq bigint, ts timestamp, value string, number double"
OUTPUT = "key bigint, seq bigint, kind string, at double"
_STATE = "last double, since double, n bigint, value string, newest double"


class Keyed(StatefulProcessor):
    """One state row a key: last, since, n, value and the newest time seen."""

    ttl_ms: int | None = None
    #: Clock of timers and of expiry.
    time_mode = "None"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        state = list(self.state.get()) if self.state.exists() else [None, None, 0, None, None]
        out = []
        for seq, ts, value, number in zip(own["seq"], own["ts"], own["value"], own["number"], strict=True):
            s = ts.timestamp()
            if state[4] is not None and s < state[4]:
                out += [(key[0], seq, "late", s)] if self.reports_late else []
                continue
            out += [(key[0], seq, kind, float(at)) for kind, at in self.step(state, s, value, number)]
            state[4] = s
        self.state.update(tuple(state))
        self.after(state)
        yield pd.DataFrame(out, columns=["key", "seq", "kind", "at"])

    reports_late = False

    def after(self, state: list) -> None:
        """Called when a key's rows of a micro-batch have been stepped through."""

    def step(self, state: list, s: float, value, number) -> list[tuple[str, float]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Changes(Keyed):
    """Emits a row when the value differs from the one before; the first value of a key counts."""

    def step(self, state, s, value, number):
        same = state[2] and state[3] == value
        state[2], state[3] = 1, value
        return [] if same else [("changed", s)]


class Throttle(Keyed):
    """Leading edge: a row passes when so many seconds went by since the last that did."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def step(self, state, s, value, number):
        if state[0] is not None and s - state[0] < self.seconds:
            return []
        state[0] = s
        return [("passed", s)]


class RateLimit(Keyed):
    """A window starts with the first hit after the last window; a row beyond the limit is refused."""

    def __init__(self, seconds: float, most: int):
        self.seconds, self.most = seconds, most

    def step(self, state, s, value, number):
        if state[1] is None or s - state[1] >= self.seconds:
            state[1], state[2] = s, 0
        state[2] += 1
        return [("allowed" if state[2] <= self.most else "refused", s)]


class Stale(Keyed):
    """Tells silences: `stale` when so many seconds have gone by since the newest row, whether or not another row ever
    comes, and `resumed` at the silence's end, once each. A timer of the event time tells a silence that lasts; the
    stream needs a watermark."""

    reports_late, time_mode = True, "EventTime"

    def __init__(self, seconds: float):
        self.seconds = seconds

    def step(self, state, s, value, number):
        out = [] if state[4] is not None else [("first", s)]
        if state[4] is not None and s - state[4] > self.seconds:
            out = [("resumed", s)] if state[2] else [("stale", state[4] + self.seconds), ("resumed", s)]
        state[2] = 0
        return out

    def after(self, state):
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if state[4] is not None:
            self.handle.registerTimer(int((state[4] + self.seconds) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.state.get())
        out = [] if state[2] or state[4] is None else [(key[0], None, "stale", state[4] + self.seconds)]
        state[2] = 1  # this silence has been told
        self.state.update(tuple(state))
        yield pd.DataFrame(out, columns=["key", "seq", "kind", "at"])


class Concurrent(Keyed):
    """Counts opened less closed; an opening beyond the limit is refused, the count never falls below zero."""

    def __init__(self, opened: str, closed: str, most: int):
        self.opened, self.closed, self.most = opened, closed, most

    def step(self, state, s, value, number):
        if value == self.opened:
            if state[2] >= self.most:
                return [("refused", s)]
            state[2] += 1
            return [("opened", s)]
        if value == self.closed and state[2]:
            state[2] -= 1
            return [("closed", s)]
        return []


class Follow(Keyed):
    """Follows a plan of a key's own: a row `plan:a,b,c` sets it and starts anew. A value among the next `ahead` ones of
    the plan is progress, the last one is arrival, any other value after the first progress is a veer, told once until
    there is progress again; without a plan nothing is told."""

    PLAN = "plan:"

    def __init__(self, ahead: int = 2):
        self.ahead = ahead

    def step(self, state, s, value, number):
        if value is not None and value.startswith(self.PLAN):
            state[2], state[3], state[1] = 0, value, None
            return [("planned", s)]
        plan = state[3].removeprefix(self.PLAN).split(",") if state[3] else []
        if state[2] >= len(plan):
            return []
        window = plan[state[2] : state[2] + self.ahead]
        if value in window:
            state[2] += window.index(value) + 1
            state[1] = None
            return [("arrived" if state[2] == len(plan) else "progress", s)]
        if state[2] and state[1] is None:
            state[1] = s
            return [("veered", s)]
        return []


class Smooth(Keyed):
    """Exponential moving average of the numbers, as `at`."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def step(self, state, s, value, number):
        state[0] = number if state[0] is None else self.alpha * number + (1 - self.alpha) * state[0]
        return [("mean", state[0])]


class Expiring(Keyed):
    """A store with a time to live: the latest value of a key, dropped by the store so many seconds of processing time
    after it was set; `set` tells a key that was new or had expired, `updated` one that was there."""

    time_mode = "ProcessingTime"

    def __init__(self, seconds: int):
        self.ttl_ms = seconds * 1000

    def step(self, state, s, value, number):
        known = state[2] > 0
        state[2], state[3] = 1, value
        return [("updated" if known else "set", s)]


def apply(events: DataFrame, processor: Keyed, late: str = "0 seconds") -> DataFrame:
    """The operator over a stream (or a batch) of events; late: how long a watermark waits, where one is needed."""
    if processor.time_mode == "EventTime" and events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("key").transformWithStateInPandas(processor, outputStructType=OUTPUT, outputMode="Append", timeMode=processor.time_mode)


def as_events(df: DataFrame, key: str, seq: str, ts: str, value: str, number: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("string").alias("value"), F.col(number).cast("double").alias("number"))


@contextlib.contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams that are started here use the state store that keyed operators need; the session keeps its own."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
