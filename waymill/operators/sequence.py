"""Ordered operations within keys: previous rows, runs, as-of lookups, and folds over sorted rows.

Window functions sort a key's rows and spill; folds stream a key's sorted rows through constant state. Ties in time go
by the event's id. Keys may be null and form one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def over(key: list[str], order: list[str]):
    return W.partitionBy(*key).orderBy(*order)


def changes(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before (the first row of a key counts)."""
    w = over(key, order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_c", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).filter("_c").drop("_c")


def runs(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows with `run`, the number of the run of equal values they stand in, from 1."""
    w = over(key, order)
    cut = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("_cut", cut.cast("int")).withColumn("run", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_cut")


def debounce(df: DataFrame, key: list[str], ts: str, tie: str, seconds: float) -> DataFrame:
    """Rows after which nothing came for so long; the last row of a key counts."""
    nxt = F.lead(ts).over(over(key, [ts, tie]))
    return df.withColumn("_n", nxt).filter(F.col("_n").isNull() | (seconds_between(F.col(ts), F.col("_n")) > seconds)).drop("_n")


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from a to b, exact to the microsecond, in any session zone."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / 1e6


def gaps(df: DataFrame, key: list[str], ts: str, tie: str, seconds: float) -> DataFrame:
    """Stale spells: rows followed by silence longer than so many seconds, with the time staleness is noticed."""
    w = over(key, [ts, tie])
    return df.withColumn("next_ts", F.lead(ts).over(w)).filter(F.col("next_ts").isNotNull() & (seconds_between(F.col(ts), F.col("next_ts")) > seconds))


def latest_before(left: DataFrame, right: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    """As-of: each row of left with the last value of right at or before it; both have key and ts.

    Both sides are put in one order and the last seen value is carried on, so nothing is paired.
    """
    marked = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)})
    other = right.select(*key, ts, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = marked.unionByName(other, allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_v").alias("v"))), ignorenulls=True).over(w)
    return both.withColumn(f"last_{value}", carried["v"]).filter("_side = 1").drop("_v", "_side")


def interpolated(df: DataFrame, key: list[str], ts: str, value: str, step: int) -> DataFrame:
    """(key, at, value) on a grid of so many seconds between the first and last row of each key, linear between rows."""
    w = over(key, [ts])
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    own = df.select(*key, ts, sec.alias("s"), F.col(value).alias("v")).withColumns({"s2": F.lead("s").over(w.orderBy(ts)), "v2": F.lead("v").over(w.orderBy(ts))}).filter("s2 > s")
    first, last = F.ceil(F.col("s") / step), F.ceil(F.col("s2") / step) - 1
    own = own.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    at = F.col("k") * step
    return own.select(*key, at.cast("bigint").alias("at"), (F.col("v") + (F.col("v2") - F.col("v")) * (at - F.col("s")) / (F.col("s2") - F.col("s"))).alias("value"))


def rolling_mean(value: Column, key: list[str], ts: str, seconds: int) -> Column:
    """Mean over the rows of the last so many seconds, the row itself included."""
    w = W.partitionBy(*key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return F.avg(value).over(w)


def fold(df: DataFrame, key: list[str], order: list[str], step: Callable, start: Callable, schema: str) -> DataFrame:
    """Stream each key's rows in order through step(state, row) -> (state, output row or None).

    Rows are shuffled by key and sorted on disk if need be; a task holds one batch and one state at a time, however
    many rows a key has.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for pdf in batches:
            out = []
            keys = list(zip(*[pdf[k] for k in key], strict=True))
            for k, row in zip(keys, pdf.itertuples(index=False), strict=True):
                k = tuple(None if pd.isna(v) else v for v in k)
                if k != last:
                    last, state = k, start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def throttled(df: DataFrame, seconds: float) -> DataFrame:
    """Leading edge: of (user_id, event_id, s) rows a row passes when so many seconds went by since the last that did."""

    def step(last, row):
        return (row.s, (row.user_id, row.event_id)) if last is None or row.s - last >= seconds else (last, None)

    return fold(df, ["user_id"], ["s", "event_id"], step, lambda: None, "user_id bigint, event_id bigint")


def rate_limited(df: DataFrame, seconds: float, most: int) -> DataFrame:
    """Windows that start with the first hit after the last window: (user_id, event_id, allowed)."""

    def step(state, row):
        began, n = state if state and row.s - state[0] < seconds else (row.s, 0)
        return (began, n + 1), (row.user_id, row.event_id, n + 1 <= most)

    return fold(df, ["user_id"], ["s", "event_id"], step, lambda: None, "user_id bigint, event_id bigint, allowed boolean")


def smoothed(df: DataFrame, alpha: float) -> DataFrame:
    """Exponential moving average of (user_id, event_id, s, value)."""

    def step(mean, row):
        mean = row.value if mean is None else alpha * row.value + (1 - alpha) * mean
        return mean, (row.user_id, row.event_id, mean)

    return fold(df, ["user_id"], ["s", "event_id"], step, lambda: None, "user_id bigint, event_id bigint, mean double")


def bad_transitions(df: DataFrame, key: list[str], order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Rows whose step from the row before isn't among the allowed pairs (prev, next)."""
    steps = df.withColumn("prev", F.lag(state).over(over(key, order))).filter("prev IS NOT NULL").withColumn("next", F.col(state))
    return steps.join(allowed.select("prev", "next").distinct(), ["prev", "next"], "left_anti")
