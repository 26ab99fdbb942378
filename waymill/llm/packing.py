"""Filling containers of fixed capacity with texts: mixture-controlled packing by deficit round-robin.

Each source is a queue of texts in a fixed random order. A window holds WINDOW containers; every round of the
round-robin gives each source its quantum, its target share of the window's tokens, added to the deficit it carries,
and serves texts from the head of its queue while the deficit pays for them. A queue that keeps its deficit from
round to round serves text i in the first round r whose credit r * quantum reaches the tokens up to and including i,
so the whole schedule follows from running token counts: round = ceil(count / quantum). The counts run across windows
and partitions: a source is cut into hashed buckets, bucket totals give each bucket's start, and a running sum within
a bucket does the rest, so a source that holds a third of all rows is no group of one task.

Within a window texts are placed largest first, each into the fullest container that still takes it. Texts above the
capacity are split: full pieces take a container each, the last piece is placed like a text. Windows are filled one
after the other in stripes of STRIPE: containers that a window leaves below CARRY of the capacity aren't closed, their
pieces go on to the next window of the stripe and are placed with it, once; so the room a window's end leaves unused
doesn't add up, a container holds pieces of two neighbouring windows at most, and a source is never further from its
target than by what one window carries. mixture() measures that by container.

Targets are the sources' shares of all tokens, or shares given by the caller; with given shares a source that runs
dry simply ends, and the others go on at their quantum; sources without a share are served after the others, in windows
of their own, in proportion to their tokens. Null or empty texts and texts of no tokens take no room: they
come out in container -1. Rows with a null id take no part; a null source is a source of its own; repeated rows count
once. Texts are tokenized whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymill.llm.tokens import count_tokens
from waymill.session import Scratch

CAPACITY, WINDOW, STRIPE, BUCKET_ROWS, CARRY = 2048, 512, 16, 20_000, 0.995


def sized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every text."""
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").filter("doc_id IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": count_tokens(pdf["text"], vocabulary)})

    return own.mapInPandas(run, "doc_id bigint, source string, n_tokens bigint").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def running_tokens(items: DataFrame, scratch: Scratch) -> DataFrame:
    """items with `upto`, the tokens of the source's queue up to and including the row."""
    n = items.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    keyed = items.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("own"))
    start = totals.withColumn("start", F.sum("own").over(W.partitionBy("source").orderBy("bucket")) - F.col("own")).drop("own")
    within = F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    return keyed.withColumn("run", within).join(start, ["source", "bucket"]).withColumn("upto", F.col("run") + F.col("start")).drop("run", "start", "h", "bucket")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each size: largest first, into the fullest container that still takes it."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    at, room = [0] * len(sizes), []  # room: sorted (free tokens, container)
    made = 0
    for i in order:
        k = bisect.bisect_left(room, (sizes[i], -1))
        if k == len(room):
            free, c = capacity, made
            made += 1
        else:
            free, c = room.pop(k)
        at[i] = c
        if free > sizes[i]:
            bisect.insort(room, (free - sizes[i], c))
    return at


_PLACED = "doc_id bigint, source string, piece int, n_tokens bigint, window_id bigint, container_window bigint, container_key string"


def _place(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The windows of a stripe in order; what a window leaves open and hasn't been carried yet goes on."""
        parts, carried = [], None
        windows = sorted(pdf["window_id"].unique())
        for w in windows:
            own = pdf[pdf["window_id"] == w].sort_values(["doc_id", "piece"], kind="stable")
            own = own if carried is None else pd.concat([carried, own], ignore_index=True)
            c = pd.Series(best_fit(own["n_tokens"].tolist(), capacity), index=own.index)
            filled, oldest = own["n_tokens"].groupby(c).transform("sum"), own["window_id"].groupby(c).transform("min")
            open_ = (filled < int(CARRY * capacity)) & (oldest == w) & (w != windows[-1])
            carried = own[open_]
            parts.append(own[~open_].assign(container_window=w, container_key=f"{w}:" + c[~open_].astype(str)))
        return pd.concat(parts)[[f.split()[0] for f in _PLACED.split(", ")]]

    return run


def pack(docs: DataFrame, shares: dict[str, float] | None = None, capacity: int = CAPACITY, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """(container_id, container_window, window_id, doc_id, source, piece, n_tokens) of every piece of every text.

    container_id is a text, unique to the container; window_id is the window that served the text, container_window the
    one that filled the container.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    items = scratch.write(sized(docs, vocabulary), "sized")
    nowhere = F.lit(-1).cast("bigint")
    none = items.filter("n_tokens = 0").select(F.lit("-1").alias("container_id"), nowhere.alias("container_window"), nowhere.alias("window_id"), "doc_id", "source", F.lit(0).alias("piece"), "n_tokens")
    queue = items.filter("n_tokens > 0")
    target = queue.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    if shares is None:
        target = target.select("source", "tokens", F.col("tokens").cast("double").alias("share"), F.lit(0).alias("turn"))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(v)) for s, v in shares.items() if v > 0], "source string, given double")
        target = target.join(F.broadcast(given), "source", "left").select("source", "tokens", F.coalesce("given", F.col("tokens").cast("double")).alias("share"), F.when(F.col("given").isNull(), 1).otherwise(0).alias("turn"))
    total = target.groupBy("turn").agg(F.sum("share").alias("total"))
    room = window * capacity
    quantum = F.greatest(F.lit(1.0), F.col("share") / F.col("total") * room)
    target = scratch.write(target.join(F.broadcast(total), "turn").select("source", "tokens", "turn", quantum.alias("quantum")), "targets")
    if target.isEmpty():
        return none
    # windows of the sources without a share follow the last one of the others
    first = target.filter("turn = 0").agg(F.max(F.ceil(F.col("tokens") / F.col("quantum")))).first()[0] or 0
    window_id = F.ceil(F.col("upto") / F.col("quantum")) - 1 + F.col("turn") * int(first)
    served = running_tokens(queue, scratch).join(target.drop("tokens"), "source").withColumn("window_id", window_id.cast("bigint"))
    # full pieces of texts above the capacity need no placing
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    served = scratch.write(served.select("doc_id", "source", "n_tokens", "window_id", full.alias("full")), "served")
    whole = served.filter("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    whole = whole.select(F.concat(F.lit("f:"), "doc_id", F.lit(":"), "piece").alias("container_id"), F.col("window_id").alias("container_window"), "window_id", "doc_id", "source", "piece", F.lit(capacity).cast("bigint").alias("n_tokens"))
    rest = served.withColumn("left", F.col("n_tokens") - F.col("full") * capacity).filter("left > 0")
    rest = rest.select("doc_id", "source", F.col("full").alias("piece"), F.col("left").alias("n_tokens"), "window_id", F.floor(F.col("window_id") / STRIPE).alias("stripe"))
    placed = rest.groupBy("stripe").applyInPandas(_place(capacity), _PLACED).withColumn("container_id", F.concat(F.lit("w:"), "container_key"))
    return placed.select(none.columns).unionByName(whole.select(none.columns)).unionByName(none)


def mixture(packed: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(container_window, containers, tokens, deviation, dry): for the containers filled by each window, the largest
    difference between a source's share of their tokens and its target, and how many sources with a target hold none of
    them because their texts are used up.

    Without shares the targets are the sources' shares of all tokens.
    """
    rows = packed.filter("container_id <> '-1'")
    if shares is None:
        own = rows.groupBy("source").agg(F.sum("n_tokens").alias("share"))
    else:
        own = packed.sparkSession.createDataFrame([(s, float(v)) for s, v in shares.items() if v > 0], "source string, share double")
    target = own.join(own.agg(F.sum("share").alias("all"))).select("source", (F.col("share") / F.col("all")).alias("target"))
    windows = rows.groupBy("container_window").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    held = rows.groupBy("container_window", "source").agg(F.sum("n_tokens").alias("held"), F.max("window_id").alias("upto"))
    last = held.groupBy("source").agg(F.max("upto").alias("last"))
    met = held.join(windows, "container_window").join(target, "source", "full").join(last, "source", "left")
    met = met.filter("container_window IS NOT NULL")
    there = met.groupBy("container_window").agg(F.max(F.abs(F.col("held") / F.col("tokens") - F.coalesce("target", F.lit(0.0)))).alias("own"), F.sum(F.coalesce("target", F.lit(0.0))).alias("met"), F.count("target").alias("n"))
    n = target.count()
    # the sources of a window that hold nothing of it miss the rest of the targets
    return windows.join(there, "container_window").select("container_window", "containers", "tokens", F.greatest("own", F.when(F.col("n") < n, 1 - F.col("met")).otherwise(0.0)).alias("deviation"), (F.lit(n) - F.col("n")).alias("dry"))
