import random

import pytest
from pyspark.sql import functions as F

from waymill.llm import packing
from waymill.llm.tokens import count_tokens


@pytest.fixture
def small(monkeypatch):
    """Sizes are the texts' numbers of words, so that cases can be made by hand."""
    import pandas as pd

    def sized(docs, vocabulary=None):
        n = F.when(F.length(F.trim("text")) > 0, F.size(F.split(F.trim("text"), " "))).otherwise(0)
        return docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_tokens")).distinct()

    monkeypatch.setattr(packing, "sized", sized)
    return pd


def rows(spark, sizes):
    data = [(i, s, " ".join(["w"] * n) if n is not None else None) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(data, "doc_id bigint, source string, text string")


def check(spark, sizes, capacity, got):
    filled, pieces = {}, {}
    for r in got:
        if r.container_id != "-1":
            filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
    assert max(filled.values()) <= capacity
    for i, (_, n) in enumerate(sizes):
        own = sorted(pieces[i])
        assert [p for p, _ in own] == list(range(len(own)))
        assert sum(k for _, k in own) == (n or 0)
        assert len(own) == max(1, -(-(n or 0) // capacity))
        assert all(k == capacity for _, k in own[:-1])
    return filled


def test_every_text_is_placed_once_and_whole(spark, small):
    r = random.Random(1)
    sizes = [(r.choice(["a", "a", "a", "b", None]), r.choice([0, 1, 5, 17, 40, 64, 65, 130, 400])) for _ in range(600)] + [("hot", 3)] * 300 + [("c", None)]
    got = packing.pack(rows(spark, sizes), capacity=64, window=16).collect()
    filled = check(spark, sizes, 64, got)
    tokens = sum(n or 0 for _, n in sizes)
    assert len(filled) <= 1.02 * tokens / 64 + 2


def test_windows_keep_the_mixture(spark, small):
    sizes = [("a", 4)] * 800 + [("b", 8)] * 100
    got = packing.pack(rows(spark, sizes), capacity=64, window=10).collect()
    share = {}
    for r in got:
        w = share.setdefault(r.window_id, {"a": 0, "b": 0})
        w[r.source] += r.n_tokens
    last = max(share)
    for w, s in share.items():
        if w != last:
            assert abs(s["a"] - 0.8 * 640) <= 8
            assert abs(s["b"] - 0.2 * 640) <= 8


def test_containers_keep_the_mixture(spark, small):
    """By container as filled, not only as served: what a window carries on is little and comes at once after it."""
    r = random.Random(5)
    sizes = [(s, r.randint(1, 40)) for s, n in (("a", 3000), ("b", 1200), ("c", 500), (None, 300)) for _ in range(n)]
    packed = packing.pack(rows(spark, sizes), capacity=64, window=40)
    got = packed.collect()
    filled = check(spark, sizes, 64, got)
    assert len(filled) <= 1.01 * sum(n for _, n in sizes) / 64 + 1
    assert all(0 <= x.container_window - x.window_id <= 1 for x in got)
    mix = sorted(packing.mixture(packed).collect(), key=lambda x: x.container_window)
    assert len(mix) > 30
    assert max(x.deviation for x in mix[:-1]) <= 0.05
    assert all(x.dry == 0 for x in mix[:-1])


def test_sources_without_a_share_come_last(spark, small):
    sizes = [("a", 4)] * 300 + [("b", 4)] * 100 + [("x", 4)] * 60 + [("y", 4)] * 20
    shares = {"a": 3.0, "b": 1.0, "absent": 0.0}
    packed = packing.pack(rows(spark, sizes), shares=shares, capacity=64, window=5)
    got = packed.collect()
    check(spark, sizes, 64, got)
    last = max(r.window_id for r in got if r.source in "ab")
    assert {r.window_id > last for r in got if r.source in "xy"} == {True}
    assert len({r.window_id for r in got if r.source == "x"}) == 1
    mix = {r.container_window: r for r in packing.mixture(packed, shares).collect()}
    assert mix[0].deviation <= 0.02
    assert mix[last + 1].dry == 2


def test_given_shares(spark, small):
    sizes = [("a", 4)] * 400 + [("b", 4)] * 400
    got = packing.pack(rows(spark, sizes), shares={"a": 3.0, "b": 1.0}, capacity=64, window=10).collect()
    check(spark, sizes, 64, got)
    first = [r for r in got if r.window_id == 0]
    assert abs(sum(r.n_tokens for r in first if r.source == "a") - 480) <= 4


def test_running_tokens_match_a_plain_sum(spark, monkeypatch):
    from waymill.session import Scratch

    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(i, "s" if i % 3 else "t", i % 7 + 1) for i in range(200)], "doc_id bigint, source string, n_tokens bigint")
    got = packing.running_tokens(df, Scratch(spark, "t")).collect()
    for s in "st":
        own = sorted((r for r in got if r.source == s), key=lambda r: r.upto)
        total = 0
        for r in own:
            total += r.n_tokens
            assert r.upto == total


def test_best_fit():
    assert packing.best_fit([], 10) == []
    at = packing.best_fit([6, 4, 5, 5, 10], 10)
    assert len(set(at)) == 3
    assert at[0] == at[1]
    assert at[2] == at[3]


def test_tokens_of_odd_texts():
    import pandas as pd

    assert count_tokens(pd.Series([None, "", "hello", "a" * 20_000]))[:2] == [0, 0]
