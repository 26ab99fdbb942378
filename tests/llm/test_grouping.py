import random

import pytest

from waymill.llm import grouping


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for w, a, b in pairs:
        if a is None or b is None:
            continue
        p, q = find((w, a)), find((w, b))
        if p != q:
            up[max(p, q)] = min(p, q)
    return {x: find(x)[1] for x in up}


def groups(spark, pairs):
    df = spark.createDataFrame(pairs, "w string, a bigint, b bigint")
    rows = [((r.w, r.a), r.root) for r in grouping.connected_groups(df).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_pairs(spark, seed):
    r = random.Random(seed)
    pairs = [(r.choice("xy"), r.randint(0, 200), r.randint(0, 200) if r.random() > 0.05 else None) for _ in range(130)]
    pairs += [("x", 900, 1000 + i) for i in range(40)]  # a star
    pairs += [("y", 2000 + i, 2001 + i) for i in range(70)]  # a chain
    pairs += pairs[:20] + [("x", 5000, 5000)]
    assert groups(spark, pairs) == brute(pairs)


def test_chain_with_a_hub_and_a_long_tail(spark):
    """The search exhausts a long tail too, because what it hasn't reached gets shorter every round."""
    order = list(range(120))
    random.Random(7).shuffle(order)
    pairs = [("", a, b) for a, b in zip(order, order[1:], strict=False)] + [("", order[60], 500 + i) for i in range(10)]
    assert groups(spark, pairs) == brute(pairs)


def test_ladder_takes_few_rounds(spark, monkeypatch):
    """A ladder of 400 rungs has no chains and no hub; the search still ends after a few rounds."""
    order = list(range(800))
    random.Random(9).shuffle(order)
    pairs = [("", order[i + 400 * s], order[i + 1 + 400 * s]) for i in range(399) for s in (0, 1)] + [("", order[i], order[i + 400]) for i in range(400)]
    pairs += [("", 2000 + i, 2001 + i) for i in range(0, 50, 2)]
    rounds = []
    monkeypatch.setattr(grouping, "rewired", lambda e, s, k, f=grouping.rewired: rounds.append(k) or f(e, s, k))
    assert groups(spark, pairs) == brute(pairs)
    assert len(rounds) <= 12


def test_nothing(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [("", None, 1), ("", 2, None)]) == {}


def test_spelling_worlds_and_order(spark):
    rows = [("usa", "0xFFFFFFFFFFFFFFFF", " 1 "), ("usa", "ffffffffffffffff", "8000000000000000"), ("europe", "1", "2"), ("usa", None, "9"), ("usa", "x!", "9"), ("usa", "7", "7"), (None, "5", "4")]
    df = spark.createDataFrame(rows, "map_name string, feature_a string, feature_b string")
    got = {(r.road_feature, r.group_feature) for r in grouping.group_matches(df).collect()}
    assert got == {("f" * 16, "1"), ("1", "1"), ("8000000000000000", "1"), ("2", "1"), ("7", "7"), ("5", "4"), ("4", "4")}
