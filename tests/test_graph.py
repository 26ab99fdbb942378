"""Routes and cycles against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from waymill.operators import graph


def brute(edges, source):
    best = {source: 0.0}
    for _ in range(len(edges)):
        for a, b, w in edges:
            if None not in (a, b, w) and a in best and best[a] + w < best.get(b, 1e300):
                best[b] = best[a] + w
    return best


def network(seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40), float(r.randint(0, 20))) for _ in range(90)]
    edges += [(i, i + 1, 1.0) for i in range(100, 130)] + edges[:5] + [(3, None, 1.0), (None, 3, 1.0), (3, 4, None), (5, 5, 0.0)]
    requests = [(r.randrange(45), r.randrange(45)) for _ in range(30)] + [(100, 130), (130, 100), (100, 115), (7, 7), (None, 3), (3, None), (999, 1000), (999, 999), (5, 5), (5, 5)]
    return edges, requests


@pytest.mark.parametrize("most", [10**6, 0])
def test_routes(spark, monkeypatch, most):
    """Handed to the tasks and searched cell by cell give the same costs, and paths that cost as much."""
    monkeypatch.setattr(graph, "SNAPSHOT_EDGES", most)
    edges, requests = network(1)
    e = spark.createDataFrame(edges, "src bigint, dst bigint, cost double")
    q = spark.createDataFrame(requests, "src bigint, dst bigint").withColumn("more", F.lit("x"))
    cells = spark.createDataFrame([(i, i // 8) for i in range(200)], "node bigint, cell bigint")
    got = {(r.src, r.dst): (r.cost, r.path) for r in graph.routes(e, q, cells).collect()}
    want = {}
    for a, b in {x for x in requests if None not in x}:
        cost = brute(edges, a).get(b)
        if cost is not None:
            want[a, b] = cost
    assert {k: c for k, (c, _) in got.items()} == want
    least = {}
    for a, b, w in edges:
        if None not in (a, b, w):
            least[a, b] = min(w, least.get((a, b), 1e300))
    for (a, b), (cost, path) in got.items():
        assert path[0] == a
        assert path[-1] == b
        assert sum(least[x, y] for x, y in zip(path, path[1:], strict=False)) == cost


@pytest.mark.parametrize("most", [10**6, 0])
def test_costs_from(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "SNAPSHOT_EDGES", most)
    edges, _ = network(2)
    e = spark.createDataFrame(edges, "src bigint, dst bigint, cost double")
    seeds = spark.createDataFrame([(0,), (100,), (5,), (777,), (None,), (0,)], "node bigint")
    got = {(r.source, r.node): r.cost for r in graph.costs_from(e, seeds).collect()}
    assert got == {(s, n): c for s in (0, 100, 5, 777) for n, c in brute(edges, s).items()}


def test_nothing(spark):
    e = spark.createDataFrame([], "src bigint, dst bigint, cost double")
    q = spark.createDataFrame([(1, 2), (3, 3)], "src bigint, dst bigint")
    assert [tuple(r) for r in graph.routes(e, q).collect()] == [(3, 3, 0.0, [3])]


def test_routes_leave_the_graph_out_of_the_driver(spark, monkeypatch):
    """No size of graph is fetched as a whole; a search stops at its goals, a tie goes by the smaller node."""

    def whole(self):
        raise AssertionError("edges were fetched to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toPandas", whole)
    top = 2**63 - 1
    e = spark.createDataFrame([(-top, 1, 2.0), (-top, 0, 2.0), (0, top, 1.0), (1, top, 1.0), (top, -top, 0.0), (4, 5, 1.0)], "src bigint, dst bigint, cost double")
    q = spark.createDataFrame([(-top, top), (-top, 0), (top, 5), (5, 4), (4, 5)], "src bigint, dst bigint")
    got = {(r.src, r.dst): (r.cost, r.path) for r in graph.routes(e, q).collect()}
    assert got == {(-top, top): (3.0, [-top, 0, top]), (-top, 0): (2.0, [-top, 0]), (4, 5): (1.0, [4, 5])}
