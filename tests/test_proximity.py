import random

from pyspark.sql import functions as F

from waymill.functions.polygons import ear_clip
from waymill.operators import proximity, spatial


def brute(points, probes, radius, self_join):
    out = set()
    for w, i, x, y in probes:
        for v, j, a, b in points:
            if w == v and (x - a) ** 2 + (y - b) ** 2 <= radius * radius and (not self_join or i < j):
                out.add((i, j))
    return out


def sample(seed, n, crowded=0):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b"]), i, r.randint(-2000, 2000) / 16, r.randint(-2000, 2000) / 16) for i in range(n)]
    return rows + [("a", n + i, 5.0 + r.randint(0, 8) / 256, 5.0) for i in range(crowded)]


def test_near_pairs_with_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(proximity, "HOT_CELL", 20)
    rows = sample(1, 300, crowded=120)  # a third stands in one cell
    df = spark.createDataFrame(rows, "world string, id bigint, x double, y double")
    probes = df.select(F.lit("p").alias("relation"), "*", F.lit(True).alias("self")).unionByName(df.select(F.lit("e").alias("relation"), "*", F.lit(False).alias("self")))
    got = proximity.near_pairs(df, probes, 3.0).collect()
    pairs = [(r.probe_id, r.id) for r in got if r.relation == "p"]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(rows, rows, 3.0, True)
    assert {(r.probe_id, r.id) for r in got if r.relation == "e"} == brute(rows, rows, 3.0, False)


def test_positions_that_dont_count(spark):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, float("nan"), 0.0), ("a", 3, None, 0.0), ("a", 4, float("inf"), 0.0), ("a", 5, 3.0, 0.0), ("a", 6, -3.0001, 0.0)]
    df = spark.createDataFrame(rows, "world string, id bigint, x double, y double")
    probes = df.select(F.lit("p").alias("relation"), "*", F.lit(True).alias("self"))
    assert [(r.probe_id, r.id) for r in proximity.near_pairs(df, probes, 3.0).collect()] == [(1, 5)]


def test_hierarchy_of_many_levels(spark, monkeypatch):
    for k, v in (("LEAF", 2), ("FANOUT", 2), ("ROOTS", 2)):
        monkeypatch.setattr(proximity, k, v)
    squares = [(w, 100 * i + j, [(i * 10.0, j * 10.0), (i * 10.0 + 12, j * 10.0), (i * 10.0 + 12, j * 10.0 + 12), (i * 10.0, j * 10.0 + 12)]) for w in "ab" for i in range(6) for j in range(6)]
    regions = spark.createDataFrame([(w, r, [{"x": x, "y": y} for x, y in ring]) for w, r, ring in squares], "world string, region bigint, ring array<struct<x double, y double>>")
    rows = sample(3, 400)
    points = spark.createDataFrame(rows, "world string, id bigint, x double, y double")
    got = proximity.regions_of(points, regions).collect()
    want = {(w, i, r) for w, i, x, y in rows for v, r, ring in squares if v == w and ring[0][0] <= x <= ring[2][0] and ring[0][1] <= y <= ring[2][1]}
    assert len(got) == len(want)
    assert {(r.world, r.id, r.region) for r in got} == want


def test_more_worlds_than_roots(spark, monkeypatch):
    monkeypatch.setattr(proximity, "ROOTS", 1)
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))]
    regions = spark.createDataFrame([(w, i, ring) for i, w in enumerate("abc")], "world string, region bigint, ring array<struct<x double, y double>>")
    points = spark.createDataFrame([("a", 1, 1.0, 1.0), ("c", 2, 2.0, 2.0), ("d", 3, 1.0, 1.0), ("b", 4, 5.0, 1.0)], "world string, id bigint, x double, y double")
    assert {(r.id, r.region) for r in proximity.regions_of(points, regions).collect()} == {(1, 0), (2, 2)}


def test_knn_without_and_with_radius(spark):
    p, q = sample(5, 200), sample(6, 60)
    near = lambda w, x, y, k, most: sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for v, j, a, b in p if v == w and ((x - a) ** 2 + (y - b) ** 2) ** 0.5 <= most)[:k]
    schema = "w string, id bigint, x double, y double"
    pd, qd = spark.createDataFrame(p, schema), spark.createDataFrame([*q, ("c", 999, 0.0, 0.0)], schema)
    for radius in (None, 30.0):
        got = spatial.knn_join(qd, pd, 3, radius, ("w",)).collect()
        for w, i, x, y in q:
            assert [r.p_id for r in sorted((r for r in got if r.q_id == i), key=lambda r: r["rank"])] == [j for _, j in near(w, x, y, 3, radius or 1e9)]


def test_knn_of_nothing(spark):
    schema = "id bigint, x double, y double"
    some, none = spark.createDataFrame([(1, 0.0, 0.0)], schema), spark.createDataFrame([], schema)
    assert spatial.knn_join(some, none).count() == 0
    assert spatial.knn_join(none, some).count() == 0


def test_dbscan_like_brute_force(spark):
    rows = [(i, x, y) for w, i, x, y in sample(8, 500) if w == "a"] + [(1000 + i, i * 4.0, 200.0) for i in range(12)] + [(2000 + i, 300.0, 300.0) for i in range(6)]
    eps, least = 6.0, 4
    near = {i: {j for j, a, b in rows if (x - a) ** 2 + (y - b) ** 2 <= eps * eps} for i, x, y in rows}
    core = {i for i, n in near.items() if len(n) >= least}
    label, todo = {}, sorted(core)
    for i in todo:
        if i in label:
            continue
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in label:
                label[k] = i
                stack += [j for j in near[k] if j in core and j not in label]
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i, _, _ in rows}
    got = {r.id: (r.cluster, r.core) for r in spatial.dbscan(spark.createDataFrame(rows, "id bigint, x double, y double"), eps, least).collect()}
    assert {i: v[0] for i, v in got.items()} == want
    assert {i for i, v in got.items() if v[1]} == core


def test_large_rings_take_no_quadratic_time():
    """A jagged coastline of 10,000 vertices is cut in seconds and keeps its area."""
    import math
    import time

    n = 10_000
    ring = [{"x": math.cos(2 * math.pi * i / n) * (5000 + 40 * (i % 7)), "y": math.sin(2 * math.pi * i / n) * (5000 + 40 * (i % 7))} for i in range(n)]
    began = time.time()
    cut = ear_clip(ring)
    area = lambda t: abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[1][1] - t[0][1]) * (t[2][0] - t[0][0])) / 2
    whole = abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    assert abs(sum(map(area, cut)) - whole) < 1e-6 * whole
    assert time.time() - began < 60
