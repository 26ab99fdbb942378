"""Nearest neighbours, boxes and density clusters against brute force, with crowded spots."""

import math
import random

from waymill.operators import spatial


def points(spark, rows):
    return spark.createDataFrame(rows, "w string, id bigint, x double, y double")


def world(seed):
    """Two thirds of the points in one spot, some in one position, odd rows."""
    r = random.Random(seed)
    rows = [(r.choice("ab"), i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(150)]
    rows += [("a", 1000 + i, 500 + r.random(), 500 + r.random()) for i in range(400)] + [("a", 2000 + i, 7.0, 7.0) for i in range(60)]
    return rows + rows[:5] + [("a", 9001, None, 1.0), ("b", 9002, float("nan"), 1.0), ("b", 9003, float("inf"), 0.0), (None, 9004, 1.0, 1.0), ("a", None, 3.0, 3.0)]


def test_nearest_neighbours(spark):
    pts, qs = world(1), [(w, i, x, y) for w, i, x, y in world(2) if i is not None]
    ok = lambda rows: {(w, i, x, y) for w, i, x, y in rows if None not in (w, i, x) and math.isfinite(x)}
    for k, radius in ((1, None), (3, None), (2, 25.0)):
        got = {}
        for r in spatial.knn_join(points(spark, qs), points(spark, pts).dropDuplicates(), k, radius, ("w",)).collect():
            got.setdefault(r.q_id, []).append((r["rank"], r.p_id))
        want = {}
        for w, i, x, y in ok(qs):
            near = sorted((math.sqrt((x - px) ** 2 + (y - py) ** 2), p) for pw, p, px, py in ok(pts) if pw == w)[:k]
            if near := [p for d, p in near if radius is None or d <= radius]:
                want[i] = [(n + 1, p) for n, p in enumerate(near)]
        assert {q: sorted(v) for q, v in got.items()} == want


def test_no_points_or_queries(spark):
    some, none = points(spark, world(3)), points(spark, [])
    assert spatial.knn_join(none, some, by=("w",)).count() == spatial.knn_join(some, none, by=("w",)).count() == 0


def test_boxes_of_all_sizes(spark):
    r = random.Random(4)
    boxes = [(i, x, y, x + s, y + s * r.random()) for i in range(120) for x, y, s in [(r.uniform(-500, 500), r.uniform(-500, 500), r.choice([0, 0.5, 3, 70, 900]))]]
    boxes += [(500, 5.0, 5.0, 4.0, 6.0), (501, None, 0.0, 1.0, 1.0), (502, -1e7, -1e7, 1e7, 1e7), boxes[0]]
    df = spark.createDataFrame(boxes, "id bigint, x0 double, y0 double, x1 double, y1 double")
    ok = {b for b in boxes if None not in b and b[1] <= b[3] and b[2] <= b[4]}
    got = {(a.l_id, a.r_id) for a in spatial.overlap_join(df, df, 8.0).collect()}
    assert got == {(a[0], b[0]) for a in ok for b in ok if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    pts = [("a", i, r.uniform(-600, 600), r.uniform(-600, 600)) for i in range(200)]
    held = {(p.id, p.box) for p in spatial.box_join(points(spark, pts), df.withColumnRenamed("id", "box"), 8.0).collect()}
    assert held == {(i, b[0]) for _, i, x, y in pts for b in ok if b[1] <= x <= b[3] and b[2] <= y <= b[4]}


def test_clusters_with_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MOST_PAIRS", 20)  # crowded cells look for their nearest instead of pairing
    r = random.Random(5)
    rows = [("a", i, r.uniform(0, 60), r.uniform(0, 60)) for i in range(120)] + [("a", 1000 + i, 30 + r.random() * 3, 30 + r.random() * 3) for i in range(150)]
    got = {x.id: (x.cluster, x.core) for x in spatial.dbscan(points(spark, rows), 2.0, 4, ("w",)).collect()}
    near = {a[1]: [b[1] for b in rows if math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) <= 2.0] for a in rows}
    core = {i for i, n in near.items() if len(n) >= 4}
    label = {i: i for i in core}
    for _ in range(len(core)):
        new = {i: min(label[j] for j in near[i] if j in core) for i in core}
        if new == label:
            break
        label = new
    assert got == {i: (label[i], True) if i in core else (min((label[j] for j in n if j in core), default=None), False) for i, n in near.items()}
