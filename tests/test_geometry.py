import math
import random

import pytest
from pyspark.sql import functions as F

from waymill.functions import geometry as g
from waymill.functions import polygons, texts


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("map_name", "x", "y", "lon", "lat"),
    [
        ("usa", -85672, 7870, -114.92606131601985, 36.00959614633237),
        ("europe", -40169, -10685, -0.5943602137854889, 51.29443960532431),
        ("europe", 62276, 84880, 24.63877984644102, 35.391305791648065),
        ("europe", -30120, 5847, 2.2454398875049852, 48.96983557895307),
    ],
)
def test_projection(spark, map_name, x, y, lon, lat):
    p = g.PROJECTIONS[map_name]
    a, b = p.to_degrees(F.lit(float(x)), F.lit(float(y)))
    got = one(spark, a, b, *p.from_degrees(a, b))
    assert got[0] == pytest.approx(lon, abs=1e-9)
    assert got[1] == pytest.approx(lat, abs=1e-9)
    assert got[2:] == pytest.approx((x, y), abs=1e-6)


def test_angles(spark):
    got = one(spark, g.normalize_radians(F.lit(3 * math.pi)), g.normalize_radians(F.lit(-math.pi)), g.angle_between(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert got == pytest.approx((math.pi, math.pi, math.pi / 2))


def test_heading_score_poses(spark):
    """A line to the east and poses on and off it."""
    score = lambda heading, metres: g.heading_score(F.lit(math.radians(heading)), F.lit(math.pi / 2), F.lit(float(metres)))
    got = one(spark, score(90, 0), score(270, 0), score(0, 0), score(90, 20), score(90, 200), score(45, 0))
    assert got[:3] == pytest.approx((1, -1, 0), abs=0.005)
    assert 0 < got[3] < 1
    assert got[4] == pytest.approx(0, abs=0.005)
    assert 0 < got[5] < 1


def test_segment_of_no_length(spark):
    z = F.lit(0.0)
    assert one(spark, g.segment_distance(F.lit(3.0), F.lit(4.0), z, z, z, z))[0] == 5.0


@pytest.mark.parametrize(("metres", "want"), [(0, "0 m"), (44, "40 m"), (149, "150 m"), (330, "350 m"), (1000, "1,000 m"), (1600, "2 km"), (123456, "123 km")])
def test_metric_length(spark, metres, want):
    assert one(spark, texts.metric_length(F.lit(float(metres))))[0] == want


def test_imperial_length_and_duration(spark):
    got = one(spark, texts.imperial_length(F.lit(30.48)), texts.imperial_length(F.lit(8046.72)), texts.duration_text(F.lit(3661)), texts.duration_text(F.lit(59)))
    assert tuple(got) == ("100 ft", "5 mi", "1 hr 2 min", "1 min")


@pytest.mark.parametrize(("n", "want"), [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (13, "13th"), (21, "21st"), (111, "111th")])
def test_ordinal(spark, n, want):
    assert one(spark, texts.ordinal(F.lit(n)))[0] == want


def test_route_key(spark):
    ok = lambda k: one(spark, texts.is_route_key(F.lit(k)))[0]
    assert ok("1a-2B-forward-fastest-usa")
    assert not ok("1a-2b-forward-usa")
    assert not ok("x-2b-forward-fastest-usa")
    assert not ok("1a-2b-up-fastest-usa")


def test_texts(spark):
    got = one(spark, texts.title_case(F.lit("ÉCLAIR-sur mer".upper())), texts.title_case(F.lit("McCall")), texts.expand_abbreviations(F.lit("Mt. St Helens Jct")), texts.fold(F.lit("Zażółć")), texts.rotate_right(F.array(*map(F.lit, (1, 2, 3))), -1))
    assert tuple(got) == ("Éclair-Sur Mer", "McCall", "Mount St Helens Junction", "zazolc", [2, 3, 1])


def area(t):
    (a, b), (c, d), (e, f) = t
    return abs((c - a) * (f - b) - (d - b) * (e - a)) / 2


def inside(ring, x, y):
    n, odd = len(ring), False
    for i in range(n):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def covers(triangles, x, y):
    for t in triangles:
        s = [(t[(i + 1) % 3][0] - t[i][0]) * (y - t[i][1]) - (t[(i + 1) % 3][1] - t[i][1]) * (x - t[i][0]) for i in range(3)]
        if all(v >= 0 for v in s) or all(v <= 0 for v in s):
            return True
    return False


@pytest.mark.parametrize("seed", range(20))
def test_ear_clipping_covers_the_ring(seed):
    r = random.Random(seed)
    n = r.randint(3, 25)
    spread = 1 if seed % 4 else 3  # some rings cross themselves
    ring = [(round(math.cos(2 * math.pi * i / n * spread) * (d := r.randint(200, 2000)) / 4) + 0.25, round(math.sin(2 * math.pi * i / n * spread) * d / 4) + 0.5) for i in range(n)]
    if seed % 2:
        ring.reverse()
    closed = [*ring, ring[0]] if seed % 3 else ring
    triangles = polygons.ear_clip([{"x": x, "y": y} for x, y in closed])
    for _ in range(400):
        x, y = r.uniform(-550, 550), r.uniform(-550, 550)
        assert covers(triangles, x, y) == inside(ring, x, y)


def test_odd_rings():
    p = lambda *pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    assert polygons.ear_clip(None) == []
    assert polygons.ear_clip([]) == []
    assert polygons.ear_clip(p((0, 0), (1, 1))) == []
    assert polygons.ear_clip(p((0, 0), (1, 1), (2, 2))) == []
    assert polygons.ear_clip([{"x": None, "y": 1.0}, *p((0, 0), (1, 0), (1, 1))]) == []
    square = polygons.ear_clip(p((0, 0), (1, 0), (2, 0), (2, 0), (2, 2), (0, 2), (0, 0)))
    assert sum(map(area, square)) == 4
