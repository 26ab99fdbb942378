"""Ear clipping of polygon rings, with a slab decomposition for rings that cross themselves."""

from __future__ import annotations

import math

Point = tuple[float, float]
Triangle = tuple[Point, Point, Point]


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def clean_ring(ring) -> list[Point]:
    """Vertices without a closing repeat, without consecutive repeats; empty when a position is missing or not finite."""
    pts: list[Point] = []
    for p in ring if ring is not None else ():
        if p is None or p["x"] is None or p["y"] is None or not (math.isfinite(p["x"]) and math.isfinite(p["y"])):
            return []
        q = (float(p["x"]), float(p["y"]))
        if not pts or pts[-1] != q:
            pts.append(q)
    while len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    return pts


def _crosses_itself(pts: list[Point]) -> bool:
    """Whether two edges that aren't neighbours meet: a sweep over x, each edge against those it overlaps there."""
    n = len(pts)
    order = sorted(range(n), key=lambda i: min(pts[i][0], pts[(i + 1) % n][0]))
    active: list[int] = []
    for i in order:
        a, b = pts[i], pts[(i + 1) % n]
        left, low, high = min(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])
        active = [j for j in active if max(pts[j][0], pts[(j + 1) % n][0]) >= left]
        for j in active:
            if (j + 1) % n == i or (i + 1) % n == j:
                continue
            c, d = pts[j], pts[(j + 1) % n]
            if high < min(c[1], d[1]) or max(c[1], d[1]) < low:
                continue
            if _cross(a, b, c) * _cross(a, b, d) <= 0 and _cross(c, d, a) * _cross(c, d, b) <= 0:
                return True
        active.append(i)
    return False


class _Grid:
    """Vertices by cell of a grid of about one vertex a cell."""

    def __init__(self, pts: list[Point]):
        self.pts = pts
        self.x0, self.y0 = min(p[0] for p in pts), min(p[1] for p in pts)
        self.size = max(max(p[0] for p in pts) - self.x0, max(p[1] for p in pts) - self.y0, 1e-9) / max(1.0, math.sqrt(len(pts)))
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.held: set[int] = set()

    def _at(self, p: Point) -> tuple[int, int]:
        return int((p[0] - self.x0) / self.size), int((p[1] - self.y0) / self.size)

    def add(self, i: int) -> None:
        self.cells.setdefault(self._at(self.pts[i]), set()).add(i)
        self.held.add(i)

    def remove(self, i: int) -> None:
        if i in self.held:
            self.cells[self._at(self.pts[i])].discard(i)
            self.held.discard(i)

    def around(self, *corners: Point):
        (x0, y0), (x1, y1) = (self._at((f(p[0] for p in corners), f(p[1] for p in corners))) for f in (min, max))
        if (x1 - x0 + 1) * (y1 - y0 + 1) > len(self.held):
            yield from self.held
            return
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                yield from self.cells.get((x, y), ())


def ear_clip(ring) -> list[Triangle]:
    """Triangles that cover the ring's inside (even-odd where it crosses itself); none below three vertices.

    Direction and closing of the ring don't matter. Coordinates that are multiples of 1/256 below 2^18 keep every
    orientation test exact in doubles. Only vertices that aren't convex can lie in an ear; they stand in a grid, and the
    search for the next ear goes on where the last one was cut, so large rings take about linear time.
    """
    pts = clean_ring(ring)
    if len(pts) < 3:
        return []
    if _crosses_itself(pts):
        return _slabs(pts)
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True)) < 0:
        pts.reverse()
    n = len(pts)
    before, after = [i - 1 for i in range(n)], [(i + 1) % n for i in range(n)]
    before[0] = n - 1
    turn = lambda i: _cross(pts[before[i]], pts[i], pts[after[i]])
    blocking = _Grid(pts)
    for i in range(n):
        if turn(i) <= 0:
            blocking.add(i)

    def is_ear(i: int) -> bool:
        a, b, c = pts[before[i]], pts[i], pts[after[i]]
        return not any((p := pts[k]) not in (a, b, c) and _cross(a, b, p) >= 0 and _cross(b, c, p) >= 0 and _cross(c, a, p) >= 0 for k in blocking.around(a, b, c))

    out, left, i, missed = [], n, 0, 0
    while left > 3:
        t = turn(i)
        if t == 0 or (t > 0 and is_ear(i)):  # a vertex on a straight line is cut without a triangle
            if t > 0:
                out.append((pts[before[i]], pts[i], pts[after[i]]))
            a, c = before[i], after[i]
            after[a], before[c] = c, a
            blocking.remove(i)
            for k in (a, c):
                if turn(k) > 0:
                    blocking.remove(k)
            left, i, missed = left - 1, a, 0
        else:
            i, missed = after[i], missed + 1
            if missed > left:
                return _slabs(pts)
    last = (pts[before[i]], pts[i], pts[after[i]])
    if _cross(*last) != 0:
        out.append(last)
    return out


def _slabs(pts: list[Point]) -> list[Triangle]:
    """Even-odd inside of a ring that crosses itself, cut at the heights of all vertices and crossings; a sweep over y
    keeps the edges that a height meets."""
    edges = [(a, b) if a[1] < b[1] else (b, a) for a, b in zip(pts, pts[1:] + pts[:1], strict=True) if a[1] != b[1]]
    edges.sort(key=lambda e: e[0][1])
    heights = {p[1] for p in pts}
    at = lambda e, y: e[0][0] + (e[1][0] - e[0][0]) * (y - e[0][1]) / (e[1][1] - e[0][1])
    active: list = []
    for e in edges:
        active = [f for f in active if f[1][1] > e[0][1]]
        for f in active:
            lo, hi = max(e[0][1], f[0][1]), min(e[1][1], f[1][1])
            if lo < hi and (d0 := at(e, lo) - at(f, lo)) * (d1 := at(e, hi) - at(f, hi)) < 0:
                heights.add(lo + (hi - lo) * d0 / (d0 - d1))
        active.append(e)
    ys, out, active, k = sorted(heights), [], [], 0
    for lo, hi in zip(ys, ys[1:], strict=False):
        mid = (lo + hi) / 2
        while k < len(edges) and edges[k][0][1] <= lo:
            active.append(edges[k])
            k += 1
        active = [e for e in active if e[1][1] >= hi]
        within = sorted(active, key=lambda e: at(e, mid))
        for e, f in zip(within[::2], within[1::2], strict=False):
            a, b, c, d = (at(e, lo), lo), (at(f, lo), lo), (at(f, hi), hi), (at(e, hi), hi)
            out += [t for t in ((a, b, c), (a, c, d)) if _cross(*t) != 0]
    return out
