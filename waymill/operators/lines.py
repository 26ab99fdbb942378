"""Line operators on arrays of points, in Arrow batches: encoding, simplifying, moving aside, cutting, crossing.

A line is an array of struct<x, y>. Lines with fewer than two points come out as they are.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

Line = list[tuple[float, float]]
_POINTS = "array<struct<x double, y double>>"


def encode(line: Line, precision: int = 5) -> str:
    """Differences of scaled coordinates (y first) in printable chunks of five bits."""
    out, before = [], (0, 0)
    for x, y in line:
        now = (math.floor(y * 10**precision + 0.5), math.floor(x * 10**precision + 0.5))
        for a, b in zip(now, before, strict=True):
            v = (a - b) << 1
            v = ~v if a < b else v
            while v >= 0x20:
                out.append(chr((0x20 | v & 0x1F) + 63))
                v >>= 5
            out.append(chr(v + 63))
        before = now
    return "".join(out)


def decode(text: str, precision: int = 5) -> Line:
    values, v, shift = [], 0, 0
    for ch in text:
        part = ord(ch) - 63
        v |= (part & 0x1F) << shift
        shift += 5
        if part < 0x20:
            values.append(~(v >> 1) if v & 1 else v >> 1)
            v = shift = 0
    out, x, y = [], 0, 0
    for dy, dx in zip(values[::2], values[1::2], strict=True):
        y, x = y + dy, x + dx
        out.append((x / 10**precision, y / 10**precision))
    return out


def _off(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def simplify(line: Line, tolerance: float) -> Line:
    """Points without which the line would stray by more than the tolerance; the ends stay."""
    if len(line) < 3:
        return line
    keep, spans = {0, len(line) - 1}, [(0, len(line) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        far, d = max(((i, _off(line[i], line[a], line[b])) for i in range(a + 1, b)), key=lambda v: (v[1], -v[0]))
        if d > tolerance:
            keep.add(far)
            spans += [(a, far), (far, b)]
    return [line[i] for i in sorted(keep)]


def offset(line: Line, aside: float) -> Line:
    """The line moved aside, to the right of its way where y points down; corners meet on their bisector."""
    pts = [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
    if len(pts) < 2:
        return line
    normals = []
    for a, b in zip(pts, pts[1:], strict=False):
        n = math.hypot(b[0] - a[0], b[1] - a[1])
        normals.append((-(b[1] - a[1]) / n, (b[0] - a[0]) / n))
    out = []
    for i, p in enumerate(pts):
        u, v = normals[max(i - 1, 0)], normals[min(i, len(normals) - 1)]
        m = (u[0] + v[0], u[1] + v[1])
        size = m[0] * m[0] + m[1] * m[1]
        k = 1.0 if size < 1e-9 else min(2 / size, 4.0)  # a hairpin is cut off
        m = v if size < 1e-9 else m
        out.append((p[0] + m[0] * k * aside, p[1] + m[1] * k * aside))
    return out


def chunk(line: Line, length: float) -> list[Line]:
    """Parts of at most that length, cut where they reach it."""
    out, part, room = [], line[:1], length
    for a, b in zip(line, line[1:], strict=False):
        d = math.hypot(b[0] - a[0], b[1] - a[1])
        while d > room:
            t = room / d
            a = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
            out.append([*part, a])
            part, d, room = [a], d - room, length
        part.append(b)
        room -= d
    return [*out, part] if len(part) > 1 or not out else out


def crossing(a: Line, b: Line) -> tuple[float, float] | None:
    """The first point, along a, at which two lines cross."""
    for p, q in zip(a, a[1:], strict=False):
        best = None
        for r, s in zip(b, b[1:], strict=False):
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if d == 0:
                continue
            t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
            u = ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / d
            if 0 <= t <= 1 and 0 <= u <= 1 and (best is None or t < best):
                best = t
        if best is not None:
            return p[0] + best * (q[0] - p[0]), p[1] + best * (q[1] - p[1])
    return None


def _line(v) -> Line | None:
    return None if v is None else [(p["x"], p["y"]) for p in v]


def _rows(line: Line | None):
    return None if line is None else [{"x": float(x), "y": float(y)} for x, y in line]


def encoded(column, precision: int = 5):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else encode(_line(v), precision))

    return run(column)


def decoded(column, precision: int = 5):
    @F.pandas_udf(_POINTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else _rows(decode(v, precision)))

    return run(column)


def simplified(column, tolerance: float):
    @F.pandas_udf(_POINTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else _rows(simplify(_line(v), tolerance)))

    return run(column)


def moved(column, aside: float):
    @F.pandas_udf(_POINTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else _rows(offset(_line(v), aside)))

    return run(column)
