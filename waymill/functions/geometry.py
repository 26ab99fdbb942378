"""Plane and sphere geometry as column expressions; everything stays inside code generation.

Points are pairs of columns; polylines are arrays of struct<x, y>. Angles are in radians unless a name says degrees.
Null in gives null out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
EARTH_M = 6_371_008.8


def num(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def midpoint(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def normalize_radians(a: Column) -> Column:
    """Into (-pi, pi]."""
    turn = 2 * PI
    up = (a % turn + turn) % turn
    return F.when(up <= PI, up).otherwise(up - turn)


def to_radians(degrees: Column) -> Column:
    return normalize_radians(degrees * PI / 180)


def to_degrees(radians: Column) -> Column:
    return normalize_radians(radians) * 180 / PI


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed angle from direction a to direction b, clockwise positive where y points down."""
    base = -F.atan2(ay, ax)
    rx, ry = rotate(bx, by, base)
    return normalize_radians(F.atan2(ry, rx))


def spline_steps(r0: Column, r1: Column) -> Column:
    return F.least(F.lit(8), (F.floor(F.abs(F.tan(r0 - r1)) * 20) + 1).cast("int"))


def spline(x0: Column, y0: Column, r0: Column, x1: Column, y1: Column, r1: Column, steps: Column | None = None) -> Column:
    """Cubic Hermite curve between two placed directions whose tangents are as long as the chord."""
    chord = distance(x0, y0, x1, y1)
    n = spline_steps(r0, r1) if steps is None else steps

    def at(i: Column) -> Column:
        t = i.cast("double") / n
        t2, t3 = t * t, t * t * t
        a, b, c, d = 2 * t3 - 3 * t2 + 1, t3 - 2 * t2 + t, -2 * t3 + 3 * t2, t3 - t2
        return F.struct(
            (a * x0 + b * F.cos(r0) * chord + c * x1 + d * F.cos(r1) * chord).alias("x"),
            (a * y0 + b * F.sin(r0) * chord + c * y1 + d * F.sin(r1) * chord).alias("y"),
        )

    return F.transform(F.sequence(F.lit(0), n), at)


def polyline_length(points: Column) -> Column:
    """Sum of the lengths of a polyline's parts; 0 below two points."""
    ahead = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    part = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), ahead, lambda p, q: distance(p["x"], p["y"], q["x"], q["y"]))
    return F.aggregate(part, F.lit(0.0), lambda a, v: a + v)


def within(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Inclusive containment in a box."""
    return (x0 <= x) & (x <= x1) & (y0 <= y) & (y <= y1)


def half_up(v: Column, places: int) -> Column:
    """Rounding with halves towards positive infinity."""
    f = 10.0**places
    return F.floor(v * f + 0.5) / f


@dataclass(frozen=True)
class Lambert:
    """Spherical Lambert conformal conic, as expressions over columns in degrees and metres."""

    parallel1: float
    parallel2: float
    lat0: float
    lon0: float
    radius: float = 6_370_997.0

    @property
    def n(self) -> float:
        p, q = math.radians(self.parallel1), math.radians(self.parallel2)
        return math.log(math.cos(p) / math.cos(q)) / math.log(math.tan(PI / 4 + q / 2) / math.tan(PI / 4 + p / 2))

    @property
    def f(self) -> float:
        p = math.radians(self.parallel1)
        return math.cos(p) * math.tan(PI / 4 + p / 2) ** self.n / self.n

    @property
    def rho0(self) -> float:
        return self.radius * self.f / math.tan(PI / 4 + math.radians(self.lat0) / 2) ** self.n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        rho = self.radius * self.f / F.pow(F.tan(PI / 4 + F.radians(lat) / 2), F.lit(self.n))
        theta = self.n * (F.radians(lon) - math.radians(self.lon0))
        return rho * F.sin(theta), self.rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        up = self.rho0 - y
        rho = F.sqrt(x * x + up * up)
        lat = 2 * F.atan(F.pow(self.radius * self.f / rho, F.lit(1 / self.n))) - PI / 2
        return F.degrees(F.atan2(x, up) / self.n) + self.lon0, F.degrees(lat)


@dataclass(frozen=True)
class MapProjection:
    """Game units to degrees: factors of a degree's length, an offset, and an optional corner drawn at another scale."""

    cone: Lambert
    factor_x: float
    factor_y: float
    offset: tuple[float, float] = (0.0, 0.0)
    corner: tuple[float, float] | None = None
    scale: float = 1.0

    @property
    def degree(self) -> float:
        return self.cone.radius * PI / 180

    def _in_corner(self, x: Column, y: Column) -> Column:
        """West of the eighth and north of the second sector of 4,000 units, without the sector where both meet."""
        sx, sy = F.floor(x / 4000), F.floor(y / 4000)
        return (sx <= -8) & (sy <= -2) & ~((sx == -8) & (sy == -2))

    def to_degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        px, py = x - self.offset[0], y - self.offset[1]
        if self.corner:
            inside = self._in_corner(x, y)
            px = F.when(inside, (px + self.corner[0] / 2) * self.scale).otherwise(px)
            py = F.when(inside, (py + self.corner[1] / 2) * self.scale).otherwise(py)
        return self.cone.inverse(px * self.factor_x * self.degree, py * self.factor_y * self.degree)

    def from_degrees(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        lx, ly = self.cone.forward(lon, lat)
        px, py = lx / self.factor_x / self.degree, ly / self.factor_y / self.degree
        if self.corner:
            qx, qy = px / self.scale - self.corner[0] / 2, py / self.scale - self.corner[1] / 2
            inside = self._in_corner(qx + self.offset[0], qy + self.offset[1])
            px, py = F.when(inside, qx).otherwise(px), F.when(inside, qy).otherwise(py)
        return F.round(px + self.offset[0], 10), F.round(py + self.offset[1], 10)


#: Fixed values of the two maps' projections.
PROJECTIONS = {
    "usa": MapProjection(Lambert(33, 45, 39, -96), 0.000176689948, -0.00017706234),
    "europe": MapProjection(Lambert(37, 65, 50, 15), 0.0001729241463, -0.000171570875, (16660.0, 4150.0), (-31100.0, -5500.0), 0.75),
}


def lon_lat(map_name: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of map positions; null for a map without a projection."""
    both = {m: p.to_degrees(x, y) for m, p in PROJECTIONS.items()}
    pick = lambda i: F.coalesce(*[F.when(map_name == m, v[i]) for m, v in both.items()])
    return pick(0), pick(1)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two places."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.pow(F.sin(dlon / 2), F.lit(2)) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees, (-180, 180], clockwise from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def clamp(v: Column, lo: float | Column, hi: float | Column) -> Column:
    return F.least(F.greatest(v, num(lo)), num(hi))


def segment_position(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where along a segment, from 0 to 1, the point nearest to p lies; 0 on a segment of no length."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    return F.when(length2 == 0, 0.0).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / length2, 0, 1))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_position(px, py, ax, ay, bx, by)
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def heading_score(heading: Column, line_heading: Column, metres: Column, decay: float = 20.0) -> Column:
    """Alignment of two headings, weighted down with the distance."""
    return F.cos(normalize_radians(heading - line_heading)) * F.exp(-metres / decay)


#: The eight compass points, clockwise from north.
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def compass_point(degrees: Column) -> Column:
    at = F.pmod(F.floor((degrees + 22.5) / 45), F.lit(8)).cast("int")
    return F.array(*map(F.lit, COMPASS))[at]


#: Upper bounds in degrees of the classes a turn falls in.
TURNS = ((2, "through"), (70, "slight"), (110, "turn"), (160, "sharp"), (180, "u_turn"))


def turn_class(radians: Column) -> Column:
    """Side and class of a turn; degrees are rounded first."""
    deg = F.floor(to_degrees(radians) + 0.5)
    size = F.coalesce(*[F.when(F.abs(deg) <= most, name) for most, name in TURNS])
    return F.when(size.isin("through", "u_turn"), size).otherwise(F.concat(size, F.when(deg < 0, "_left").otherwise("_right")))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def lerp_turns(a: Column, b: Column, t: Column) -> Column:
    """Between two headings in unit turns, the shorter way round, into [0, 1)."""
    d = b - a
    short = d - F.floor(d + 0.5)
    return F.pmod(a + short * t, F.lit(1.0))


def extrapolate(v: Column, speed: Column, seconds: Column) -> Column:
    """Dead reckoning."""
    return v + speed * seconds


def travel_seconds(metres: Column, mph: Column) -> Column:
    return metres / (mph * 0.44704)


def footprint(x: Column, y: Column, yaw: Column, x0: Column, y0: Column, x1: Column, y1: Column, sx: Column, sy: Column) -> Column:
    """Corners of a scaled box turned by its yaw less a quarter turn and set down at a place."""
    corners = ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
    out = []
    for cx, cy in corners:
        rx, ry = rotate(cx * sx, cy * sy, yaw - PI / 2)
        out.append(F.struct((x + rx).alias("x"), (y + ry).alias("y")))
    return F.array(*out)
