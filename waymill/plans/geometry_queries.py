"""Queries of the geometry and formatting functions over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.functions import geometry as g
from waymill.functions import texts
from waymill.plans.registry import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c, r6 = F.col, lambda v: F.round(v, 6)

_NODES = "(SELECT DISTINCT map_name, uid, x, y, z, rotation FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL)"


def nodes(t: Tables) -> DataFrame:
    return t("nodes").select("map_name", "uid", "x", "y", "z", "rotation").distinct().filter("x IS NOT NULL AND y IS NOT NULL")


@R.query(
    f"""SELECT map_name, uid, round(sqrt(x*x + y*y), 6) AS from_origin, x / 2 AS mid_x, y / 2 AS mid_y,
        round(x * cos(rotation) - y * sin(rotation), 6) AS turned_x, round(x * sin(rotation) + y * cos(rotation), 6) AS turned_y,
        x * rotation + y * z AS dot FROM {_NODES}"""
)
def vector_ops(t: Tables) -> DataFrame:
    """Distance, midpoint, rotation and dot product."""
    tx, ty = g.rotate(c("x"), c("y"), c("rotation"))
    mx, my = g.midpoint(F.lit(0.0), F.lit(0.0), c("x"), c("y"))
    return nodes(t).select(
        "map_name", "uid", r6(g.distance(F.lit(0.0), F.lit(0.0), c("x"), c("y"))).alias("from_origin"), mx.alias("mid_x"), my.alias("mid_y"),
        r6(tx).alias("turned_x"), r6(ty).alias("turned_y"), (c("x") * c("rotation") + c("y") * c("z")).alias("dot"),
    )


@R.query(
    f"""SELECT map_name, uid, round(CASE WHEN u <= pi() THEN u ELSE u - 2 * pi() END, 6) AS angle, round((CASE WHEN u <= pi() THEN u ELSE u - 2 * pi() END) * 180 / pi(), 6) AS degrees
        FROM (SELECT *, fmod(fmod(a, 2 * pi()) + 2 * pi(), 2 * pi()) AS u FROM (SELECT *, rotation * 7 - x / 997 AS a FROM {_NODES}))"""
)
def normalize_angle(t: Tables) -> DataFrame:
    """Angles brought into (-pi, pi] and into degrees."""
    a = c("rotation") * 7 - c("x") / 997
    return nodes(t).select("map_name", "uid", r6(g.normalize_radians(a)).alias("angle"), r6(g.to_degrees(a)).alias("degrees"))


@R.query(
    f"""SELECT map_name, uid, round(atan2(cos(rotation) * y - sin(rotation) * x, cos(rotation) * x + sin(rotation) * y), 5) AS turn FROM {_NODES} WHERE x <> 0 OR y <> 0"""
)
def vector_angle(t: Tables) -> DataFrame:
    """Signed angle between a node's direction and the direction from the origin to it."""
    a = g.angle_between(F.cos("rotation"), F.sin("rotation"), c("x"), c("y"))
    return nodes(t).filter("x <> 0 OR y <> 0").select("map_name", "uid", F.round(a, 5).alias("turn"))


def road_ends(t: Tables) -> DataFrame:
    """Roads with the places and directions of both nodes (first arrival of each node)."""
    from waymill.functions.keys import uid

    first = t("nodes").groupBy("map_name", uid("uid").alias("node")).agg(F.min_by(F.struct("x", "y", "rotation"), F.struct("arrived_at", "x", "y")).alias("p"))
    roads = t("roads").select("map_name", uid("uid").alias("road"), uid("start_node_uid").alias("s"), uid("end_node_uid").alias("e")).distinct()
    a = first.select("map_name", c("node").alias("s"), c("p.x").alias("x0"), c("p.y").alias("y0"), c("p.rotation").alias("r0"))
    b = first.select("map_name", c("node").alias("e"), c("p.x").alias("x1"), c("p.y").alias("y1"), c("p.rotation").alias("r1"))
    return roads.join(a, ["map_name", "s"]).join(b, ["map_name", "e"])


def _u(col: str) -> str:
    tok = f"nullif(lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g')), '')"
    return f"coalesce(nullif(regexp_extract({tok}, '^(0x)?0*([0-9a-f]{{1,16}})$', 2), ''), {tok})"


_ENDS = f"""n AS (SELECT map_name, {_u("uid")} AS node, arg_min({{'x': x, 'y': y, 'r': rotation}}, (arrived_at, x, y)) AS p FROM nodes GROUP BY ALL),
rd AS (SELECT DISTINCT map_name, {_u("uid")} AS road, {_u("start_node_uid")} AS s, {_u("end_node_uid")} AS e FROM roads),
ends AS (SELECT rd.map_name, road, a.p.x AS x0, a.p.y AS y0, a.p.r AS r0, b.p.x AS x1, b.p.y AS y1, b.p.r AS r1 FROM rd
  JOIN n a ON a.map_name = rd.map_name AND a.node = rd.s JOIN n b ON b.map_name = rd.map_name AND b.node = rd.e)"""


@R.query(
    f"""WITH {_ENDS}, st AS (SELECT *, sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) AS d, least(8, CAST(floor(abs(tan(r0 - r1)) * 20) AS INT) + 1) AS n FROM ends),
    i AS (SELECT *, unnest(range(0, n + 1)) AS k FROM st), q AS (SELECT *, k::DOUBLE / n AS t FROM i)
    SELECT map_name, road, k::INT AS k, round((2*t*t*t - 3*t*t + 1)*x0 + (t*t*t - 2*t*t + t)*cos(r0)*d + (-2*t*t*t + 3*t*t)*x1 + (t*t*t - t*t)*cos(r1)*d, 4) AS x,
      round((2*t*t*t - 3*t*t + 1)*y0 + (t*t*t - 2*t*t + t)*sin(r0)*d + (-2*t*t*t + 3*t*t)*y1 + (t*t*t - t*t)*sin(r1)*d, 4) AS y FROM q"""
)
def spline_points(t: Tables) -> DataFrame:
    """Points of every road's Hermite curve."""
    pts = g.spline(c("x0"), c("y0"), c("r0"), c("x1"), c("y1"), c("r1"))
    out = road_ends(t).select("map_name", "road", F.posexplode(pts).alias("k", "p"))
    return out.select("map_name", "road", "k", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@R.query(
    f"""WITH {_ENDS}, st AS (SELECT *, sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) AS d FROM ends),
    i AS (SELECT *, unnest(range(0, 5)) AS k FROM st), q AS (SELECT *, k / 4.0::DOUBLE AS t FROM i),
    p AS (SELECT map_name, road, k, (2*t*t*t - 3*t*t + 1)*x0 + (t*t*t - 2*t*t + t)*cos(r0)*d + (-2*t*t*t + 3*t*t)*x1 + (t*t*t - t*t)*cos(r1)*d AS x,
      (2*t*t*t - 3*t*t + 1)*y0 + (t*t*t - 2*t*t + t)*sin(r0)*d + (-2*t*t*t + 3*t*t)*y1 + (t*t*t - t*t)*sin(r1)*d AS y FROM q),
    l AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY map_name, road ORDER BY k))
    SELECT map_name, road, round(sum(sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y))), 3) AS length FROM l WHERE nx IS NOT NULL GROUP BY ALL"""
)
def polyline_lengths(t: Tables) -> DataFrame:
    """Length of every road's curve cut into four parts."""
    pts = g.spline(c("x0"), c("y0"), c("r0"), c("x1"), c("y1"), c("r1"), F.lit(4))
    return road_ends(t).select("map_name", "road", F.round(g.polyline_length(pts), 3).alias("length"))


def _lcc_sql(p: g.MapProjection) -> tuple[str, str]:
    """Inverse projection of columns px, py as SQL, its constants from the textbook formulas."""
    k = p.cone
    rho = f"sqrt(pow(px * {p.factor_x!r} * {p.degree!r}, 2) + pow({k.rho0!r} - py * {p.factor_y!r} * {p.degree!r}, 2))"
    lat = f"degrees(2 * atan(pow({k.radius * k.f!r} / {rho}, {1 / k.n!r})) - pi() / 2)"
    lon = f"degrees(atan2(px * {p.factor_x!r} * {p.degree!r}, {k.rho0!r} - py * {p.factor_y!r} * {p.degree!r}) / {k.n!r}) + {k.lon0}"
    return lon, lat


_USA, _EUROPE = _lcc_sql(g.PROJECTIONS["usa"]), _lcc_sql(g.PROJECTIONS["europe"])
_UK = "(floor(x / 4000) <= -8 AND floor(y / 4000) <= -2 AND NOT (floor(x / 4000) = -8 AND floor(y / 4000) = -2))"
_LONLAT = f"""SELECT *, CASE map_name WHEN 'usa' THEN {_USA[0]} WHEN 'europe' THEN {_EUROPE[0]} END AS lon, CASE map_name WHEN 'usa' THEN {_USA[1]} WHEN 'europe' THEN {_EUROPE[1]} END AS lat
  FROM (SELECT *, CASE WHEN map_name = 'usa' THEN x WHEN {_UK} THEN (x - 16660 - 15550) * 0.75 ELSE x - 16660 END AS px,
    CASE WHEN map_name = 'usa' THEN y WHEN {_UK} THEN (y - 4150 - 2750) * 0.75 ELSE y - 4150 END AS py FROM {_NODES})"""


@R.query(f"SELECT map_name, uid, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ({_LONLAT})")
def lcc_forward(t: Tables) -> DataFrame:
    """Nodes in degrees."""
    lon, lat = g.lon_lat(c("map_name"), c("x"), c("y"))
    return nodes(t).select("map_name", "uid", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@R.query(f"SELECT map_name, uid, floor(x * 256 + 0.5) / 256 AS x, floor(y * 256 + 0.5) / 256 AS y FROM {_NODES}")
def lcc_roundtrip(t: Tables) -> DataFrame:
    """Nodes projected to degrees and back stay where they are."""
    out = []
    for name, p in g.PROJECTIONS.items():
        own = nodes(t).filter(c("map_name") == name)
        x, y = p.from_degrees(*p.to_degrees(c("x"), c("y")))
        out.append(own.select("map_name", "uid", (F.floor(x * 256 + 0.5) / 256).alias("x"), (F.floor(y * 256 + 0.5) / 256).alias("y")))
    return out[0].unionByName(out[1])


@R.query(f"SELECT map_name, uid, floor(lon * 1000 + 0.5) / 1000 AS lon, floor(lat * 1000 + 0.5) / 1000 AS lat FROM ({_LONLAT})")
def rounded_features(t: Tables) -> DataFrame:
    """Coordinates of features rounded to three places, halves up."""
    lon, lat = g.lon_lat(c("map_name"), c("x"), c("y"))
    return nodes(t).select("map_name", "uid", g.half_up(lon, 3).alias("lon"), g.half_up(lat, 3).alias("lat"))


@R.query(
    f"""SELECT map_name, uid, round(2 * 6371008.8 * atan2(sqrt(a), sqrt(1 - a)), 2) AS metres,
      round(degrees(atan2(sin(radians(10 - lon)) * cos(radians(45)), cos(radians(lat)) * sin(radians(45)) - sin(radians(lat)) * cos(radians(45)) * cos(radians(10 - lon)))), 5) AS bearing
      FROM (SELECT *, pow(sin(radians(45 - lat) / 2), 2) + pow(sin(radians(10 - lon) / 2), 2) * cos(radians(lat)) * cos(radians(45)) AS a FROM ({_LONLAT}))"""
)
def great_circles(t: Tables) -> DataFrame:
    """Distance and bearing from every node to one place."""
    lon, lat = g.lon_lat(c("map_name"), c("x"), c("y"))
    here = nodes(t).select("map_name", "uid", lon.alias("lon"), lat.alias("lat"))
    return here.select(
        "map_name", "uid", F.round(g.great_circle(c("lon"), c("lat"), F.lit(10.0), F.lit(45.0)), 2).alias("metres"),
        F.round(g.bearing(c("lon"), c("lat"), F.lit(10.0), F.lit(45.0)), 5).alias("bearing"),
    )


@R.query(
    f"""SELECT map_name, uid, ['N','NE','E','SE','S','SW','W','NW'][CAST((floor((deg + 22.5) / 45) % 8 + 8) % 8 AS INT) + 1] AS point,
      CASE WHEN abs(rd) <= 2 THEN 'through' WHEN abs(rd) <= 70 THEN 'slight' WHEN abs(rd) <= 110 THEN 'turn' WHEN abs(rd) <= 160 THEN 'sharp' ELSE 'u_turn' END
      || CASE WHEN abs(rd) <= 2 OR abs(rd) > 160 THEN '' WHEN rd < 0 THEN '_left' ELSE '_right' END AS turn
      FROM (SELECT *, floor(deg + 0.5) AS rd FROM (SELECT *, (CASE WHEN u <= pi() THEN u ELSE u - 2*pi() END) * 180 / pi() AS deg FROM (SELECT *, fmod(fmod(rotation, 2*pi()) + 2*pi(), 2*pi()) AS u FROM {_NODES} WHERE rotation IS NOT NULL)))"""
)
def compass_and_turns(t: Tables) -> DataFrame:
    """Compass point and turn class of every node's direction."""
    return nodes(t).filter("rotation IS NOT NULL").select("map_name", "uid", g.compass_point(g.to_degrees(c("rotation"))).alias("point"), g.turn_class(c("rotation")).alias("turn"))


@R.query(
    f"""WITH {_ENDS} SELECT map_name, road, round(CASE WHEN l2 = 0 THEN 0 ELSE least(1, greatest(0, (-x0*dx - y0*dy) / l2)) END, 6) AS at,
      round(sqrt(pow(x0 + (CASE WHEN l2 = 0 THEN 0 ELSE least(1, greatest(0, (-x0*dx - y0*dy) / l2)) END) * dx, 2) + pow(y0 + (CASE WHEN l2 = 0 THEN 0 ELSE least(1, greatest(0, (-x0*dx - y0*dy) / l2)) END) * dy, 2)), 4) AS away
      FROM (SELECT *, x1-x0 AS dx, y1-y0 AS dy, (x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) AS l2 FROM ends)"""
)
def nearest_on_segment(t: Tables) -> DataFrame:
    """Where each road's straight line comes nearest to the origin."""
    args = (F.lit(0.0), F.lit(0.0), c("x0"), c("y0"), c("x1"), c("y1"))
    return road_ends(t).select("map_name", "road", r6(g.segment_position(*args)).alias("at"), F.round(g.segment_distance(*args), 4).alias("away"))


@R.query(
    f"""WITH {_ENDS} SELECT map_name, road, round(cos(r0 - atan2(y1 - y0, x1 - x0)) * exp(-sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) / 20), 6) AS score,
      (x1 - x0) * cos(r0) + (y1 - y0) * sin(r0) >= 0 AS ahead FROM ends"""
)
def heading_scores(t: Tables) -> DataFrame:
    """How well a start node's direction fits its road, weighted by the road's length, and whether the end lies ahead."""
    line = F.atan2(c("y1") - c("y0"), c("x1") - c("x0"))
    ahead = (c("x1") - c("x0")) * F.cos("r0") + (c("y1") - c("y0")) * F.sin("r0") >= 0
    return road_ends(t).select("map_name", "road", r6(g.heading_score(c("r0"), line, g.distance(c("x0"), c("y0"), c("x1"), c("y1")))).alias("score"), ahead.alias("ahead"))


@R.query(
    f"""SELECT map_name, uid, x + (y - x) * 0.25 AS mid, x + z * 0.5 AS ahead, least(greatest(x, -100.0), 100.0) AS held,
      round(((a + (b - a - floor(b - a + 0.5)) * 0.5) - floor(a + (b - a - floor(b - a + 0.5)) * 0.5)), 6) AS turn, round(abs(x) / (30 * 0.44704), 4) AS seconds
      FROM (SELECT *, abs(x) / 1000 - floor(abs(x) / 1000) AS a, abs(y) / 1000 - floor(abs(y) / 1000) AS b FROM {_NODES} WHERE z IS NOT NULL)"""
)
def interpolation_functions(t: Tables) -> DataFrame:
    """Linear and circular interpolation, dead reckoning, clamping, travel time."""
    a, b = (F.abs(c(k)) / 1000 - F.floor(F.abs(c(k)) / 1000) for k in "xy")
    return nodes(t).filter("z IS NOT NULL").select(
        "map_name", "uid", g.lerp(c("x"), c("y"), F.lit(0.25)).alias("mid"), g.extrapolate(c("x"), c("z"), F.lit(0.5)).alias("ahead"),
        g.clamp(c("x"), -100, 100).alias("held"), r6(g.lerp_turns(a, b, F.lit(0.5))).alias("turn"), F.round(g.travel_seconds(F.abs(c("x")), F.lit(30.0)), 4).alias("seconds"),
    )


@R.query(
    f"""WITH {_ENDS}, b AS (SELECT *, unnest([{{'i': 0, 'cx': -2.0, 'cy': -1.0}}, {{'i': 1, 'cx': 2.0, 'cy': -1.0}}, {{'i': 2, 'cx': 2.0, 'cy': 1.0}}, {{'i': 3, 'cx': -2.0, 'cy': 1.0}}, {{'i': 4, 'cx': -2.0, 'cy': -1.0}}]) AS k FROM ends)
    SELECT map_name, road, k.i AS corner, round(x0 + k.cx * 1.5 * cos(r0 - pi()/2) - k.cy * 2 * sin(r0 - pi()/2), 4) AS x, round(y0 + k.cx * 1.5 * sin(r0 - pi()/2) + k.cy * 2 * cos(r0 - pi()/2), 4) AS y FROM b"""
)
def footprints(t: Tables) -> DataFrame:
    """Footprint of a box standing at each road's start."""
    one = lambda v: F.lit(float(v))
    box = g.footprint(c("x0"), c("y0"), c("r0"), one(-2), one(-1), one(2), one(1), one(1.5), one(2))
    return road_ends(t).select("map_name", "road", F.posexplode(box).alias("corner", "p")).select("map_name", "road", "corner", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


_SIG = "(CASE WHEN {v} = 0 THEN 0 ELSE floor({v} * pow(10, {d} - 1 - floor(log10(abs({v})))) + 0.5) / pow(10, {d} - 1 - floor(log10(abs({v})))) END)"


@R.query(
    f"""SELECT p_partkey, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
      CASE WHEN m <= 1000 THEN format('{{:,}}', CAST(CASE WHEN m <= 100 THEN floor({_SIG.format(v="m", d=1)} / 10 + 0.5) * 10 WHEN m <= 200 THEN {_SIG.format(v="m", d=2)} ELSE {_SIG.format(v="(floor(m / 50 + 0.5) * 50)", d=2)} END AS BIGINT)) || ' m'
        ELSE CAST(CAST(floor(m / 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' km' END AS metric,
      CASE WHEN s >= 3600 THEN (s // 3600) || ' hr ' ELSE '' END || CAST(ceil((s % 3600) / 60.0) AS BIGINT) || ' min' AS lasting
      FROM (SELECT *, floor(p_retailprice + 0.5) AS m, p_partkey * 37 AS s FROM part)"""
)
def formatted_quantities(t: Tables) -> DataFrame:
    """Ordinals, metric lengths and durations as texts."""
    return t("part").select("p_partkey", texts.ordinal(c("p_size")).alias("nth"), texts.metric_length(c("p_retailprice")).alias("metric"), texts.duration_text(c("p_partkey") * 37).alias("lasting"))


@R.query(
    f"""SELECT map_name, uid, CASE WHEN mph > 60 THEN 11 WHEN mph > 30 THEN 12 ELSE 13 END AS zoom, CASE WHEN mph > 60 THEN 30 WHEN mph > 30 THEN 45 ELSE 50 END AS pitch FROM (SELECT *, abs(z) AS mph FROM {_NODES})"""
)
def camera_tiers(t: Tables) -> DataFrame:
    """Zoom and pitch by tiers of a speed."""
    v = F.abs(c("z"))
    return nodes(t).select("map_name", "uid", F.when(v > 60, 11).when(v > 30, 12).otherwise(13).alias("zoom"), F.when(v > 60, 30).when(v > 30, 45).otherwise(50).alias("pitch"))


@R.query(
    f"""SELECT map_name, uid, CASE WHEN x BETWEEN -1000 AND 1000 AND y BETWEEN -1000 AND 1000 THEN 'inner' WHEN x BETWEEN -1500 AND 1500 AND y BETWEEN -1500 AND 1500 THEN 'grown' ELSE 'outside' END AS zone FROM {_NODES}"""
)
def box_zones(t: Tables) -> DataFrame:
    """Containment in a box and in the box grown by 500."""
    box = [F.lit(float(v)) for v in (-1000, -1000, 1000, 1000)]
    grown = [box[0] - 500, box[1] - 500, box[2] + 500, box[3] + 500]
    zone = F.when(g.within(c("x"), c("y"), *box), "inner").when(g.within(c("x"), c("y"), *grown), "grown").otherwise("outside")
    return nodes(t).select("map_name", "uid", zone.alias("zone"))


@R.query(
    f"""WITH {_ENDS} SELECT map_name, road, round(x0 - sin(a) * 4.5, 4) AS x0, round(y0 + cos(a) * 4.5, 4) AS y0, round(x1 - sin(a) * 4.5, 4) AS x1, round(y1 + cos(a) * 4.5, 4) AS y1
      FROM (SELECT *, atan2(y1 - y0, x1 - x0) AS a FROM ends WHERE x0 <> x1 OR y0 <> y1)"""
)
def parallel_roads(t: Tables) -> DataFrame:
    """Straight roads moved sideways by half a road's width."""
    a, off = F.atan2(c("y1") - c("y0"), c("x1") - c("x0")), 4.5
    moved = {"x0": c("x0") - F.sin(a) * off, "y0": c("y0") + F.cos(a) * off, "x1": c("x1") - F.sin(a) * off, "y1": c("y1") + F.cos(a) * off}
    return road_ends(t).filter("x0 <> x1 OR y0 <> y1").select("map_name", "road", *[F.round(v, 4).alias(k) for k, v in moved.items()])


def sun_altitude(lat: Column, lon: Column, day_of_year: Column, utc_hours: Column) -> Column:
    """Altitude of the sun in degrees (declination and hour angle, no refraction)."""
    decl = -23.44 * F.cos(2 * math.pi / 365 * (day_of_year + 10))
    hour = (utc_hours - 12) * 15 + lon
    up = F.sin(F.radians(lat)) * F.sin(F.radians(decl)) + F.cos(F.radians(lat)) * F.cos(F.radians(decl)) * F.cos(F.radians(hour))
    return F.degrees(F.asin(g.clamp(up, -1, 1)))


@R.query(
    f"""SELECT map_name, uid, CASE WHEN sin(radians(lat)) * sin(radians(decl)) + cos(radians(lat)) * cos(radians(decl)) * cos(radians((hour - 12) * 15 + lon)) > 0 THEN 'light' ELSE 'dark' END AS theme
      FROM (SELECT *, -23.44 * cos(2 * pi() / 365 * 182) AS decl, floor(abs(z)) % 24 AS hour FROM ({_LONLAT}) WHERE z IS NOT NULL)"""
)
def sun_theme(t: Tables) -> DataFrame:
    """Light or dark by the sun's altitude on a fixed day in June."""
    lon, lat = g.lon_lat(c("map_name"), c("x"), c("y"))
    own = nodes(t).filter("z IS NOT NULL").select("map_name", "uid", "z", lon.alias("lon"), lat.alias("lat"))
    high = sun_altitude(c("lat"), c("lon"), F.lit(172), F.floor(F.abs("z")) % 24)
    return own.select("map_name", "uid", F.when(high > 0, "light").otherwise("dark").alias("theme"))
