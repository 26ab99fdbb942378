"""Queries of the spatial joins over whole tables.

Sums of the keys' squares on the tables' own positions; where a plain table has none, its key is spread over a grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.geometry import distance
from waymill.functions.keys import uid
from waymill.operators import spatial
from waymill.plans.geometry_queries import _ENDS, _u, road_ends
from waymill.plans.problems import entry_positions, guard_positions
from waymill.plans.registry import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col


def grid(df: DataFrame, key: str, *more: str) -> DataFrame:
    """Keys spread over a grid of 10,007 units."""
    return df.select(c(key).alias("id"), (c(key) * 7919 % 10007).cast("double").alias("x"), (c(key) * 104729 % 10007).cast("double").alias("y"), *more)


def _grid(table: str, key: str, more: str = "") -> str:
    return f"(SELECT {key} AS id, CAST({key} * 7919 % 10007 AS DOUBLE) AS x, CAST({key} * 104729 % 10007 AS DOUBLE) AS y {more} FROM {table})"


_CUST, _SUPP, _PART = _grid("customer", "c_custkey", ", c_nationkey AS nation"), _grid("supplier", "s_suppkey", ", s_nationkey AS nation"), _grid("part", "p_partkey")
_POINTS = """(SELECT DISTINCT map_name, point_id AS id, x / CASE WHEN fixed_point THEN 256.0 ELSE 1.0 END AS x, y / CASE WHEN fixed_point THEN 256.0 ELSE 1.0 END AS y, dlc_guard
  FROM guard_points WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y))"""
_OPEN = f"{_POINTS[:-1]} AND dlc_guard IS NULL)"


def customers(t: Tables) -> DataFrame:
    return grid(t("customer"), "c_custkey", c("c_nationkey").alias("nation"))


def suppliers(t: Tables) -> DataFrame:
    return grid(t("supplier"), "s_suppkey", c("s_nationkey").alias("nation"))


def points(t: Tables) -> DataFrame:
    return spatial.placed(guard_positions(t("guard_points"))).withColumnRenamed("world", "map_name").distinct()


_DIST = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))"


@R.query(
    f"""WITH p AS (SELECT a.id, a.nation, b.id AS p_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM {_SUPP} a JOIN {_CUST} b ON a.nation = b.nation)
    SELECT n_name, count(*) AS suppliers, round(sum(d), 3) AS total, CAST(sum(p_id) AS BIGINT) AS ids FROM p JOIN nation ON n_nationkey = nation WHERE k = 1 GROUP BY 1"""
)
def nn_same_country(t: Tables) -> DataFrame:
    """For each supplier the nearest customer of its nation, summed up by nation."""
    near = spatial.knn_join(suppliers(t), customers(t), by=("nation",))
    own = near.join(t("supplier"), near["q_id"] == c("s_suppkey")).join(t("nation"), c("s_nationkey") == c("n_nationkey"))
    return own.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("d"), 3).alias("total"), F.sum("p_id").alias("ids"))


@R.query(
    f"""SELECT q_id, p_id, round(d, 4) AS d, CAST(k AS INT) AS rank FROM (SELECT a.id AS q_id, b.id AS p_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM {_SUPP} a, {_CUST} b WHERE {_DIST} <= 500) WHERE k <= 3"""
)
def knn3_radius(t: Tables) -> DataFrame:
    """The three nearest customers of each supplier within a radius."""
    return spatial.knn_join(suppliers(t), customers(t), k=3, radius=500.0).select("q_id", "p_id", F.round("d", 4).alias("d"), "rank")


@R.query(
    f"""SELECT q_id, p_id, round(d, 4) AS d FROM (SELECT a.id AS q_id, b.id AS p_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM {_CUST} a, {_SUPP} b) WHERE k = 1"""
)
def nn_unbounded(t: Tables) -> DataFrame:
    """The nearest supplier of each customer, however far."""
    return spatial.knn_join(customers(t), suppliers(t)).select("q_id", "p_id", F.round("d", 4).alias("d"))


@R.query(
    f"""SELECT q_id AS point_id, coalesce(own, guard) AS guard FROM (SELECT a.id AS q_id, a.dlc_guard AS own, b.dlc_guard AS guard, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k
      FROM {_OPEN} a JOIN {_POINTS} b ON a.map_name = b.map_name AND b.dlc_guard IS NOT NULL) WHERE k = 1 UNION ALL SELECT id, dlc_guard FROM {_POINTS} WHERE dlc_guard IS NOT NULL"""
)
def guard_backfill(t: Tables) -> DataFrame:
    """A point keeps its own guard, else takes that of the nearest guarded point of its map."""
    own = points(t)
    known = own.filter("dlc_guard IS NOT NULL")
    near = spatial.knn_join(own.filter("dlc_guard IS NULL"), known, by=("map_name",))
    back = near.join(known.select(c("id").alias("p_id"), "dlc_guard"), "p_id").select(c("q_id").alias("point_id"), c("dlc_guard").alias("guard"))
    return back.unionByName(known.select(c("id").alias("point_id"), c("dlc_guard").alias("guard")))


@R.query(
    f"""SELECT a.id, b.s AS box FROM {_PART} a JOIN (SELECT id AS s, x - 100 AS x0, y - 100 AS y0, x + 100 AS x1, y + 100 AS y1 FROM {_SUPP}) b ON a.x BETWEEN x0 AND x1 AND a.y BETWEEN y0 AND y1"""
)
def bbox_contains(t: Tables) -> DataFrame:
    """Every padded supplier box that holds a part."""
    b = suppliers(t).select(c("id").alias("box"), (c("x") - 100).alias("x0"), (c("y") - 100).alias("y0"), (c("x") + 100).alias("x1"), (c("y") + 100).alias("y1"))
    return spatial.box_join(grid(t("part"), "p_partkey"), b, 200.0).select("id", "box")


@R.query(
    f"""SELECT id, arg_min(box, (-size, box)) AS largest FROM (SELECT a.id, b.s AS box, size FROM {_PART} a JOIN (SELECT id AS s, x - 100 - id % 50 AS x0, y - 100 AS y0, x + 100 + id % 50 AS x1, y + 100 AS y1, id % 50 AS size FROM {_SUPP}) b
      ON a.x BETWEEN x0 AND x1 AND a.y BETWEEN y0 AND y1) GROUP BY 1"""
)
def mbr_largest(t: Tables) -> DataFrame:
    """The largest box that holds a part."""
    more = c("id") % 50
    b = suppliers(t).select(c("id").alias("box"), (c("x") - 100 - more).alias("x0"), (c("y") - 100).alias("y0"), (c("x") + 100 + more).alias("x1"), (c("y") + 100).alias("y1"), more.alias("size"))
    met = spatial.box_join(grid(t("part"), "p_partkey"), b, 200.0)
    return met.groupBy("id").agg(F.min_by("box", F.struct(-c("size"), "box")).alias("largest"))


@R.query(
    f"""WITH {_ENDS} SELECT a.map_name, a.road AS l_id, b.road AS r_id FROM (SELECT map_name, road, least(x0,x1) - 1 AS x0, least(y0,y1) - 1 AS y0, greatest(x0,x1) + 1 AS x9, greatest(y0,y1) + 1 AS y9 FROM ends) a
      JOIN (SELECT map_name, road, least(x0,x1) AS x0, least(y0,y1) AS y0, greatest(x0,x1) AS x9, greatest(y0,y1) AS y9 FROM ends) b ON a.map_name = b.map_name AND a.road < b.road AND a.x0 <= b.x9 AND b.x0 <= a.x9 AND a.y0 <= b.y9 AND b.y0 <= a.y9"""
)
def box_overlaps(t: Tables) -> DataFrame:
    """Pairs of roads whose boxes come within one unit."""
    e = road_ends(t)
    box = {"x0": F.least("x0", "x1"), "y0": F.least("y0", "y1"), "x1": F.greatest("x0", "x1"), "y1": F.greatest("y0", "y1")}
    b = e.select("map_name", c("road").alias("id"), *[v.alias(k) for k, v in box.items()])
    a = b.withColumns({"x0": c("x0") - 1, "y0": c("y0") - 1, "x1": c("x1") + 1, "y1": c("y1") + 1})
    keyed = lambda d: d.withColumn("id", F.concat_ws(":", "map_name", "id"))
    met = spatial.overlap_join(keyed(a), keyed(b), 64.0, ("map_name",)).filter("l_id < r_id")
    return met.select(F.split_part("l_id", F.lit(":"), F.lit(1)).alias("map_name"), F.split_part("l_id", F.lit(":"), F.lit(2)).alias("l_id"), F.split_part("r_id", F.lit(":"), F.lit(2)).alias("r_id"))


@R.query(
    f"""SELECT a.id AS l_id, count(*) AS n FROM {_SUPP} a JOIN {_CUST} b ON abs(floor(a.x / 400) - floor(b.x / 400)) <= 1 AND abs(floor(a.y / 400) - floor(b.y / 400)) <= 1 GROUP BY 1"""
)
def sector_3x3(t: Tables) -> DataFrame:
    """How many customers stand in a supplier's sector and the eight around it."""
    return spatial.sector_neighbours(suppliers(t), customers(t), 400.0).groupBy("l_id").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    f"""WITH {_ENDS} SELECT a.map_name, a.road AS l_id, b.road AS r_id FROM ends a JOIN ends b ON a.map_name = b.map_name AND a.road < b.road AND
      ((sqrt(pow(a.x0-b.x0,2)+pow(a.y0-b.y0,2)) <= 2 AND sqrt(pow(a.x1-b.x1,2)+pow(a.y1-b.y1,2)) <= 2) OR (sqrt(pow(a.x0-b.x1,2)+pow(a.y0-b.y1,2)) <= 2 AND sqrt(pow(a.x1-b.x0,2)+pow(a.y1-b.y0,2)) <= 2))"""
)
def endpoint_pairs(t: Tables) -> DataFrame:
    """Roads both of whose ends lie within two units of another road's, either way round."""
    e = road_ends(t)
    starts = e.select("map_name", c("road").alias("id"), c("x0").alias("x"), c("y0").alias("y"))
    both = starts.unionByName(e.select("map_name", c("road").alias("id"), c("x1").alias("x"), c("y1").alias("y")))
    # one end each within the radius is found on a grid of cells, the whole pair is then tested
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    a = starts.withColumn("o", F.explode(o)).select("map_name", c("id").alias("l_id"), (spatial.cell("x", 2.0) + c("o.a")).alias("cx"), (spatial.cell("y", 2.0) + c("o.b")).alias("cy"))
    b = both.select("map_name", c("id").alias("r_id"), spatial.cell("x", 2.0).alias("cx"), spatial.cell("y", 2.0).alias("cy"))
    met = a.join(b, ["map_name", "cx", "cy"]).filter("l_id <> r_id").select("map_name", F.least("l_id", "r_id").alias("l_id"), F.greatest("l_id", "r_id").alias("r_id")).distinct()
    l, r = (e.select("map_name", c("road").alias(f"{m}_id"), *[c(k).alias(f"{m}{k}") for k in ("x0", "y0", "x1", "y1")]) for m in "lr")
    near = lambda i, j: distance(c(f"lx{i}"), c(f"ly{i}"), c(f"rx{j}"), c(f"ry{j}")) <= 2
    met = met.join(l, ["map_name", "l_id"]).join(r, ["map_name", "r_id"])
    return met.filter((near(0, 0) & near(1, 1)) | (near(0, 1) & near(1, 0))).select("map_name", "l_id", "r_id")


_LINE = f"""l AS (SELECT nation AS line, id AS ord, x, y FROM {_SUPP}), s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM l WINDOW w AS (PARTITION BY line ORDER BY ord)),
  g AS (SELECT *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS len FROM s WHERE x2 IS NOT NULL), b AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
  m AS (SELECT line, ord, p.id, before, len, CASE WHEN len = 0 THEN 0 ELSE least(1, greatest(0, ((p.x-b.x)*(x2-b.x) + (p.y-b.y)*(y2-b.y)) / (len*len))) END AS t, p.x AS px, p.y AS py, b.x AS ax, b.y AS ay, x2, y2 FROM b, {_CUST} p),
  d AS (SELECT line, ord, id, before + t * len AS location, sqrt(pow(px - ax - t*(x2-ax), 2) + pow(py - ay - t*(y2-ay), 2)) AS d FROM m)"""


@R.query(f"WITH {_LINE} SELECT line, id, round(min(d), 3) AS d, round(arg_min(location, (d, ord)), 2) AS location FROM d WHERE d <= 80 GROUP BY 1, 2")
def line_proximity(t: Tables) -> DataFrame:
    """Customers within a distance of the lines through each nation's suppliers, and how far along they lie."""
    line = suppliers(t).select(c("nation").alias("line"), c("id").alias("ord"), "x", "y")
    near = spatial.near_lines(customers(t).drop("nation"), line, 80.0)
    return near.select("line", "id", F.round("d", 3).alias("d"), F.round("location", 2).alias("location"))


@R.query(
    f"""WITH {_LINE}, k AS (SELECT line, CAST(floor(before / 20000) AS BIGINT) AS chunk, min(least(x, x2)) - 50 AS x0, min(least(y, y2)) - 50 AS y0, max(greatest(x, x2)) + 50 AS x1, max(greatest(y, y2)) + 50 AS y1 FROM b GROUP BY ALL)
    SELECT DISTINCT line, p.id FROM k JOIN {_PART} p ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1"""
)
def chunked_boxes(t: Tables) -> DataFrame:
    """Parts in the padded boxes of a line cut into chunks, each part once a line."""
    line = suppliers(t).select(c("nation").alias("line"), c("id").alias("ord"), "x", "y")
    s = spatial.segments(line)
    box = s.groupBy("line", F.floor(c("before") / 20_000).alias("chunk")).agg(
        (F.min(F.least("x", "x2")) - 50).alias("x0"), (F.min(F.least("y", "y2")) - 50).alias("y0"), (F.max(F.greatest("x", "x2")) + 50).alias("x1"), (F.max(F.greatest("y", "y2")) + 50).alias("y1")
    )
    return spatial.within_any(grid(t("part"), "p_partkey"), box)


_ENTRIES = """(SELECT DISTINCT map_name, entry_id AS id, start_or_end[1] AS x, start_or_end[2] AS y FROM road_entries WHERE len(start_or_end) = 2 AND start_or_end[1] IS NOT NULL AND start_or_end[2] IS NOT NULL AND NOT isnan(start_or_end[1]) AND NOT isnan(start_or_end[2]))"""


@R.query(
    f"""SELECT map_name, id AS entry_id, p_id AS node, round(d, 4) AS d FROM (SELECT a.map_name, a.id, b.node AS p_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.node) AS k FROM {_ENTRIES} a
      JOIN (SELECT DISTINCT map_name, {_u("uid")} AS node, x, y FROM nodes WHERE x IS NOT NULL) b ON a.map_name = b.map_name AND {_DIST} <= 50) WHERE k = 1"""
)
def waypoint_snap(t: Tables) -> DataFrame:
    """Road ends snapped to the nearest node of their map within 50 units."""
    ends = spatial.placed(entry_positions(t("road_entries"))).withColumnRenamed("world", "map_name").distinct()
    own = t("nodes").select("map_name", uid("uid").alias("id"), "x", "y").distinct()
    near = spatial.knn_join(ends, own, radius=50.0, by=("map_name",))
    return near.join(ends.select(c("id").alias("q_id"), "map_name"), "q_id").select("map_name", c("q_id").alias("entry_id"), c("p_id").alias("node"), F.round("d", 4).alias("d")).distinct()


@R.query(
    f"""WITH n AS (SELECT a.id, b.nation, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM {_PART} a, {_SUPP} b), o AS (SELECT id, nation FROM n WHERE k = 1),
    inside AS (SELECT a.id, min(c.id) AS city FROM {_PART} a JOIN o USING (id) JOIN {_CUST} c ON c.nation = o.nation AND a.x BETWEEN c.x - 60 AND c.x + 60 AND a.y BETWEEN c.y - 60 AND c.y + 60 GROUP BY 1),
    near AS (SELECT id, city, d FROM (SELECT a.id, b.id AS city, {_DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM {_PART} a JOIN o USING (id) JOIN {_CUST} b ON b.nation = o.nation) WHERE k = 1)
    SELECT o.id, o.nation, coalesce(inside.city, near.city) AS city, CASE WHEN inside.city IS NOT NULL THEN 0 ELSE round(near.d, 4) END AS d FROM o LEFT JOIN inside USING (id) LEFT JOIN near USING (id)"""
)
def location_enrich(t: Tables) -> DataFrame:
    """Country of the nearest supplier, then the containing city of that country, else its nearest city."""
    parts, cities = grid(t("part"), "p_partkey"), customers(t)
    first = spatial.knn_join(parts, suppliers(t)).join(suppliers(t).select(c("id").alias("p_id"), "nation"), "p_id").select(c("q_id").alias("id"), "nation")
    own = parts.join(first, "id")
    box = cities.select("nation", c("id").alias("city"), (c("x") - 60).alias("x0"), (c("y") - 60).alias("y0"), (c("x") + 60).alias("x1"), (c("y") + 60).alias("y1"))
    inside = spatial.box_join(own, box, 120.0, ("nation",)).groupBy("id").agg(F.min("city").alias("inside"))
    near = spatial.knn_join(own, cities, by=("nation",)).select(c("q_id").alias("id"), c("p_id").alias("near"), "d")
    out = own.join(inside, "id", "left").join(near, "id", "left")
    return out.select("id", "nation", F.coalesce("inside", "near").alias("city"), F.when(c("inside").isNotNull(), 0.0).otherwise(F.round("d", 4)).alias("d"))


@R.query(
    f"""WITH RECURSIVE p AS {_POINTS}, n AS (SELECT a.map_name, a.id, b.id AS other FROM p a JOIN p b ON a.map_name = b.map_name AND abs(a.x-b.x) <= 6 AND {_DIST} <= 6), k AS (SELECT map_name, id FROM n GROUP BY ALL HAVING count(*) >= 4),
    e AS (SELECT n.map_name, n.id, n.other FROM n JOIN k ON k.id = n.id JOIN k k2 ON k2.id = n.other), r AS (SELECT id AS s, id AS t FROM k UNION SELECT r.s, e.other FROM r JOIN e ON e.id = r.t), l AS (SELECT s AS id, min(t) AS cluster FROM r GROUP BY 1)
    SELECT p.map_name, p.id, coalesce(l.cluster, (SELECT min(l2.cluster) FROM n JOIN l l2 ON l2.id = n.other WHERE n.id = p.id)) AS cluster, l.id IS NOT NULL AS core FROM p LEFT JOIN l ON l.id = p.id"""
)
def dbscan_clusters(t: Tables) -> DataFrame:
    """Density clusters of guard points (radius 6, four points)."""
    return spatial.dbscan(points(t).select("map_name", "id", "x", "y"), 6.0, 4, ("map_name",))


@R.query(
    f"""WITH p AS {_POINTS}, n AS (SELECT a.map_name, a.id, count(*) AS n FROM p a JOIN p b ON a.map_name = b.map_name AND abs(a.x-b.x) <= 6 AND {_DIST} <= 6 GROUP BY ALL), k AS (SELECT * FROM n WHERE n >= 4)
    SELECT p.map_name, count(*) AS points, count(k.id) AS core, count(*) FILTER (k.id IS NULL AND NOT EXISTS (SELECT 1 FROM p b JOIN k k2 ON k2.id = b.id WHERE b.map_name = p.map_name AND sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) <= 6)) AS noise
    FROM p LEFT JOIN k ON k.id = p.id GROUP BY 1"""
)
def dbscan_counts(t: Tables) -> DataFrame:
    """Points, core points and noise of the density clusters, by map."""
    own = spatial.dbscan(points(t).select("map_name", "id", "x", "y"), 6.0, 4, ("map_name",))
    return own.groupBy("map_name").agg(F.count(F.lit(1)).alias("points"), F.count_if("core").alias("core"), F.count_if(c("cluster").isNull()).alias("noise"))
