"""Queries of the operators around routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.keys import token, uid, uid_rank
from waymill.operators import roadgraph, routing, shred, spatial
from waymill.plans.geometry_queries import _ENDS, road_ends
from waymill.plans.registry import Registry, Tables
from waymill.plans.graph_queries import _PREFAB_LINKS
from waymill.plans.problems import NESTED_CONNECTIONS, entry_positions
from waymill.plans.spatial_queries import _CUST, _DIST, _ENTRIES, _SUPP, customers, suppliers
from waymill.sources import sinks

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col


@R.query(
    f"""WITH v AS (SELECT nation AS route, id AS ord, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM {_SUPP} WINDOW w AS (PARTITION BY nation ORDER BY id)),
      a AS (SELECT *, floor(degrees(atan2((x-lx)*(ny-y) - (y-ly)*(nx-x), (x-lx)*(nx-x) + (y-ly)*(ny-y))) + 0.5) AS deg FROM v),
      t AS (SELECT *, CASE WHEN lx IS NULL THEN 'depart' WHEN nx IS NULL THEN 'arrive' WHEN abs(deg) <= 2 THEN 'through' WHEN abs(deg) <= 70 THEN 'slight' WHEN abs(deg) <= 110 THEN 'turn' WHEN abs(deg) <= 160 THEN 'sharp' ELSE 'u_turn' END
        || CASE WHEN lx IS NULL OR nx IS NULL OR abs(deg) <= 2 OR abs(deg) > 160 THEN '' WHEN deg < 0 THEN '_left' ELSE '_right' END AS turn, coalesce(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)), 0) AS part FROM a),
      s AS (SELECT *, sum(CASE WHEN turn <> 'through' THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY ord) AS step FROM t)
      SELECT route, CAST(step AS BIGINT) AS step, arg_min(turn, ord) AS turn, round(sum(part), 3) AS distance, min(ord) AS first, max(ord) AS last FROM s GROUP BY 1, 2"""
)
def route_steps(t: Tables) -> DataFrame:
    """Steps of the routes through each nation's suppliers, cut at their turns."""
    s = routing.steps(suppliers(t).select(c("nation").alias("route"), c("id").alias("ord"), "x", "y"))
    return s.select("route", c("step").cast("bigint").alias("step"), "turn", F.round("distance", 3).alias("distance"), "first", "last")


@R.query(f"SELECT route, step, turn, CASE WHEN distance <= 3000 THEN lead(turn) OVER (PARTITION BY route ORDER BY step) END AS then FROM ({ORACLES['route_steps']})")
def then_hints(t: Tables) -> DataFrame:
    """Steps with the turn that follows within 3,000 units."""
    s = routing.steps(suppliers(t).select(c("nation").alias("route"), c("id").alias("ord"), "x", "y"))
    return routing.with_next(s, 3000.0).select("route", c("step").cast("bigint").alias("step"), "turn", "then")


@R.query(
    f"""WITH {_ENDS}, m AS (SELECT p.map_name, p.id, e.road, greatest(0, least(1, ((p.x-x0)*(x1-x0) + (p.y-y0)*(y1-y0)) / nullif(pow(x1-x0,2) + pow(y1-y0,2), 0))) AS t, p.x, p.y, x0, y0, x1, y1, p.h FROM ends e JOIN (SELECT *, CAST(id % 7 AS DOUBLE) AS h FROM {_ENTRIES}) p ON p.map_name = e.map_name
        AND p.x BETWEEN least(x0, x1) - 60 AND greatest(x0, x1) + 60 AND p.y BETWEEN least(y0, y1) - 60 AND greatest(y0, y1) + 60),
      d AS (SELECT map_name, id, road, h, atan2(y1-y0, x1-x0) AS way, sqrt(pow(x - x0 - t*(x1-x0), 2) + pow(y - y0 - t*(y1-y0), 2)) AS d FROM m WHERE t IS NOT NULL)
      SELECT map_name, id, arg_min(road, (-round(abs(cos(h - way)) * exp(-d / 20), 9), road)) AS road, round(max(round(abs(cos(h - way)) * exp(-d / 20), 9)), 6) AS score FROM d WHERE d <= 60 GROUP BY 1, 2"""
)
def pose_on_road(t: Tables) -> DataFrame:
    """The road of its map each road end is on, taken as a pose, by alignment and nearness."""
    e = road_ends(t)
    parts = [e.select("map_name", c("road").alias("line"), F.lit(i).alias("ord"), c(f"x{i}").alias("x"), c(f"y{i}").alias("y")) for i in (0, 1)]
    ends = spatial.placed(entry_positions(t("road_entries"))).withColumnRenamed("world", "map_name").distinct()
    poses = ends.select("map_name", "id", "x", "y", (c("id") % 7).cast("double").alias("heading"))
    found = routing.located(poses, parts[0].unionByName(parts[1]).filter("x IS NOT NULL"), 60.0, ("map_name",))
    return found.select("map_name", "id", c("line").alias("road"), F.round("score", 6).alias("score"))


@R.query()
def coalesced_roads(t: Tables) -> DataFrame:
    """Roads of one look joined end to end where their ends are each other's nearest."""
    e = road_ends(t).join(t("roads").select("map_name", uid("uid").alias("road"), token("road_look_token").alias("look")).distinct(), ["map_name", "road"])
    own = e.filter("look IS NOT NULL").select("map_name", uid_rank("road").alias("rank"), "look", "x0", "y0", "x1", "y1")
    own = sinks.numbered(own, ["map_name", "rank"], "id")
    found = routing.joined_roads(own, 2.5, ["look"], ("map_name",))
    return found.groupBy("map_name", "links").agg(F.count(F.lit(1)).alias("roads"), F.count_distinct("chain").alias("chains"))


@R.query()
def round_cycles(t: Tables) -> DataFrame:
    """Cycles of four to thirty nodes within clusters of nodes that are round."""
    e = roadgraph.road_edges(t("roads"), t("road_looks"))
    key = lambda n: F.concat_ws(":", "map_name", n)
    places = t("nodes").groupBy("map_name", key(uid("uid")).alias("node")).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return routing.roundabouts(e.select(key("node").alias("src"), key("to").alias("dst")), places, by=("map_name",)).select("cycle", F.round("score", 4).alias("score"))


@R.query(
    f"""WITH RECURSIVE {_PREFAB_LINKS}, v AS (SELECT map_name, token, v.x AS x, v.y AS y FROM dn), m AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM v WINDOW w AS (PARTITION BY map_name, token)), r AS (SELECT *, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) AS r FROM m),
      s AS (SELECT map_name, token, stddev_pop(r) / nullif(avg(r), 0) AS ci, count(*) AS n FROM r GROUP BY ALL), l AS (SELECT map_name, token, count(DISTINCT (s, e)) AS k FROM lk WHERE s <> e GROUP BY ALL)
      SELECT map_name, token, round(ci, 5) AS circularity FROM s JOIN l USING (map_name, token) WHERE n >= 3 AND k = n * (n - 1) AND ci <= 0.35"""
)
def round_prefabs(t: Tables) -> DataFrame:
    """Prefab descriptions that are roundabouts."""
    return routing.round_prefabs(t("prefab_descriptions")).select("map_name", "token", F.round("circularity", 5).alias("circularity"))


@R.query(
    f"""SELECT q_id AS id, p_id AS from_id FROM (SELECT a.id AS q_id, b.id AS p_id, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM (SELECT * FROM {_CUST} WHERE id % 3 <> 0) a, (SELECT * FROM {_CUST} WHERE id % 3 = 0) b WHERE {_DIST} <= 10000) WHERE k = 1"""
)
def filled_types(t: Tables) -> DataFrame:
    """Missing values taken from the nearest row that has one (all are within reach in the first round)."""
    own = customers(t).select("id", "x", "y", F.when(c("id") % 3 == 0, c("id")).alias("v"))
    return routing.filled_by_neighbours(own, "v", 10_000.0).filter("id % 3 <> 0").select("id", c("v").alias("from_id"))


@R.query(
    f"""WITH {NESTED_CONNECTIONS}, e AS (SELECT DISTINCT regexp_extract(parent_path, '\\[(ferry\\.)?([^\\]]*)\\]', 2) AS a, token AS b, distance * 100.0 AS d, record_id, child_path FROM leaf WHERE token IS NOT NULL), w AS (SELECT a AS src, b AS dst, d FROM e UNION ALL SELECT b, a, d FROM e)
      SELECT src, dst, min(d) AS distance, round(min(d / (30 * 0.44704)), 2) AS duration, true AS ferry FROM w GROUP BY 1, 2"""
)
def ferry_edges(t: Tables) -> DataFrame:
    """Edges of ferries from the nested records' connections."""
    rows = shred.typed_table(t("nested_records"), "$.ferryData.connections", {"token": ("token", "string"), "distance": ("distance", "double")})
    own = rows.select(F.regexp_extract("parent_path", r"\[(?:ferry\.)?([^\]]*)\]", 1).alias("from"), c("token").alias("to"), "distance")
    return routing.ferry_edges(own, 100.0, 30.0).select("src", "dst", "distance", F.round("duration", 2).alias("duration"), "ferry")


@R.query("SELECT o_custkey AS route, o_custkey AS first, max_by(o_custkey + o_orderkey % 2, (o_orderdate, o_orderkey)) AS last, round(sum(o_totalprice), 2) AS distance, bool_and(fits) AS fits FROM (SELECT *, coalesce(lag(o_custkey + o_orderkey % 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = o_custkey, true) AS fits FROM orders) GROUP BY 1")
def combined_routes(t: Tables) -> DataFrame:
    """Segments of a route combined into one, and whether each begins where the one before ends."""
    own = t("orders").select(c("o_custkey").alias("route"), F.struct("o_orderdate", "o_orderkey").alias("ord"), c("o_custkey").alias("first"), (c("o_custkey") + c("o_orderkey") % 2).alias("last"), c("o_totalprice").alias("distance"))
    return routing.combined(own).select("route", "first", "last", F.round("distance", 2).alias("distance"), "fits")


@R.query(
    f"""WITH s AS (SELECT a.id, a.nation, b.id AS node, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM {_SUPP} a, (SELECT id, x, y FROM {_CUST}) b)
      SELECT CAST(row_number() OVER (ORDER BY kind, id) - 1 AS BIGINT) AS number, kind, id, node FROM (SELECT 'service' AS kind, id, node FROM s WHERE k = 1 UNION ALL SELECT 'company', c_custkey, c_custkey FROM customer WHERE c_acctbal > 5000)"""
)
def search_table(t: Tables) -> DataFrame:
    """A search table: features snapped to the nearest node, others appended, dense numbers."""
    near = spatial.knn_join(suppliers(t), customers(t)).select(F.lit("service").alias("kind"), c("q_id").alias("id"), c("p_id").alias("node"))
    rest = t("customer").filter("c_acctbal > 5000").select(F.lit("company").alias("kind"), c("c_custkey").alias("id"), c("c_custkey").alias("node"))
    return sinks.numbered(near.unionByName(rest), ["kind", "id"]).select("number", "kind", "id", "node")


@R.query(f"SELECT id, CASE WHEN (5000 - x) * cos(id % 7) + (5000 - y) * sin(id % 7) >= 0 THEN 'ahead' ELSE 'behind' END AS side FROM {_CUST}")
def ahead_or_behind(t: Tables) -> DataFrame:
    """Whether the middle of the grid lies ahead of each pose."""
    return customers(t).select("id", routing.ahead_or_behind(c("x"), c("y"), (c("id") % 7).cast("double"), F.lit(5000.0), F.lit(5000.0)).alias("side"))


