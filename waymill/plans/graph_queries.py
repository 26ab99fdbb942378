"""Queries of the graph operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymill.functions.keys import uid, uid_of_rank, uid_rank, world
from waymill.functions.texts import is_route_key
from waymill.operators import graph, roadgraph
from waymill.plans.geometry_queries import _u
from waymill.plans.registry import Registry, Tables
from waymill.plans.relational_queries import _tok

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col


def edges(t: Tables) -> DataFrame:
    return roadgraph.road_edges(t("roads"), t("road_looks"))


def links(t: Tables) -> DataFrame:
    """Road edges as (src, dst) over (map, node, direction) states."""
    s = lambda n, d: F.concat_ws(":", "map_name", n, d)
    return edges(t).select(s("node", "dir").alias("src"), s("to", "to_dir").alias("dst"), "distance", "duration", "one_lane", "guard")


_EDGES = f"""r AS (SELECT DISTINCT map_name, {_u("uid")} AS item, {_u("start_node_uid")} AS s, {_u("end_node_uid")} AS e, {_tok("road_look_token")} AS look, road_length, dlc_guard AS guard FROM roads WHERE NOT coalesce(is_hidden, false)),
  k AS (SELECT map_name, {_tok("token")} AS look, coalesce(len(lanes_left), 0) AS nl, coalesce(len(lanes_right), 0) AS nr, list_concat(coalesce(lanes_left, []), coalesce(lanes_right, [])) AS l FROM road_looks),
  b AS (SELECT r.*, nl, nr, greatest(nl, nr) = 1 AS one_lane, road_length / (CASE WHEN len(list_filter(l, lambda v: contains(v, 'freeway'))) > 0 THEN 65 WHEN len(list_filter(l, lambda v: contains(v, 'motorway'))) > 0 THEN 60
    WHEN len(list_filter(l, lambda v: contains(v, 'expressway'))) > 0 THEN 55 WHEN len(list_filter(l, lambda v: contains(v, 'divided'))) > 0 THEN 50 WHEN len(list_filter(l, lambda v: contains(v, 'slow_road'))) > 0 THEN 20 ELSE 30 END * 0.44704 * CASE WHEN r.map_name = 'europe' THEN 0.6213712 ELSE 1 END) AS duration
    FROM r JOIN k ON k.map_name = r.map_name AND k.look = r.look WHERE s IS NOT NULL AND e IS NOT NULL AND s <> '0' AND e <> '0'),
  g AS (SELECT map_name, s AS node, 'forward' AS dir, e AS "to", road_length AS distance, duration, one_lane, guard, item FROM b WHERE nr > 0 UNION ALL SELECT map_name, e, 'backward', s, road_length, duration, one_lane, guard, item FROM b WHERE nl > 0),
  x AS (SELECT map_name || ':' || node || ':' || dir AS src, map_name || ':' || "to" || ':' || dir AS dst, distance, duration, one_lane FROM g)"""


@R.query(f'WITH {_EDGES} SELECT map_name, node, dir, "to", dir AS to_dir, distance, round(duration, 3) AS duration, one_lane, guard, item FROM g')
def graph_edges(t: Tables) -> DataFrame:
    """Edges of all roads with length, time and guard."""
    return edges(t).select("map_name", "node", "dir", "to", "to_dir", "distance", F.round("duration", 3).alias("duration"), "one_lane", "guard", "item")


@R.query(f"WITH {_EDGES} SELECT coalesce(a.n, b.n) AS node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM (SELECT src AS n, count(*) AS o FROM x GROUP BY 1) a FULL JOIN (SELECT dst AS n, count(*) AS i FROM x GROUP BY 1) b ON a.n = b.n")
def degrees(t: Tables) -> DataFrame:
    """Edges in and out of every node and direction."""
    return graph.degrees(links(t))


@R.query(f"WITH {_EDGES} SELECT map_name, dir, count(*) AS n, count(*) FILTER (one_lane) AS one_lane, round(sum(distance), 2) AS distance FROM g GROUP BY 1, 2")
def edge_count(t: Tables) -> DataFrame:
    """Edges and their length by map and direction."""
    return edges(t).groupBy("map_name", "dir").agg(F.count(F.lit(1)).alias("n"), F.count_if("one_lane").alias("one_lane"), F.round(F.sum("distance"), 2).alias("distance"))


@R.query(
    f"""WITH {_EDGES}, q AS (SELECT map_name || ':' || node AS node, dir, map_name || ':' || "to" AS "to", item FROM g) SELECT node, dir, "to", item FROM q UNION ALL
      SELECT node, CASE dir WHEN 'forward' THEN 'backward' ELSE 'forward' END, "to", item FROM q WHERE NOT EXISTS (SELECT 1 FROM q h WHERE h.node = q.node AND h.dir <> q.dir) AND EXISTS (SELECT 1 FROM q k WHERE k.node = q."to" AND k."to" = q.node)"""
)
def dead_end_copy(t: Tables) -> DataFrame:
    """Edges with copies at nodes that have none one way but whose neighbours lead back."""
    own = edges(t).select(F.concat_ws(":", "map_name", "node").alias("node"), "dir", F.concat_ws(":", "map_name", "to").alias("to"), "item")
    return graph.dead_end_copies(own)


@R.query(f"WITH {_EDGES} SELECT dst AS node, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.src = x.dst) GROUP BY 1")
def dangling_targets(t: Tables) -> DataFrame:
    """Targets of edges from which no edge goes on."""
    e = links(t)
    return e.join(e.select(c("src").alias("dst")).distinct(), "dst", "left_anti").groupBy(c("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))


_SEED = "(SELECT src FROM x GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1)"


def seed(t: Tables) -> DataFrame:
    return links(t).groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "src").limit(1).select(c("src").alias("node"))


@R.query(f"WITH RECURSIVE {_EDGES}, h AS (SELECT src AS node FROM {_SEED} UNION SELECT x.dst FROM h JOIN x ON x.src = h.node) SELECT node FROM h")
def reach_all(t: Tables) -> DataFrame:
    """Everything reached from the busiest node."""
    return graph.reach(links(t), seed(t)).select("node")


@R.query(f"WITH RECURSIVE {_EDGES}, h AS (SELECT src AS node, 0 AS k FROM {_SEED} UNION SELECT x.dst, k + 1 FROM h JOIN x ON x.src = h.node WHERE k < 4) SELECT node, CAST(min(k) AS INT) AS hops FROM h GROUP BY 1")
def reach_k(t: Tables) -> DataFrame:
    """What is reached from the busiest node within four edges."""
    return graph.reach(links(t), seed(t), 4)


def _relaxed(mode: str, cost: str):
    @R.query(
        f"""WITH RECURSIVE {_EDGES}, w AS (SELECT src, dst, min({cost}) AS w FROM x GROUP BY 1, 2), s AS (SELECT arg_min(src, (-n, src)) AS src FROM (SELECT split_part(src, ':', 1) AS m, src, count(*) AS n FROM x GROUP BY ALL) GROUP BY m),
          p(source, node, cost) USING KEY (source, node) AS (SELECT src, src, 0.0::DOUBLE FROM s UNION SELECT p.source, w.dst, min(p.cost + w.w) FROM p JOIN w ON w.src = p.node LEFT JOIN recurring.p r ON r.source = p.source AND r.node = w.dst
          WHERE p.cost + w.w < coalesce(r.cost, 1e300) GROUP BY 1, 2) SELECT source, node, round(cost, 2) AS cost FROM p"""
    )
    def run(t: Tables) -> DataFrame:
        own = links(t).withColumn("cost", roadgraph.mode_cost(mode))
        ids = own.select(c("src").alias("n")).unionByName(own.select(c("dst").alias("n"))).distinct().select("n", F.xxhash64("n").alias("id"))
        busiest = own.groupBy(F.split_part("src", F.lit(":"), F.lit(1)).alias("m"), "src").agg(F.count(F.lit(1)).alias("n"))
        seeds = busiest.groupBy("m").agg(F.min_by("src", F.struct(-c("n"), "src")).alias("src")).select(F.xxhash64("src").alias("node"))
        out = graph.costs_from(own.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"), "cost"), seeds)
        named = lambda k: ids.select(c("id").alias(k), c("n").alias(f"{k}_name"))
        out = out.join(named("source"), "source").join(named("node"), "node")
        return out.select(c("source_name").alias("source"), c("node_name").alias("node"), F.round("cost", 2).alias("cost"))

    for made in (QUERIES, ORACLES):
        made[f"relax_{mode.lower()}"] = made.pop("run")


_relaxed("shortest", "distance")
_relaxed("fastest", "duration")
_relaxed("smallRoads", "CASE WHEN one_lane THEN distance ELSE distance * 10 END")

_COSTS = {"shortest": "distance", "fastest": "duration", "smallRoads": "CASE WHEN one_lane THEN distance ELSE distance * 10 END"}


def mode_graph(t: Tables) -> DataFrame:
    """Edges of roads and prefabs for every mode between states (map, node, direction): (mode, src, dst, cost)."""
    own = edges(t).unionByName(roadgraph.prefab_edges(t("prefabs"), t("prefab_descriptions"), t("nodes")).select(edges(t).columns))
    state = lambda n, d: F.concat_ws(":", "map_name", n, d)
    costs = F.explode(F.create_map(*[x for m in _COSTS for x in (F.lit(m), roadgraph.mode_cost(m))])).alias("mode", "cost")
    return own.select(state("node", "dir").alias("src"), state("to", "to_dir").alias("dst"), costs)


_PREFAB_LINKS = f"""d AS (SELECT map_name, {_tok("token")} AS token, nodes, nav_curves FROM prefab_descriptions),
      dn AS (SELECT map_name, token, generate_subscripts(nodes, 1) - 1 AS i, unnest(nodes) AS v FROM d), dc AS (SELECT map_name, token, generate_subscripts(nav_curves, 1) - 1 AS k, unnest(nav_curves) AS v FROM d),
      dl AS (SELECT map_name, token, k, unnest(v.next_lines) AS nx FROM dc), di AS (SELECT map_name, token, i, unnest(v.input_lanes) AS k FROM dn), dd AS (SELECT map_name, token, i, unnest(v.output_lanes) AS k FROM dn),
      dp AS (SELECT di.map_name, di.token, di.i AS s, di.k FROM di JOIN dc ON dc.map_name = di.map_name AND dc.token = di.token AND dc.k = di.k UNION SELECT dp.map_name, dp.token, dp.s, dl.nx FROM dp JOIN dl ON dl.map_name = dp.map_name AND dl.token = dp.token AND dl.k = dp.k JOIN dc ON dc.map_name = dp.map_name AND dc.token = dp.token AND dc.k = dl.nx),
      lk AS (SELECT DISTINCT dp.map_name, dp.token, dp.s, dd.i AS e FROM dp JOIN dd ON dd.map_name = dp.map_name AND dd.token = dp.token AND dd.k = dp.k),
      pf AS (SELECT DISTINCT map_name, {_u("uid")} AS item, {_tok("token")} AS token, node_uids, coalesce(origin_node_index, 0) AS o, dlc_guard AS guard, len(node_uids) AS n FROM prefabs WHERE NOT coalesce(is_hidden, false) AND len(node_uids) > 0),
      pe AS (SELECT DISTINCT map_name, item, guard, {_u("a")} AS node, {_u("b")} AS "to" FROM (SELECT pf.map_name, item, guard, node_uids[1 + ((s - o) % n + n) % n] AS a, node_uids[1 + ((e - o) % n + n) % n] AS b FROM pf JOIN lk ON lk.map_name = pf.map_name AND lk.token = pf.token WHERE s < n AND e < n)),
      np AS (SELECT map_name, {_u("uid")} AS node, arg_max(x, (arrived_at, x)) AS x, arg_max(y, (arrived_at, x)) AS y, arg_max(coalesce({_u("forward_item_uid")}, ''), (arrived_at, x)) AS f, arg_max(coalesce({_u("backward_item_uid")}, ''), (arrived_at, x)) AS b FROM nodes GROUP BY ALL),
      pg AS (SELECT pe.map_name, pe.node, CASE WHEN a.f = item THEN 'forward' ELSE 'backward' END AS dir, pe."to", CASE WHEN z.b = item THEN 'forward' ELSE 'backward' END AS to_dir, sqrt((a.x-z.x)*(a.x-z.x) + (a.y-z.y)*(a.y-z.y)) AS distance, guard, item
        FROM pe JOIN np a ON a.map_name = pe.map_name AND a.node = pe.node JOIN np z ON z.map_name = pe.map_name AND z.node = pe."to" WHERE pe.node <> '0' AND pe."to" <> '0' AND pe.node <> pe."to")"""

_ROUTES = f"""WITH RECURSIVE {_EDGES}, {_PREFAB_LINKS},
      y AS (SELECT src, dst, distance, duration, one_lane FROM x UNION ALL SELECT map_name || ':' || node || ':' || dir, map_name || ':' || "to" || ':' || to_dir, distance, distance / (30 * 0.44704 * CASE WHEN map_name = 'europe' THEN 0.6213712 ELSE 1 END), false FROM pg),
      w AS ({" UNION ALL ".join(f"SELECT '{m}' AS mode, src, dst, min({cost}) AS w FROM y GROUP BY ALL" for m, cost in _COSTS.items())}),
      q AS (SELECT DISTINCT map_name, {_u("split_part(route_key, '-', 1)")} AS a, {_u("split_part(route_key, '-', 2)")} AS b, split_part(route_key, '-', 3) AS dir, split_part(route_key, '-', 4) AS mode FROM waypoints WHERE regexp_matches(route_key, '^[0-9a-f]+-[0-9a-f]+-(forward|backward)-(shortest|fastest|smallRoads)-(usa|europe)$')),
      st AS (SELECT DISTINCT mode, map_name || ':' || a || ':' || dir AS src FROM q),
      p(mode, source, node, cost) USING KEY (mode, source, node) AS (SELECT mode, src, src, 0.0::DOUBLE FROM st UNION SELECT p.mode, p.source, w.dst, min(p.cost + w.w) FROM p JOIN w ON w.mode = p.mode AND w.src = p.node LEFT JOIN recurring.p r ON r.mode = p.mode AND r.source = p.source AND r.node = w.dst
        WHERE p.cost + w.w < coalesce(r.cost, 1e300) GROUP BY ALL)
      SELECT q.map_name, q.a AS start, q.b AS goal, q.dir, q.mode, round(min(p.cost), 2) AS cost FROM q JOIN p ON p.mode = q.mode AND p.source = q.map_name || ':' || a || ':' || dir AND p.node IN (q.map_name || ':' || b || ':forward', q.map_name || ':' || b || ':backward') GROUP BY ALL"""


@R.query(_ROUTES)
def path_routes(t: Tables) -> DataFrame:
    """The cheapest route of every waypoint's route key by its direction and mode, over roads and prefabs as directed
    states; the goal may be entered from either side."""
    parts = F.split("route_key", "-")
    keys = t("waypoints").filter(is_route_key(c("route_key"))).select("map_name", uid(parts[0]).alias("start"), uid(parts[1]).alias("goal"), parts[2].alias("dir"), parts[3].alias("mode")).distinct()
    e = mode_graph(t).select("mode", "src", "dst", "cost")
    sides = F.explode(F.array(*[F.concat_ws(":", "map_name", "goal", F.lit(d)) for d in ("forward", "backward")]))
    end = keys.select("mode", sides.alias("src"), F.concat_ws(":", "map_name", "goal", F.lit("any")).alias("dst"), F.lit(0.0).alias("cost")).distinct()
    at = lambda k: F.xxhash64("mode", k)
    own = keys.select("*", at(F.concat_ws(":", "map_name", "start", "dir")).alias("src"), at(F.concat_ws(":", "map_name", "goal", F.lit("any"))).alias("dst"))
    found = graph.routes(e.unionByName(end).select(at("src").alias("src"), at("dst").alias("dst"), "cost"), own)
    return own.join(found, ["src", "dst"]).select("map_name", "start", "goal", "dir", "mode", F.round("cost", 2).alias("cost"))


@R.query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT map_name || ':' || {_u("start_node_uid")} AS src, map_name || ':' || {_u("end_node_uid")} AS dst FROM roads WHERE {_u("start_node_uid")} <> '0' AND {_u("end_node_uid")} <> '0'),
      d AS (SELECT n FROM (SELECT src AS n, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY n HAVING sum(o) = 1 AND sum(i) = 1),
      p AS (SELECT src, dst, 1::BIGINT AS hops FROM e WHERE src NOT IN (SELECT n FROM d) UNION ALL SELECT p.src, e.dst, hops + 1 FROM p JOIN d ON d.n = p.dst JOIN e ON e.src = p.dst)
      SELECT src, dst, hops FROM p WHERE dst NOT IN (SELECT n FROM d)"""
)
def collapsed_chains(t: Tables) -> DataFrame:
    """Roads as a directed graph with nodes of one road in and one out passed through."""
    s = lambda k: F.concat_ws(":", "map_name", uid(k))
    e = t("roads").filter((uid("start_node_uid") != "0") & (uid("end_node_uid") != "0")).select(s("start_node_uid").alias("src"), s("end_node_uid").alias("dst"))
    return graph.collapse_chains(e)


@R.query(
    f"""WITH {_EDGES}, e AS (SELECT DISTINCT map_name || node AS a, map_name || "to" AS b FROM g WHERE node <> "to")
      SELECT 2 AS length, count(*) AS n FROM e JOIN e f ON f.a = e.b AND f.b = e.a WHERE e.a < e.b HAVING count(*) > 0
      UNION ALL SELECT 3, count(*) FROM e JOIN e f ON f.a = e.b JOIN e h ON h.a = f.b AND h.b = e.a WHERE e.a < e.b AND e.a < f.b AND e.b <> f.b HAVING count(*) > 0
      UNION ALL SELECT 4, count(*) FROM e JOIN e f ON f.a = e.b JOIN e h ON h.a = f.b JOIN e i ON i.a = h.b AND i.b = e.a WHERE e.a < e.b AND e.a < f.b AND e.a < h.b AND e.b <> f.b AND e.b <> h.b AND f.b <> h.b HAVING count(*) > 0"""
)
def cycles_le4(t: Tables) -> DataFrame:
    """Simple cycles of up to four nodes, by length."""
    e = edges(t).select(F.concat("map_name", "node").alias("src"), F.concat("map_name", "to").alias("dst")).distinct()
    return graph.short_cycles(e, 4).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    f"""WITH RECURSIVE m AS (SELECT DISTINCT map_name, {_u("start_node_uid")} AS a, {_u("end_node_uid")} AS b FROM roads WHERE {_u("start_node_uid")} <> '0' AND {_u("end_node_uid")} <> '0'),
      e AS (SELECT map_name, a, b FROM m UNION SELECT map_name, b, a FROM m),
      r(map_name, node, low) USING KEY (map_name, node) AS (SELECT DISTINCT map_name, a, lpad(a, 16, '0') FROM e UNION SELECT e.map_name, e.b, min(r.low) FROM r JOIN e ON e.map_name = r.map_name AND e.a = r.node JOIN recurring.r q ON q.map_name = e.map_name AND q.node = e.b WHERE r.low < q.low GROUP BY ALL)
      SELECT map_name, node, ltrim(low, '0') AS component FROM r"""
)
def road_components(t: Tables) -> DataFrame:
    """Nodes joined by roads, with the least node of each component of its map."""
    own = t("roads").filter((uid("start_node_uid") != "0") & (uid("end_node_uid") != "0"))
    w = world("map_name").alias("w")
    found = graph.components(own.select(w, uid_rank(uid("start_node_uid")).alias("src"), uid_rank(uid("end_node_uid")).alias("dst")))
    return found.select(c("w").alias("map_name"), uid_of_rank("node").alias("node"), uid_of_rank("component").alias("component"))


_MEMBERS = f"""SELECT DISTINCT map_name, {_u("uid")} AS item, {_u("start_node_uid")} AS node FROM roads UNION SELECT map_name, {_u("uid")}, {_u("end_node_uid")} FROM roads UNION SELECT map_name, {_u("uid")}, {_u("n")} FROM (SELECT map_name, uid, unnest(node_uids) AS n FROM prefabs)"""


def members(t: Tables) -> DataFrame:
    r, p = t("roads"), t("prefabs").select("map_name", "uid", F.explode("node_uids").alias("n"))
    parts = [r.select("map_name", uid("uid").alias("item"), uid(k).alias("node")) for k in ("start_node_uid", "end_node_uid")] + [p.select("map_name", uid("uid").alias("item"), uid("n").alias("node"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("node IS NOT NULL AND node <> '0'").distinct()


@R.query(f"WITH m AS (SELECT * FROM ({_MEMBERS}) WHERE node IS NOT NULL AND node <> '0') SELECT map_name, item FROM m GROUP BY 1, 2 HAVING NOT bool_or(EXISTS (SELECT 1 FROM m o WHERE o.map_name = m.map_name AND o.node = m.node AND o.item <> m.item))")
def island_items(t: Tables) -> DataFrame:
    """Items that share no node with any other item."""
    return roadgraph.island_items(members(t))


@R.query(
    f"""SELECT a.map_name, a.item AS item_a, b.item AS item_b, min(a.node) AS node FROM ({_MEMBERS}) a JOIN ({_MEMBERS}) b ON a.map_name = b.map_name AND a.node = b.node AND a.item < b.item WHERE a.node <> '0'
        AND a.item IN (SELECT {_u("uid")} FROM prefabs) GROUP BY ALL"""
)
def common_items(t: Tables) -> DataFrame:
    """Pairs of a prefab and an item after it in order that share a node."""
    m = members(t)
    p = m.join(t("prefabs").select(uid("uid").alias("item")).distinct(), "item", "left_semi").select("map_name", c("item").alias("item_a"), "node")
    both = p.join(m.select("map_name", c("item").alias("item_b"), "node"), ["map_name", "node"]).filter("item_a < item_b")
    return both.groupBy("map_name", "item_a", "item_b").agg(F.min("node").alias("node"))


@R.query(
    f"""WITH RECURSIVE d AS (SELECT map_name, {_tok("token")} AS token, nodes, nav_curves FROM prefab_descriptions),
      n AS (SELECT map_name, token, generate_subscripts(nodes, 1) - 1 AS i, unnest(nodes) AS v FROM d), c AS (SELECT map_name, token, generate_subscripts(nav_curves, 1) - 1 AS k, unnest(nav_curves) AS v FROM d),
      l AS (SELECT map_name, token, k, unnest(v.next_lines) AS nx FROM c), i AS (SELECT map_name, token, i, unnest(v.input_lanes) AS k FROM n), o AS (SELECT map_name, token, i, unnest(v.output_lanes) AS k FROM n),
      p AS (SELECT i.map_name, i.token, i.i AS s, i.k FROM i JOIN c ON c.map_name = i.map_name AND c.token = i.token AND c.k = i.k UNION SELECT p.map_name, p.token, p.s, l.nx FROM p JOIN l ON l.map_name = p.map_name AND l.token = p.token AND l.k = p.k JOIN c ON c.map_name = p.map_name AND c.token = p.token AND c.k = l.nx)
      SELECT DISTINCT p.map_name, p.token, CAST(p.s AS INT) AS start_node, CAST(o.i AS INT) AS end_node FROM p JOIN o ON o.map_name = p.map_name AND o.token = p.token AND o.k = p.k"""
)
def lane_connections(t: Tables) -> DataFrame:
    """Which nodes of each prefab description its lanes join."""
    return roadgraph.lane_connections(t("prefab_descriptions")).select("map_name", "token", "start_node", "end_node")


@R.query(f"WITH RECURSIVE {_PREFAB_LINKS} SELECT map_name, node, dir, \"to\", to_dir, round(distance, 2) AS distance, guard, item FROM pg")
def prefab_edges(t: Tables) -> DataFrame:
    """Edges of prefabs along their lanes."""
    e = roadgraph.prefab_edges(t("prefabs"), t("prefab_descriptions"), t("nodes"))
    return e.select("map_name", "node", "dir", "to", "to_dir", F.round("distance", 2).alias("distance"), "guard", "item")


@R.query(
    """WITH v AS (SELECT region_id, generate_subscripts(ring, 1) AS i, unnest(ring) AS p FROM map_regions), m AS (SELECT *, avg(p.x) OVER w AS cx, avg(p.y) OVER w AS cy FROM v WINDOW w AS (PARTITION BY region_id)),
      q AS (SELECT *, sqrt(pow(p.x - cx, 2) + pow(p.y - cy, 2)) AS r, (p.x - lag(p.x) OVER o) * (lead(p.y) OVER o - p.y) - (p.y - lag(p.y) OVER o) * (lead(p.x) OVER o - p.x) AS t FROM m WINDOW o AS (PARTITION BY region_id ORDER BY i)),
      s AS (SELECT region_id, avg(r) AS mr, stddev_pop(r) / avg(r) AS ci, (max(p.x) - min(p.x)) / (max(p.y) - min(p.y)) AS asp, count(*) FILTER (t > 0) AS a, count(*) FILTER (t < 0) AS b FROM q GROUP BY 1)
      SELECT region_id, round(mr, 2) AS mean_radius, round(ci, 5) AS circularity, round(asp, 5) AS aspect, round(CASE WHEN a + b = 0 THEN 0 ELSE greatest(a, b) / (a + b) END, 5) AS turning, CAST(sign(a - b) AS INT) AS direction,
      round(CASE WHEN a >= b THEN 0 ELSE exp(-pow(ln(asp), 2) / 0.02) * greatest(a, b) / (a + b) * (1 - ci) END, 5) AS shape FROM s"""
)
def ring_shapes(t: Tables) -> DataFrame:
    """Roundness of every region's ring, and the product without the radius."""
    v = t("map_regions").select("region_id", F.posexplode("ring").alias("ord", "p")).select("region_id", "ord", "p.x", "p.y")
    s = roadgraph.ring_scores(v, ["region_id"])
    shape = F.when(c("direction") != -1, 0.0).otherwise(F.exp(-F.pow(F.log("aspect"), F.lit(2)) / roadgraph.ASPECT_SPREAD) * c("turning") * (1 - c("circularity")))
    return s.select("region_id", F.round("mean_radius", 2).alias("mean_radius"), *[F.round(k, 5).alias(k) for k in ("circularity", "aspect", "turning")], "direction", F.round(shape, 5).alias("shape"))


@R.query(
    """WITH v AS (SELECT region_id, generate_subscripts(ring, 1) AS i, unnest(ring) AS p FROM map_regions), c AS (SELECT *, avg(p.x) OVER w AS cx, avg(p.y) OVER w AS cy FROM v WINDOW w AS (PARTITION BY region_id)),
      k AS (SELECT region_id, i, (p.x - cx) / 20 AS x, (p.y - cy) / 20 AS y FROM c), m AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM k WINDOW w AS (PARTITION BY region_id)),
      q AS (SELECT *, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS r, (x - lag(x) OVER o) * (lead(y) OVER o - y) - (y - lag(y) OVER o) * (lead(x) OVER o - x) AS t FROM m WINDOW o AS (PARTITION BY region_id ORDER BY i)),
      s AS (SELECT region_id, avg(r) AS mr, stddev_pop(r) / avg(r) AS ci, (max(x) - min(x)) / (max(y) - min(y)) AS asp, count(*) FILTER (t > 0) AS a, count(*) FILTER (t < 0) AS b FROM q GROUP BY 1)
      SELECT region_id, round(CASE WHEN a >= b THEN 0 ELSE CASE WHEN mr <= 70 THEN 1 ELSE exp(-(mr - 70) / 10) END * exp(-pow(ln(asp), 2) / 0.02) * greatest(a, b) / (a + b) * (1 - ci) END, 5) AS score FROM s"""
)
def round_scores(t: Tables) -> DataFrame:
    """The whole product, radius included, of rings drawn at a twentieth of their size."""
    v = t("map_regions").select("region_id", F.posexplode("ring").alias("ord", "p")).select("region_id", "ord", "p.x", "p.y")
    w = W.partitionBy("region_id")
    v = v.select("region_id", "ord", *[((c(k) - F.avg(k).over(w)) / 20).alias(k) for k in "xy"])
    return roadgraph.ring_scores(v, ["region_id"]).select("region_id", F.round("score", 5).alias("score"))


@R.query(
    """WITH s AS (SELECT s_nationkey AS route, s_suppkey AS ord, CAST(s_suppkey * 7919 % 10007 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 10007 AS DOUBLE) AS y FROM supplier),
      g AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM s WINDOW w AS (PARTITION BY route ORDER BY ord)), e AS (SELECT c_nationkey AS route, c_custkey AS id, CAST(c_custkey * 7919 % 10007 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 10007 AS DOUBLE) AS y FROM customer),
      a AS (SELECT g.route, id, ord, sqrt(pow(g.x-e.x,2)+pow(g.y-e.y,2)) + sqrt(pow(bx-e.x,2)+pow(by_-e.y,2)) - sqrt(pow(g.x-bx,2)+pow(g.y-by_,2)) AS added FROM g JOIN e ON e.route = g.route WHERE bx IS NOT NULL)
      SELECT route, id, arg_min(ord, (added, ord)) AS after, round(min(added), 3) AS added FROM a GROUP BY 1, 2"""
)
def waypoint_best(t: Tables) -> DataFrame:
    """Where along its route a further place adds least."""
    from waymill.plans.spatial_queries import customers, suppliers

    stops = suppliers(t).select(c("nation").alias("route"), c("id").alias("ord"), "x", "y")
    found = roadgraph.best_insertions(stops, customers(t).select(c("nation").alias("route"), "id", "x", "y"))
    return found.select("route", "id", "after", F.round("added", 3).alias("added"))


@R.query(
    """SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index,
       CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS next_index, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS next_step FROM lineitem"""
)
def flat_index(t: Tables) -> DataFrame:
    """Range of running node numbers of each step of a route, and the step after it."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    q = c("l_quantity").cast("bigint")
    run = F.sum(q).over(w.rowsBetween(W.unboundedPreceding, 0))
    return t("lineitem").select("l_orderkey", "l_linenumber", (run - q).alias("first_index"), run.alias("next_index"), F.lead("l_linenumber").over(w).alias("next_step"))
