"""Queries of features derived from map items, labels and requests, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymill.functions import labels
from waymill.functions.keys import token, uid
from waymill.operators import features, roadgraph
from waymill.plans.geometry_queries import _u
from waymill.plans.graph_queries import _MEMBERS, members
from waymill.plans.registry import Registry, Tables
from waymill.plans.relational_queries import _tok
from waymill.plans.spatial_queries import _POINTS, points

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col

_PLACES = f"(SELECT map_name, {_u('uid')} AS node, min(x) AS x, min(y) AS y FROM nodes WHERE x IS NOT NULL GROUP BY ALL)"


def places(t: Tables) -> DataFrame:
    return t("nodes").filter("x IS NOT NULL").groupBy("map_name", uid("uid").alias("node")).agg(F.min("x").alias("x"), F.min("y").alias("y"))


@R.query(
    r"""WITH s AS (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, 'exit' AS kind, regexp_extract(l, '[Ee]xits? ([0-9]+)', 1) AS value FROM s WHERE regexp_matches(l, '[Ee]xits? [0-9]+')
    UNION ALL SELECT doc_id, 'road_number', regexp_extract(l, '\b([A-Z]{1,2} [0-9]+)\b', 1) FROM s WHERE regexp_matches(l, '\b[A-Z]{1,2} [0-9]+\b')
    UNION ALL SELECT doc_id, 'name', regexp_extract(l, '(?:near|behind|at|bei|vers|cerca de) ([A-Z][a-z]+)', 1) FROM s WHERE regexp_matches(l, '(?:near|behind|at|bei|vers|cerca de) [A-Z][a-z]+')"""
)
def sign_kinds(t: Tables) -> DataFrame:
    """What the first line of each text names, as signs are classified: an exit, a road number, a place, up to three rows."""
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    found = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    kinds = {"exit": found(r"[Ee]xits? ([0-9]+)"), "road_number": found(r"\b([A-Z]{1,2} [0-9]+)\b"), "name": found(r"(?:near|behind|at|bei|vers|cerca de) ([A-Z][a-z]+)")}
    return features.classified(t("documents").filter("text IS NOT NULL"), kinds).select("doc_id", "kind", "value")


@R.query(
    f"""WITH m AS (SELECT i.map_name, item, x, y FROM ({_MEMBERS}) i JOIN {_PLACES} p ON p.map_name = i.map_name AND p.node = i.node)
    SELECT map_name, item, CASE WHEN count(*) = 2 THEN 'midpoint' ELSE 'extent' END AS kind, (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y FROM m GROUP BY 1, 2 HAVING count(*) = 2 OR count(*) >= 4"""
)
def traffic_places(t: Tables) -> DataFrame:
    """Where an item with two nodes, or with four or more, is drawn."""
    return features.item_places(members(t).join(places(t), ["map_name", "node"]), ["map_name", "item"])


@R.query(
    f"""SELECT 'guard' AS kind, CAST(id AS VARCHAR) AS id, map_name, x, y, CAST(dlc_guard AS VARCHAR) AS label FROM {_POINTS} UNION ALL
    SELECT DISTINCT 'stop', CAST(waypoint_id AS VARCHAR), w.map_name, p.x, p.y, regexp_replace(description, '^(?i:The) ', '') FROM waypoints w JOIN {_PLACES} p ON p.map_name = w.map_name AND p.node = {_u("node_uid")} UNION ALL
    SELECT DISTINCT 'region', CAST(region_id AS VARCHAR), map_name, NULL::DOUBLE, NULL::DOUBLE, region_name FROM map_regions UNION ALL
    SELECT DISTINCT 'prefab', {_u("uid")}, map_name, x, y, {_tok("token")} FROM prefabs"""
)
def poi_union(t: Tables) -> DataFrame:
    """Points of interest from four tables in one form; labels lose a leading article."""
    w = t("waypoints").select("map_name", c("waypoint_id").alias("id"), uid("node_uid").alias("node"), labels.without_article(c("description")).alias("label"))
    return features.feature_union(
        {
            "guard": points(t).withColumnRenamed("dlc_guard", "label"),
            "stop": w.join(places(t), ["map_name", "node"]).select("id", "map_name", "x", "y", "label").distinct(),
            "region": t("map_regions").select(c("region_id").alias("id"), "map_name", c("region_name").alias("label")).distinct(),
            "prefab": t("prefabs").select(uid("uid").alias("id"), "map_name", "x", "y", token("token").alias("label")).distinct(),
        }
    )


@R.query(
    f"""WITH w AS (SELECT DISTINCT map_name, {_u("node_uid")} AS node, stop_index, waypoint_id FROM waypoints WHERE node_uid IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY map_name, node) AS k, lag(waypoint_id) OVER o AS p, lead(waypoint_id) OVER o AS q,
      first_value(waypoint_id) OVER (PARTITION BY map_name, node ORDER BY stop_index, waypoint_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(waypoint_id) OVER (PARTITION BY map_name, node ORDER BY stop_index, waypoint_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
      FROM w WINDOW o AS (PARTITION BY map_name, node ORDER BY stop_index, waypoint_id))
    SELECT map_name, waypoint_id, coalesce(p, CASE WHEN k >= 3 THEN l END) AS prev, coalesce(q, CASE WHEN k >= 3 THEN f END) AS next FROM n"""
)
def loop_links(t: Tables) -> DataFrame:
    """Stops at one node linked to the one before and after, three or more as a loop."""
    own = t("waypoints").filter("node_uid IS NOT NULL").select("map_name", uid("node_uid").alias("node"), "stop_index", "waypoint_id").distinct()
    return features.neighbour_links(own, ["map_name", "node"], ["stop_index", "waypoint_id"], "waypoint_id").select("map_name", "waypoint_id", "prev", "next")


@R.query(f"SELECT entrance, arg_max(item, (arrived_at, item)) AS item FROM (SELECT map_name || ':' || {_u('n')} AS entrance, {_u('uid')} AS item, arrived_at FROM (SELECT map_name, uid, arrived_at, unnest(node_uids) AS n FROM prefabs) WHERE {_u('n')} IS NOT NULL) GROUP BY 1")
def entrance_index(t: Tables) -> DataFrame:
    """Which prefab a node is an entrance of, the later one of several."""
    own = t("prefabs").select(uid("uid").alias("item"), "arrived_at", F.transform("node_uids", lambda n: F.concat(c("map_name"), F.lit(":"), uid(n))).alias("nodes"))
    return features.entrance_index(own, "item", "nodes", ["arrived_at", "item"])


@R.query(
    f"""WITH r AS (SELECT DISTINCT map_name, {_u("uid")} AS road, {_tok("road_look_token")} AS look, {_u("start_node_uid")} AS node FROM roads), k AS (SELECT DISTINCT map_name, {_tok("token")} AS look FROM road_looks WHERE removed_at IS NULL),
      gone AS (SELECT map_name, node FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.map_name = r.map_name AND k.look = r.look)), n AS (SELECT DISTINCT map_name, {_u("uid")} AS node FROM nodes)
    SELECT n.map_name, n.node FROM n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.map_name = n.map_name AND g.node = n.node)"""
)
def consistent_nodes(t: Tables) -> DataFrame:
    """Nodes left after roads without a present look are deleted with the nodes they start at."""
    r = t("roads").select("map_name", uid("uid").alias("road"), token("road_look_token").alias("look"), uid("start_node_uid").alias("node")).distinct()
    k = t("road_looks").filter("removed_at IS NULL").select("map_name", token("token").alias("look"))
    n = t("nodes").select("map_name", uid("uid").alias("node")).distinct()
    return features.without_inconsistent(r, k, ["map_name", "look"], n, {"map_name": "map_name", "node": "node"})[1]


@R.query(
    f"""WITH m AS (SELECT DISTINCT i.map_name, i.item, i.node, p.x, p.y FROM ({_MEMBERS}) i JOIN {_PLACES} p ON p.map_name = i.map_name AND p.node = i.node WHERE i.item IN (SELECT {_u("uid")} FROM prefabs)),
      f AS (SELECT DISTINCT map_name, {_u("uid")} AS item, x, y FROM prefabs WHERE x IS NOT NULL AND y IS NOT NULL), d AS (SELECT m.map_name, m.item, node, sqrt((m.x-f.x)*(m.x-f.x) + (m.y-f.y)*(m.y-f.y)) AS d FROM m JOIN f ON f.map_name = m.map_name AND f.item = m.item)
    SELECT map_name, item, arg_min(node, (d, node)) AS node, round(min(d), 4) AS d FROM d GROUP BY 1, 2"""
)
def facility_nodes(t: Tables) -> DataFrame:
    """Of each prefab's nodes the one nearest to its own place."""
    p = t("prefabs").filter("x IS NOT NULL AND y IS NOT NULL").select("map_name", uid("uid").alias("item"), "x", "y").distinct()
    own = members(t).join(places(t), ["map_name", "node"]).select("map_name", "item", c("node").alias("id"), "x", "y")
    found = features.facility_nodes(own, p.withColumn("id", F.concat_ws(":", "map_name", "item", "x", "y")), ("map_name", "item"))
    return found.select("map_name", "item", "node", F.round("d", 4).alias("d"))


_ISLANDS = f"(WITH m AS (SELECT * FROM ({_MEMBERS}) WHERE node IS NOT NULL AND node <> '0'), s AS (SELECT map_name, node, min(item) <> max(item) AS shared FROM m GROUP BY ALL) SELECT m.map_name, m.item FROM m JOIN s USING (map_name, node) GROUP BY ALL HAVING NOT bool_or(shared))"


@R.query(
    f"""WITH i AS (SELECT DISTINCT p.map_name, {_u("p.uid")} AS item, p.x, p.y FROM prefabs p JOIN {_ISLANDS} k ON k.map_name = p.map_name AND k.item = {_u("p.uid")} WHERE x IS NOT NULL AND y IS NOT NULL),
      g AS (SELECT DISTINCT n.map_name, n.node, n.x, n.y FROM {_PLACES} n JOIN (SELECT map_name, {_u("start_node_uid")} AS node FROM roads) r ON r.map_name = n.map_name AND r.node = n.node),
      d AS (SELECT i.map_name, item, node, sqrt((i.x-g.x)*(i.x-g.x) + (i.y-g.y)*(i.y-g.y)) AS d FROM i JOIN g ON g.map_name = i.map_name), b AS (SELECT map_name, item, arg_min(node, (d, node)) AS node, min(d) AS d FROM d GROUP BY 1, 2)
    SELECT map_name || ':' || CASE WHEN o THEN item ELSE node END AS src, map_name || ':' || CASE WHEN o THEN node ELSE item END AS dst, way, round(d, 4) AS d
    FROM b, (VALUES ('forward', true), ('backward', true), ('forward-forward', false), ('forward-backward', false), ('backward-forward', false), ('backward-backward', false)) w(way, o)"""
)
def island_links(t: Tables) -> DataFrame:
    """Prefabs that share no node with another item, linked to the nearest node that a road starts at."""
    own = roadgraph.island_items(members(t)).join(t("prefabs").select("map_name", uid("uid").alias("item"), "x", "y").distinct(), ["map_name", "item"])
    starts = places(t).join(t("roads").select("map_name", uid("start_node_uid").alias("node")).distinct(), ["map_name", "node"])
    key = lambda k: F.concat_ws(":", "map_name", k).alias("id")
    found = features.island_links(own.select("map_name", key("item"), "x", "y"), starts.select("map_name", key("node"), "x", "y"), ("map_name",))
    return found.select("src", "dst", "way", F.round("d", 4).alias("d"))


@R.query("SELECT doc_id, nullif(regexp_extract(lower(trim(city_token)), '^([a-z]{2})_', 1), '') AS prefix, CASE split_part(source, '.', -1) WHEN 'uk' THEN 'GB' WHEN 'kosovo' THEN 'XK' ELSE upper(split_part(source, '.', -1)) END AS code FROM documents")
def token_countries(t: Tables) -> DataFrame:
    """Country prefix of city tokens, and ISO codes of the ends of sources."""
    return t("documents").select("doc_id", labels.token_country(c("city_token")).alias("prefix"), labels.iso_code(F.split_part("source", F.lit("."), F.lit(-1))).alias("code"))


_VARIED = "CASE region_id % 6 WHEN 0 THEN region_name || ' x Route 5' WHEN 1 THEN region_name || ' State Line' WHEN 2 THEN region_name || ' Border' WHEN 3 THEN 'US-' || region_id WHEN 4 THEN 'The ' || region_name ELSE region_name END"


@R.query(f"SELECT region_id, region_id % 6 IN (0, 1, 2, 3) AS excluded, CASE region_id % 6 WHEN 4 THEN region_name ELSE {_VARIED} END AS label FROM map_regions")
def excluded_labels(t: Tables) -> DataFrame:
    """Names that are junctions, borders or route numbers, and names without their article."""
    own = t("map_regions").withColumn("label", F.expr(_VARIED))
    return own.select("region_id", labels.is_excluded(c("label")).alias("excluded"), labels.without_article(c("label")).alias("label"))


@R.query("SELECT point_id, '#' || printf('%.2f', CAST(3 + point_id % 15 AS DOUBLE)) || '/' || printf('%.5f', y / 1000) || '/' || printf('%.5f', x / 1000) AS hash, round(y / 1000, 5) AS lat, round(x / 1000, 5) AS lon, CAST(3 + point_id % 15 AS DOUBLE) AS zoom FROM (SELECT DISTINCT point_id, CAST(point_id % 9973 AS DOUBLE) / 7 AS x, CAST(point_id % 4999 AS DOUBLE) / 7 AS y FROM guard_points)")
def camera_hashes(t: Tables) -> DataFrame:
    """Camera positions written as the hash of an address, and read back."""
    own = t("guard_points").select("point_id").distinct()
    own = own.withColumn("hash", labels.camera_hash((c("point_id") % 4999).cast("double") / 7 / 1000, (c("point_id") % 9973).cast("double") / 7 / 1000, (3 + c("point_id") % 15).cast("double")))
    cam = labels.camera_of(c("hash"))
    return own.select("point_id", "hash", cam["lat"].alias("lat"), cam["lon"].alias("lon"), cam["zoom"].alias("zoom"))


@R.query("SELECT region_id, upper(string_split(p, '_')[1]) || '-' || string_split(p, '_')[2] || CASE WHEN len(string_split(p, '_')) > 2 THEN ' ' || upper(string_split(p, '_')[3]) ELSE '' END AS sign FROM (SELECT region_id, 'us_' || region_id || CASE WHEN region_id % 2 = 0 THEN '_north' ELSE '' END AS p FROM map_regions)")
def sign_roads(t: Tables) -> DataFrame:
    """Road numbers from the paths of sign textures."""
    path = F.concat(F.lit("/def/sign/atlas/us_"), "region_id", F.when(c("region_id") % 2 == 0, "_north").otherwise(""), F.lit(".mat"))
    return t("map_regions").select("region_id", labels.sign_road(path).alias("sign"))


@R.query(f"SELECT DISTINCT map_name, {_tok('token')} AS token, coalesce(look_offset, 0) AS look_offset, floor(coalesce(lane_offset, 0) * 100 + 0.5) / 100 AS lane_offset, coalesce(len(lanes_left), 0) AS n_left, coalesce(len(lanes_right), 0) AS n_right FROM road_looks")
def normalised_looks(t: Tables) -> DataFrame:
    """Looks with defaults in place of what is missing, and rounded offsets."""
    n = lambda k: F.coalesce(F.size(F.col(k)), F.lit(0))
    size = lambda k: F.when(c(k).isNull(), 0).otherwise(n(k)).cast("bigint")
    rounded = F.floor(F.coalesce("lane_offset", F.lit(0.0)) * 100 + 0.5) / 100
    return t("road_looks").select("map_name", token("token").alias("token"), F.coalesce("look_offset", F.lit(0.0)).alias("look_offset"), rounded.alias("lane_offset"), size("lanes_left").alias("n_left"), size("lanes_right").alias("n_right")).distinct()


@R.query(
    f"""WITH d AS (SELECT map_name, {_tok("token")} AS token, template_path, nodes, row_number() OVER (PARTITION BY map_name, {_tok("token")} ORDER BY arrived_at DESC, template_path) AS k FROM prefab_descriptions), u AS (SELECT DISTINCT map_name, {_tok("token")} AS token FROM prefabs)
    SELECT d.map_name, d.token, CASE WHEN contains(template_path, 'road') THEN 'Roads' ELSE 'Non-roads' END AS kind, (list_min(list_transform(nodes, lambda n: n.x)) + list_max(list_transform(nodes, lambda n: n.x))) / 2 AS x, (list_min(list_transform(nodes, lambda n: n.y)) + list_max(list_transform(nodes, lambda n: n.y))) / 2 AS y
    FROM d JOIN u ON u.map_name = d.map_name AND u.token = d.token WHERE k = 1 AND len(list_filter(nodes, lambda n: len(n.input_lanes) > 0 OR len(n.output_lanes) > 0)) > 1"""
)
def prefab_browser(t: Tables) -> DataFrame:
    """Descriptions that prefabs use, with more than one node with lanes, by kind, and the centre of their nodes."""
    newest = F.row_number().over(W.partitionBy("map_name", "token").orderBy(c("arrived_at").desc(), "template_path"))
    d = t("prefab_descriptions").select("map_name", token("token").alias("token"), "template_path", "nodes", "arrived_at").withColumn("k", newest).filter("k = 1")
    used = t("prefabs").select("map_name", token("token").alias("token")).distinct()
    d = d.join(used, ["map_name", "token"], "left_semi").filter(F.size(F.filter("nodes", lambda n: (F.size(n["input_lanes"]) > 0) | (F.size(n["output_lanes"]) > 0))) > 1)
    mid = lambda k: (F.array_min(F.transform("nodes", lambda n: n[k])) + F.array_max(F.transform("nodes", lambda n: n[k]))) / 2
    return d.select("map_name", "token", F.when(c("template_path").contains("road"), "Roads").otherwise("Non-roads").alias("kind"), mid("x").alias("x"), mid("y").alias("y"))


@R.query(
    """WITH d AS (SELECT o_orderkey AS request, o_custkey % 200 AS device FROM orders), v AS (SELECT user_id AS device, max_by(event_id, (ts, event_id)) AS viewer FROM events WHERE event_type = 'signup' GROUP BY 1), s AS (SELECT event_id, event_type, value FROM events)
    SELECT d.request, v.viewer, s.value FROM d LEFT JOIN v USING (device) LEFT JOIN s ON s.event_id = v.viewer"""
)
def two_hop_latest(t: Tables) -> DataFrame:
    """The newest sample behind each request: request to device, device to its newest viewer, viewer to its sample."""
    d = t("orders").select(c("o_orderkey").alias("request"), (c("o_custkey") % 200).alias("device"))
    v = t("events").filter("event_type = 'signup'").groupBy(c("user_id").alias("device")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("viewer"))
    s = t("events").select(c("event_id").alias("viewer"), "value")
    return d.join(v, "device", "left").join(s, "viewer", "left").select("request", "viewer", "value")


@R.query(
    """SELECT s.event_id AS subscription, k.event_type, max_by(k.event_id, (k.ts, k.event_id)) AS snapshot FROM events s JOIN events k ON k.user_id = s.user_id AND (k.ts, k.event_id) < (s.ts, s.event_id) WHERE s.event_type = 'signup' GROUP BY 1, 2"""
)
def subscribe_snapshot(t: Tables) -> DataFrame:
    """What a subscriber gets at once: the newest event of each type of its user before it subscribed."""
    e = t("events").select("user_id", "event_id", "event_type", "ts")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # the topics, a handful
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    latest = F.array(*[F.struct(F.lit(k).alias("event_type"), F.last(F.when(c("event_type") == k, c("event_id")), ignorenulls=True).over(before).alias("snapshot")) for k in kinds])
    got = e.withColumn("latest", latest).filter("event_type = 'signup'").select(c("event_id").alias("subscription"), F.explode("latest").alias("l"))
    return got.select("subscription", "l.event_type", "l.snapshot").filter("snapshot IS NOT NULL")


@R.query(
    """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM events),
    r AS (SELECT user_id, event_type, event_id, k, s AS made, false AS cached FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.k, CASE WHEN e.s - made > 36000000000 THEN e.s ELSE made END, e.s - made <= 36000000000 FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1)
    SELECT event_id, cached FROM r"""
)
def cached_requests(t: Tables) -> DataFrame:
    """Which requests a cache of ten hours answers."""
    return features.once_within(t("events"), ["user_id", "event_type"], "ts", "event_id", 36_000).select(c("ident").alias("event_id"), "cached")


@R.query(
    """SELECT DISTINCT point_id, CASE WHEN dlc_guard IS NULL THEN NULL ELSE dlc_guard IN (1, 2, 3) END AS known, CASE WHEN dlc_guard IS NULL THEN fixed_point AND NULL WHEN dlc_guard IN (1, 2, 3) THEN coalesce(fixed_point, NULL) ELSE false END AS shown FROM guard_points"""
)
def tri_state(t: Tables) -> DataFrame:
    """Predicates of three states: known, unknown, and not told."""
    known = c("dlc_guard").isin(1, 2, 3)
    return t("guard_points").select("point_id", known.alias("known"), (known & c("fixed_point")).alias("shown")).distinct()


@R.query(
    """SELECT s.s_suppkey AS step, CASE s_suppkey % 4 WHEN 0 THEN 'Depart' WHEN 1 THEN 'Turn left' WHEN 2 THEN 'Turn right' ELSE 'Arrive' END || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' onto ' || s_name END || CASE WHEN s_suppkey % 5 = 0 THEN ' toward ' || n_name ELSE '' END AS text FROM supplier s JOIN nation ON n_nationkey = s_nationkey"""
)
def step_texts(t: Tables) -> DataFrame:
    """Instructions of steps in words."""
    turn = F.element_at(F.array(*[F.lit(x) for x in ("depart", "turn_left", "turn_right", "arrive")]), (c("s_suppkey") % 4 + 1).cast("int"))
    own = t("supplier").join(t("nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    return own.select(c("s_suppkey").alias("step"), labels.instruction(turn, F.when(c("s_suppkey") % 3 != 0, c("s_name")), F.when(c("s_suppkey") % 5 == 0, c("n_name"))).alias("text"))
