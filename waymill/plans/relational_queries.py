"""Queries of filters, joins, aggregates, sorts and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymill.functions import texts
from waymill.functions.keys import token, uid
from waymill.operators import relational as rel
from waymill.plans.geometry_queries import _u
from waymill.plans.registry import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col


def _tok(col: str) -> str:
    return f"nullif(lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g')), '')"


# filters and predicates


@R.query(
    """SELECT DISTINCT n.map_name, n.uid FROM nodes n, (SELECT ring FROM map_regions WHERE lower(region_name) = 'torford' OR starts_with(lower(region_name), 'tor') ORDER BY lower(region_name) <> 'torford', region_id LIMIT 1) r
       WHERE sqrt(pow(n.x - ring[1].x, 2) + pow(n.y - ring[1].y, 2)) <= 60000 + 1000"""
)
def focus_radius(t: Tables) -> DataFrame:
    """Nodes within a padded radius of a place given by name (in any case) or by the start of a token."""
    name = F.lower("region_name")
    hit = t("map_regions").filter((name == "torford") | name.startswith("tor")).orderBy(name != "torford", "region_id").select(F.col("ring")[0].alias("p")).first()
    return rel.focus(t("nodes"), (hit.p.x, hit.p.y) if hit else None, 60_000, 1_000).select("map_name", "uid").distinct()


@R.query(
    f"""SELECT r.map_name, count(*) AS n, count(*) FILTER (secret) AS n_secret, count(*) FILTER (hidden) AS n_hidden FROM (
      SELECT map_name, CASE WHEN k IN (SELECT {_u("road_feature")} FROM road_entries WHERE left_lanes = 0) THEN true ELSE is_secret END AS secret,
        CASE WHEN k IN (SELECT {_u("road_feature")} FROM road_entries WHERE left_lanes = 0) THEN NULL ELSE is_hidden END AS hidden
      FROM (SELECT DISTINCT map_name, {_u("uid")} AS k, is_secret, is_hidden FROM roads)) r GROUP BY 1"""
)
def override_secret(t: Tables) -> DataFrame:
    """Overrides by uid turn rows secret and no longer hidden before any filter."""
    keys = t("road_entries").filter("left_lanes = 0").select(uid("road_feature").alias("k")).filter("k IS NOT NULL")
    roads = t("roads").select("map_name", uid("uid").alias("k"), "is_secret", "is_hidden").distinct()
    out = rel.force(roads, keys, "k", is_secret=F.lit(True), is_hidden=F.lit(None).cast("boolean"))
    return out.groupBy("map_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_secret").alias("n_secret"), F.count_if("is_hidden").alias("n_hidden"))


@R.query(
    f"""SELECT DISTINCT map_name, {_u("uid")} AS prefab FROM prefabs WHERE NOT coalesce(is_hidden, false) OR {_tok("token")} IN (SELECT {_tok("token")} FROM prefab_descriptions WHERE template_path LIKE '%comp%')"""
)
def hidden_exempt(t: Tables) -> DataFrame:
    """Hidden prefabs are dropped unless their description is a company's."""
    exempt = t("prefab_descriptions").filter(c("template_path").contains("comp")).select(token("token").alias("k"))
    own = t("prefabs").select("map_name", uid("uid").alias("prefab"), token("token").alias("k"), "is_hidden")
    return rel.without_hidden(own, exempt.filter("k IS NOT NULL"), "k").select("map_name", "prefab").distinct()


@R.query(
    """SELECT dlc_guard, CASE WHEN (dlc_guard & 1 = 0 OR 1 IN (1, 4, 8)) AND (dlc_guard & 2 = 0) AND (dlc_guard & 16 = 0) THEN true ELSE false END AS enabled, count(*) AS n
       FROM (SELECT DISTINCT point_id, map_name, x, y, dlc_guard FROM guard_points WHERE dlc_guard IS NOT NULL) GROUP BY 1, 2"""
)
def guard_enabled(t: Tables) -> DataFrame:
    """A guard, read as a set of parts, is enabled when every part is selected."""
    own = t("guard_points").filter("dlc_guard IS NOT NULL").select("point_id", "map_name", "x", "y", "dlc_guard").distinct()
    parts = F.filter(F.array(*[F.lit(1 << i) for i in range(5)]), lambda b: c("dlc_guard").bitwiseAND(b) != 0)
    return own.withColumn("enabled", rel.enabled(parts, [1, 4, 8])).groupBy("dlc_guard", "enabled").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A') OR (l_linestatus = 'O' AND l_quantity < 10) OR (l_linestatus = 'F' AND l_discount > 0.05) GROUP BY ALL"""
)
def visibility_any_all(t: Tables) -> DataFrame:
    """Rows that meet any of several groups of conditions."""
    keep = rel.any_of(c("l_returnflag").isin("A"), rel.all_of(c("l_linestatus") == "O", c("l_quantity") < 10), rel.all_of(c("l_linestatus") == "F", c("l_discount") > 0.05))
    return t("lineitem").filter(keep).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


_LANES = "list_concat(coalesce(lanes_left, []), coalesce(lanes_right, []))"


@R.query(
    f"""SELECT map_name, token, CASE WHEN len(l) = 0 THEN 'local' WHEN len(list_filter(l, lambda v: contains(v, 'freeway') OR contains(v, 'motorway'))) > 0 THEN 'freeway'
      WHEN len(list_filter(l, lambda v: contains(v, 'divided') OR contains(v, 'expressway'))) > 0 THEN 'divided'
      WHEN len(list_filter(l, lambda v: contains(v, 'local') OR contains(v, 'no_vehicles') OR contains(v, 'side_road') OR contains(v, 'slow_road'))) > 0 THEN 'local'
      WHEN len(list_filter(l, lambda v: contains(v, 'tram'))) > 0 THEN 'tram' WHEN len(list_filter(l, lambda v: contains(v, 'train'))) > 0 THEN 'train' ELSE 'unknown' END AS road_type,
      CASE WHEN len(list_filter(l, lambda v: contains(v, 'freeway'))) > 0 THEN 'freeway' WHEN len(list_filter(l, lambda v: contains(v, 'motorway'))) > 0 THEN 'motorway'
      WHEN len(list_filter(l, lambda v: contains(v, 'expressway'))) > 0 THEN 'expressway' WHEN len(list_filter(l, lambda v: contains(v, 'divided'))) > 0 THEN 'dividedRoad'
      WHEN len(list_filter(l, lambda v: contains(v, 'slow_road'))) > 0 THEN 'slowRoad' ELSE 'localRoad' END AS speed_class
      FROM (SELECT DISTINCT map_name, token, {_LANES} AS l FROM road_looks)"""
)
def road_classes(t: Tables) -> DataFrame:
    """Road type and speed class by prioritized parts of lane names."""
    lanes = F.concat(F.coalesce("lanes_left", F.array().cast("array<string>")), F.coalesce("lanes_right", F.array().cast("array<string>")))
    own = t("road_looks").select("map_name", "token", lanes.alias("l")).distinct()
    kind = texts.any_lane(c("l"), [(("freeway", "motorway"), "freeway"), (("divided", "expressway"), "divided"), (("local", "no_vehicles", "side_road", "slow_road"), "local"), (("tram",), "tram"), (("train",), "train")], "unknown")
    speed = texts.any_lane(c("l"), [(("freeway",), "freeway"), (("motorway",), "motorway"), (("expressway",), "expressway"), (("divided",), "dividedRoad"), (("slow_road",), "slowRoad")], "localRoad")
    return own.select("map_name", "token", F.when(F.size("l") == 0, "local").otherwise(kind).alias("road_type"), speed.alias("speed_class"))


@R.query(
    """SELECT dlc_guard, (dlc_guard & 6) <> 0 AS masked, (dlc_guard >> 2) AS shifted, count(*) AS n FROM (SELECT DISTINCT map_name, uid, dlc_guard FROM roads WHERE dlc_guard IS NOT NULL) GROUP BY ALL"""
)
def flag_bits(t: Tables) -> DataFrame:
    """Flags by mask and shift."""
    own = t("roads").filter("dlc_guard IS NOT NULL").select("map_name", "uid", "dlc_guard").distinct()
    return own.groupBy("dlc_guard", (c("dlc_guard").bitwiseAND(6) != 0).alias("masked"), F.shiftright("dlc_guard", 2).alias("shifted")).agg(F.count(F.lit(1)).alias("n"))


@R.query(
    """SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 OR o_orderpriority LIKE '1%' THEN 'in' WHEN o_totalprice <= 50000 THEN 'near' ELSE 'state' END AS place FROM orders"""
)
def location_class(t: Tables) -> DataFrame:
    """In, near, or beyond, by distance tiers and the start of a name."""
    near = F.when((c("o_totalprice") <= 1000) | c("o_orderpriority").startswith("1"), "in").when(c("o_totalprice") <= 50_000, "near").otherwise("state")
    return t("orders").select("o_orderkey", near.alias("place"))


@R.query(
    """SELECT map_name, token, [v FOR v IN lanes_left IF contains(v, 'local')][1] AS first_local FROM (SELECT DISTINCT map_name, token, lanes_left FROM road_looks) WHERE len([v FOR v IN lanes_left IF contains(v, 'local')]) > 0"""
)
def first_match_in_array(t: Tables) -> DataFrame:
    """First array element that meets a condition."""
    own = t("road_looks").select("map_name", "token", F.get(F.filter("lanes_left", lambda v: v.contains("local")), F.lit(0)).alias("first_local")).distinct()
    return own.filter("first_local IS NOT NULL")


# joins

_ITEMS = f"""SELECT map_name, {_u("start_node_uid")} AS node FROM roads UNION ALL SELECT map_name, {_u("end_node_uid")} FROM roads UNION ALL SELECT map_name, {_u("n")} FROM (SELECT map_name, unnest(node_uids) AS n FROM prefabs)"""


def item_nodes(t: Tables) -> DataFrame:
    roads, prefabs = t("roads"), t("prefabs")
    parts = [roads.select("map_name", uid("start_node_uid").alias("node")), roads.select("map_name", uid("end_node_uid").alias("node")), prefabs.select("map_name", F.explode("node_uids").alias("n")).select("map_name", uid("n").alias("node"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query(f"SELECT DISTINCT n.map_name, {_u('n.uid')} AS node FROM nodes n WHERE EXISTS (SELECT 1 FROM ({_ITEMS}) i WHERE i.map_name = n.map_name AND i.node = {_u('n.uid')})")
def semi_referenced(t: Tables) -> DataFrame:
    """Nodes that an item refers to."""
    return t("nodes").select("map_name", uid("uid").alias("node")).join(item_nodes(t), ["map_name", "node"], "left_semi").distinct()


@R.query(f"SELECT DISTINCT n.map_name, {_u('n.uid')} AS node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM ({_ITEMS}) i WHERE i.map_name = n.map_name AND i.node = {_u('n.uid')})")
def anti_islands(t: Tables) -> DataFrame:
    """Nodes that no item refers to."""
    return t("nodes").select("map_name", uid("uid").alias("node")).join(item_nodes(t), ["map_name", "node"], "left_anti").distinct()


@R.query(
    f"""SELECT map_name, coalesce(found_in, 'none') AS found_in, count(*) AS n FROM (SELECT n.map_name, n.item, CASE WHEN EXISTS (SELECT 1 FROM roads r WHERE {_u("r.uid")} = n.item) THEN 'roads' WHEN EXISTS (SELECT 1 FROM prefabs p WHERE {_u("p.uid")} = n.item) THEN 'prefabs' END AS found_in
      FROM (SELECT DISTINCT map_name, {_u("forward_item_uid")} AS item FROM nodes WHERE {_u("forward_item_uid")} <> '0') n) GROUP BY ALL"""
)
def fallback_lookup(t: Tables) -> DataFrame:
    """The first of several tables that knows an item."""
    own = t("nodes").select("map_name", uid("forward_item_uid").alias("item")).filter("item <> '0'").distinct()
    known = [(name, t(name).select(uid("uid").alias("item"))) for name in ("roads", "prefabs")]
    found = rel.first_of(own, "item", *known)
    return found.groupBy("map_name", F.coalesce("found_in", F.lit("none")).alias("found_in")).agg(F.count(F.lit(1)).alias("n"))


@R.query(
    f"""SELECT r.map_name, count(*) AS n, count(l.token) AS matched, sum(coalesce(l.look_offset, 0)) AS offsets FROM (SELECT DISTINCT map_name, {_u("uid")} AS road, {_tok("road_look_token")} AS look FROM roads) r
      LEFT JOIN (SELECT map_name, {_tok("token")} AS token, max(look_offset) AS look_offset FROM road_looks GROUP BY 1, 2) l ON l.map_name = r.map_name AND l.token = r.look GROUP BY 1"""
)
def optional_lookup(t: Tables) -> DataFrame:
    """A lookup by a composite key that may find nothing, with a default."""
    roads = t("roads").select("map_name", uid("uid").alias("road"), token("road_look_token").alias("token")).distinct()
    looks = t("road_looks").groupBy("map_name", token("token").alias("token")).agg(F.max("look_offset").alias("look_offset"), F.lit(1).alias("hit"))
    both = roads.join(looks, ["map_name", "token"], "left")
    return both.groupBy("map_name").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("matched"), F.sum(F.coalesce("look_offset", F.lit(0.0))).alias("offsets"))


@R.query(
    """SELECT DISTINCT map_name, token FROM road_looks WHERE len(list_intersect(lanes_left, ['traffic_lane.road.local', 'traffic_lane.road.freeway', 'traffic_lane.road.divided'])) > 0"""
)
def containment_array(t: Tables) -> DataFrame:
    """Rows whose array shares an element with a kept set."""
    kept = F.array(*map(F.lit, ("traffic_lane.road.local", "traffic_lane.road.freeway", "traffic_lane.road.divided")))
    return t("road_looks").filter(F.arrays_overlap("lanes_left", kept)).select("map_name", "token").distinct()


@R.query(
    """WITH o AS (SELECT DISTINCT map_name, token, unnest(lanes_right) AS lane FROM road_looks), i AS (SELECT DISTINCT map_name, token, unnest(lanes_left) AS lane FROM road_looks)
       SELECT o.map_name, o.token AS src, i.token AS dst, count(DISTINCT o.lane) AS shared FROM o JOIN i ON i.map_name = o.map_name AND i.lane = o.lane AND i.token <> o.token GROUP BY ALL"""
)
def cargo_match(t: Tables) -> DataFrame:
    """What goes out here and comes in there: a many-to-many match of two exploded arrays."""
    looks = t("road_looks")
    out = looks.select("map_name", c("token").alias("src"), F.explode("lanes_right").alias("lane")).distinct()
    inn = looks.select("map_name", c("token").alias("dst"), F.explode("lanes_left").alias("lane")).distinct()
    return out.join(inn, ["map_name", "lane"]).filter("src <> dst").groupBy("map_name", "src", "dst").agg(F.count_distinct("lane").alias("shared"))


@R.query(
    f"""SELECT f AS field, count(*) AS n, count(DISTINCT k) AS n_keys FROM (
      SELECT 'roads.start_node_uid' AS f, map_name, {_u("start_node_uid")} AS k, 'n' AS p FROM roads UNION ALL SELECT 'waypoints.node_uid', map_name, {_u("node_uid")}, 'n' FROM waypoints
      UNION ALL SELECT 'prefabs.token', map_name, {_tok("token")}, 'd' FROM prefabs) r
      WHERE k IS NOT NULL AND k <> '0' AND NOT (p = 'n' AND EXISTS (SELECT 1 FROM nodes n WHERE n.map_name = r.map_name AND {_u("n.uid")} = r.k)) AND NOT (p = 'd' AND EXISTS (SELECT 1 FROM prefab_descriptions d WHERE d.map_name = r.map_name AND {_tok("d.token")} = r.k)) GROUP BY 1"""
)
def integrity_report(t: Tables) -> DataFrame:
    """References that no record ever answers, counted by field; nothing is dropped."""
    nodes = t("nodes").select(F.concat_ws(":", "map_name", uid("uid")).alias("k"))
    looks = t("prefab_descriptions").select(F.concat_ws(":", "map_name", token("token")).alias("k"))
    out = None
    for field, key, parents in (("roads.start_node_uid", uid("start_node_uid"), nodes), ("waypoints.node_uid", uid("node_uid"), nodes), ("prefabs.token", token("token"), looks)):
        refs = t(field.split(".")[0]).select("map_name", key.alias("v")).filter("v IS NOT NULL AND v <> '0'").select(F.concat_ws(":", "map_name", "v").alias("k"), "v")
        part = rel.dangling(refs, "k", parents).select(F.lit(field).alias("field"), "v")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("n_keys"))


@R.query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'SET' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer
       UNION ALL SELECT -s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'SET' END, NULL FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey > 0"""
)
def overlay_meta(t: Tables) -> DataFrame:
    """Metadata laid over a table: a missing value keeps, null overwrites, new keys are appended."""
    base = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    keys = t("customer").filter("c_custkey % 3 <> 2").select("c_custkey").unionByName(t("supplier").filter("s_suppkey % 7 = 0 AND s_suppkey > 0").select((-c("s_suppkey")).alias("c_custkey")))
    meta = keys.select("c_custkey", F.when(F.abs("c_custkey") % 3 == 1, "SET").alias("c_mktsegment"), F.lit(True).alias("c_mktsegment_set"))
    return rel.overlay(base, meta, "c_custkey", ["c_mktsegment"])


@R.query(
    """SELECT n_name, r_name, coalesce(s.s_name, 'nobody') AS s_name FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON s_nationkey = n_nationkey"""
)
def segment_place(t: Tables) -> DataFrame:
    """A chain of lookups with a default text at its end."""
    rich = t("supplier").filter("s_acctbal > 9000").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("s_name"))
    own = t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey")).join(rich, "n_nationkey", "left")
    return own.select("n_name", "r_name", F.coalesce("s_name", F.lit("nobody")).alias("s_name"))


@R.query(
    """SELECT o_orderkey, c_name, l.n_lines FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'"""
)
def mandatory_lookup(t: Tables) -> DataFrame:
    """Lookups that must match."""
    lines = t("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    own = t("orders").filter("o_orderstatus = 'F'").join(t("customer"), c("o_custkey") == c("c_custkey")).join(lines, "o_orderkey")
    return own.select("o_orderkey", "c_name", "n_lines")


@R.query(
    """SELECT point_id, coalesce((SELECT max(z) FROM (VALUES (-4000, -4000, 0, 0, 60), (0, 0, 4000, 4000, 120), (-2000, 0, 0, 3000, 180)) v(x0, y0, x1, y1, z) WHERE px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1), 0) AS zone
       FROM (SELECT DISTINCT point_id, CASE WHEN fixed_point THEN x / 256 ELSE x END AS px, CASE WHEN fixed_point THEN y / 256 ELSE y END AS py FROM guard_points WHERE x IS NOT NULL AND y IS NOT NULL)"""
)
def extent_interval_lookup(t: Tables) -> DataFrame:
    """The secondary zone whose extent holds a point, else the default."""
    zones = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1", "z"), z, strict=True)]) for z in ((-4000, -4000, 0, 0, 60), (0, 0, 4000, 4000, 120), (-2000, 0, 0, 3000, 180))])
    s = F.when(c("fixed_point"), 256.0).otherwise(1.0)
    own = t("guard_points").filter("x IS NOT NULL AND y IS NOT NULL").select("point_id", (c("x") / s).alias("px"), (c("y") / s).alias("py")).distinct()
    hit = F.filter(zones, lambda z: c("px").between(z["x0"], z["x1"]) & c("py").between(z["y0"], z["y1"]))
    return own.select("point_id", F.coalesce(F.array_max(F.transform(hit, lambda z: z["z"])), F.lit(0)).alias("zone"))


# aggregates


@R.query(
    """SELECT map_name, region_id, region_name || CASE WHEN count(*) OVER (PARTITION BY map_name, region_name) > 1 THEN ' ' || region_id ELSE '' END AS label FROM map_regions"""
)
def disambiguate(t: Tables) -> DataFrame:
    """Labels that several rows of a map share get a suffix."""
    return t("map_regions").select("map_name", "region_id", rel.disambiguated(t("map_regions"), ["map_name"], "region_name", c("region_id").cast("string")).alias("label"))


@R.query("SELECT map_name, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1, floor(min(z)) AS low, floor(max(z)) AS high, CAST(floor(max(z)) - floor(min(z)) + 1 AS BIGINT) AS levels FROM nodes GROUP BY 1")
def extents(t: Tables) -> DataFrame:
    """Extent of the positions and levels of the heights."""
    z0, z1 = F.floor(F.min("z")), F.floor(F.max("z"))
    return t("nodes").groupBy("map_name").agg(*[F.round(f(k), 6).alias(f"{k}{i}") for k in "xy" for i, f in ((0, F.min), (1, F.max))], z0.cast("double").alias("low"), z1.cast("double").alias("high"), (z1 - z0 + 1).alias("levels"))


@R.query("SELECT region_id, round(avg(v.x), 4) AS x, round(avg(v.y), 4) AS y, count(*) AS n FROM (SELECT region_id, unnest(ring) AS v FROM map_regions) GROUP BY 1")
def centroids(t: Tables) -> DataFrame:
    """Mean of every ring's vertices."""
    v = t("map_regions").select("region_id", F.explode("ring").alias("v"))
    return v.groupBy("region_id").agg(F.round(F.avg("v.x"), 4).alias("x"), F.round(F.avg("v.y"), 4).alias("y"), F.count(F.lit(1)).alias("n"))


@R.query("SELECT map_name, CAST(floor(x / 4000) AS BIGINT) AS sx, CAST(floor(y / 4000) AS BIGINT) AS sy, count(DISTINCT uid) AS n FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL")
def sectors(t: Tables) -> DataFrame:
    """Sectors that hold nodes, with how many."""
    own = t("nodes").filter("x IS NOT NULL AND y IS NOT NULL")
    return own.groupBy("map_name", F.floor(c("x") / 4000).alias("sx"), F.floor(c("y") / 4000).alias("sy")).agg(F.count_distinct("uid").alias("n"))


@R.query("SELECT l_partkey, l_suppkey, min(l_extendedprice) AS shortest, count(*) AS n FROM lineitem GROUP BY ALL")
def shortest_per_pair(t: Tables) -> DataFrame:
    """Least value of each (source, target)."""
    return t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("shortest"), F.count(F.lit(1)).alias("n"))


@R.query("SELECT event_type, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM (SELECT event_type, CAST(CAST(value AS INT) % 10 AS VARCHAR) AS k FROM events WHERE value IS NOT NULL) GROUP BY 1")
def facility_union(t: Tables) -> DataFrame:
    """Union of sets by group, sorted."""
    k = (F.round("value").cast("int") % 10).cast("string")
    return t("events").filter("value IS NOT NULL").groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set(k)), ",").alias("keys"))


@R.query(
    "SELECT event_type, b.le, CAST(sum(CASE WHEN value <= b.le THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events, (SELECT unnest([10.0, 20.0, 40.0, 80.0, 160.0, 320.0, 640.0]::DOUBLE[] || ['inf'::DOUBLE]) AS le) b WHERE value IS NOT NULL GROUP BY ALL"
)
def histogram_exp(t: Tables) -> DataFrame:
    """Cumulative exponential buckets by event type."""
    return rel.histogram(t("events").filter("value IS NOT NULL"), ["event_type"], c("value"), 10, 2, 7)


@R.query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS n_big, count(DISTINCT o_custkey) AS customers, round(max(o_totalprice), 2) AS most FROM orders GROUP BY 1")
def counters(t: Tables) -> DataFrame:
    """Counters and maxima by group."""
    return t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("o_totalprice") > 100_000).alias("n_big"), F.count_distinct("o_custkey").alias("customers"), F.round(F.max("o_totalprice"), 2).alias("most"))


@R.query("SELECT l_orderkey, round(sum(l_quantity), 2) AS quantity, round(sum(CASE WHEN l_linenumber = 1 THEN 0.25 ELSE 1 END * l_quantity), 2) AS remaining FROM lineitem GROUP BY 1")
def remaining_summary(t: Tables) -> DataFrame:
    """Totals of a route's steps, and what remains when a part of the first one is done."""
    part = F.when(c("l_linenumber") == 1, 0.25).otherwise(1.0)
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(part * c("l_quantity")), 2).alias("remaining"))


# duplicates and sets


@R.query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"""
)
def dedupe_last(t: Tables) -> DataFrame:
    """Last row of each key."""
    return rel.keep_last(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@R.query(
    """SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_ts DESC, event_type) AS INT) AS pos, last_id FROM (SELECT user_id, event_type, min(ts) AS first_ts, max_by(event_id, (ts, event_id)) AS last_id FROM events GROUP BY ALL)"""
)
def preview_dedupe(t: Tables) -> DataFrame:
    """The last value of each key at its first place, in reverse order."""
    one = t("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))
    pos = F.row_number().over(W.partitionBy("user_id").orderBy(c("first_ts").desc(), "event_type"))
    return one.select("user_id", "event_type", pos.alias("pos"), "last_id")


@R.query(
    f"""SELECT map_name, least(a, b) AS pair_a, greatest(a, b) AS pair_b, arg_min(match_id, (matched_at, match_id)) AS first_match FROM (SELECT *, {_u("feature_a")} AS a, {_u("feature_b")} AS b FROM road_matches) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL"""
)
def pair_dedupe(t: Tables) -> DataFrame:
    """One row for each unordered pair, the first in time."""
    own = t("road_matches").select("map_name", F.concat_ws(":", "map_name", uid("feature_a")).alias("ka"), uid("feature_a").alias("a"), uid("feature_b").alias("b"), "matched_at", "match_id").filter("a IS NOT NULL AND b IS NOT NULL")
    own = own.withColumns({"a2": F.concat_ws(":", "map_name", "a"), "b2": F.concat_ws(":", "map_name", "b")})
    first = rel.keep_first_pair(own, "a2", "b2", ["matched_at", "match_id"])
    return first.select("map_name", F.least("a", "b").alias("pair_a"), F.greatest("a", "b").alias("pair_b"), c("match_id").alias("first_match"))


@R.query(
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
       UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
       UNION ALL SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
       UNION ALL SELECT 'all', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def set_operations(t: Tables) -> DataFrame:
    """Union, intersection, difference and concatenation of two selections."""
    a, b = (t("lineitem").filter(c("l_returnflag") == f).select("l_partkey") for f in "AR")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "all": a.unionByName(b)}
    out = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@R.query(
    """SELECT map_name, token, len(list_distinct(lanes_left)) = len(list_distinct(lanes_right)) AND len(list_intersect(lanes_left, lanes_right)) = len(list_distinct(lanes_left)) AS same,
       len(list_filter(list_distinct(lanes_left), lambda v: NOT list_contains(lanes_right, v))) AS only_left FROM (SELECT DISTINCT map_name, token, lanes_left, lanes_right FROM road_looks WHERE lanes_left IS NOT NULL AND lanes_right IS NOT NULL)"""
)
def array_sets(t: Tables) -> DataFrame:
    """Equality and difference of two arrays taken as sets."""
    own = t("road_looks").filter("lanes_left IS NOT NULL AND lanes_right IS NOT NULL").select("map_name", "token", "lanes_left", "lanes_right").distinct()
    return own.select("map_name", "token", rel.same_set(c("lanes_left"), c("lanes_right")).alias("same"), F.size(F.array_except("lanes_left", "lanes_right")).cast("bigint").alias("only_left"))


@R.query("SELECT count(*) AS n, count(DISTINCT uid) AS n_uids FROM (SELECT DISTINCT * FROM roads)")
def distinct_rows(t: Tables) -> DataFrame:
    """Rows without exact repeats."""
    return t("roads").distinct().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("n_uids"))


# sorts and limits


@R.query(
    """SELECT map_name, point_id, round(d, 4) AS d FROM (SELECT *, row_number() OVER (PARTITION BY map_name ORDER BY d, point_id) AS k FROM (SELECT DISTINCT map_name, point_id, sqrt(px*px + py*py) AS d FROM (SELECT map_name, point_id, CASE WHEN fixed_point THEN x / 256 ELSE x END AS px, CASE WHEN fixed_point THEN y / 256 ELSE y END AS py FROM guard_points
       WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y))) WHERE d <= 6000) WHERE k <= 10"""
)
def nearby_topk(t: Tables) -> DataFrame:
    """The ten points of each map nearest to a place, within a radius."""
    s = F.when(c("fixed_point"), 256.0).otherwise(1.0)
    own = t("guard_points").filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    d = own.select("map_name", "point_id", F.sqrt(c("x") / s * (c("x") / s) + c("y") / s * (c("y") / s)).alias("d")).distinct()
    near = F.row_number().over(W.partitionBy("map_name").orderBy("d", "point_id"))
    return d.filter("d <= 6000").withColumn("k", near).filter("k <= 10").select("map_name", "point_id", F.round("d", 4).alias("d"))


@R.query(
    """SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, p_brand IS NULL, p_brand, CASE WHEN p_type LIKE '%BRASS' THEN 0 WHEN p_type LIKE '%STEEL' THEN 1 ELSE 2 END, p_name, p_partkey) AS INT) AS pos FROM part ORDER BY pos LIMIT 100"""
)
def ranked_search(t: Tables) -> DataFrame:
    """The first hundred results ordered by score, presence and text of a name, kind priority and label."""
    kind = F.when(c("p_type").endswith("BRASS"), 0).when(c("p_type").endswith("STEEL"), 1).otherwise(2)
    top = t("part").orderBy(c("p_size").desc(), c("p_brand").isNull(), "p_brand", kind, "p_name", "p_partkey").limit(100)
    w = W.orderBy(c("p_size").desc(), c("p_brand").isNull(), "p_brand", kind, "p_name", "p_partkey")
    return top.select("p_partkey", F.row_number().over(w).alias("pos"))


@R.query(
    """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_linenumber) AS INT) AS pos FROM lineitem"""
)
def pinned_order(t: Tables) -> DataFrame:
    """Order within a group with marked rows last."""
    w = W.partitionBy("l_orderkey").orderBy(F.when(c("l_returnflag") == "R", 1).otherwise(0), "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("pos"))


@R.query("SELECT l_orderkey, min_by(l_linenumber, (l_extendedprice, l_linenumber)) AS cheapest, max_by(l_linenumber, (l_extendedprice, -l_linenumber)) AS dearest FROM lineitem GROUP BY 1")
def argmin_picks(t: Tables) -> DataFrame:
    """Least and greatest element of each group with ties to the smaller number."""
    return t("lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("cheapest"), F.max_by("l_linenumber", F.struct("l_extendedprice", -c("l_linenumber"))).alias("dearest"))


@R.query(
    """SELECT o_orderpriority, string_agg(o_orderstatus || ':' || n, ' ' ORDER BY o_orderstatus) AS listed FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1"""
)
def grouped_lists(t: Tables) -> DataFrame:
    """Groups gathered into ordered lists after they were counted."""
    one = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))), lambda v: F.concat_ws(":", v["o_orderstatus"], v["n"].cast("string"))), " ").alias("listed"))
