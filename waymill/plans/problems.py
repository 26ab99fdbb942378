"""The pN_ queries of the core: proximity, orphan references, nested records and drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.functions.keys import world
from waymill.operators import drift, orphans, proximity, shred
from waymill.session import table

RADIUS = 3.0


def guard_positions(points: DataFrame) -> DataFrame:
    """Guard points with fixed-point positions undone: world, id, x, y, dlc_guard."""
    scale = F.when(F.col("fixed_point"), 256.0).otherwise(1.0)
    return points.select(world().alias("world"), F.col("point_id").alias("id"), (F.col("x") / scale).alias("x"), (F.col("y") / scale).alias("y"), "dlc_guard").filter("id IS NOT NULL")


def entry_positions(entries: DataFrame) -> DataFrame:
    """Present road ends: world, id, x, y; incomplete positions are left out."""
    whole = entries.filter(F.col("entry_id").isNotNull() & (F.size("start_or_end") == 2))
    return whole.select(world().alias("world"), F.col("entry_id").alias("id"), F.col("start_or_end")[0].alias("x"), F.col("start_or_end")[1].alias("y"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Points near points, points near road ends, and the regions of points without a guard."""
    points = proximity.placed(guard_positions(table(spark, d, "guard_points")))
    own = points.select("world", "id", "x", "y").distinct()
    ends = proximity.placed(entry_positions(table(spark, d, "road_entries"))).distinct()
    probes = own.select(F.lit("point").alias("relation"), "*", F.lit(True).alias("self")).unionByName(ends.select(F.lit("entry").alias("relation"), "*", F.lit(False).alias("self")))
    near = proximity.near_pairs(own, probes, RADIUS).select("relation", F.col("probe_id").alias("left_id"), F.col("id").alias("right_id"))
    regions = table(spark, d, "map_regions").select(world().alias("world"), F.col("region_id").alias("region"), "ring")
    unguarded = points.filter("dlc_guard IS NULL").select("world", "id", "x", "y")
    within = proximity.regions_of(unguarded, regions).select(F.lit("region").alias("relation"), F.col("id").alias("left_id"), F.col("region").alias("right_id"))
    return near.unionByName(within).distinct()


def _map_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("roads", "prefabs", "waypoints", "nodes", "road_looks", "prefab_descriptions")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference that named no record when it arrived."""
    found = orphans.track(spark, _map_tables(spark, d)).all_found()
    return found.select("src_table", "src_key", "ref_field", "ref_key", F.date_format("arrived_at", "yyyy-MM").alias("arrival_ym")).distinct()


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Orphans found, reopened and still open at the end of each period of three months, by table and field."""
    return orphans.track(spark, _map_tables(spark, d)).all_snapshots()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each nested object of the declared collections with the path of its parent row."""
    rows = shred.flat_tables(table(spark, d, "nested_records")).filter(F.col("table_name").isin(*shred.DECLARED))
    return rows.select("record_id", "parent_path", "child_path").distinct()


def p3_connections(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of ferry connections with typed leaves and the link to the ferry's row."""
    columns = {"token": ("token", "string"), "price": ("price", "double"), "time": ("time", "bigint"), "distance": ("distance", "bigint")}
    return shred.typed_table(table(spark, d, "nested_records"), "$.ferryData.connections", columns).distinct()


def p3_table_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and records of each flat table, inferred ones and those of unknown kinds included."""
    rows = shred.flat_tables(table(spark, d, "nested_records")).select("record_id", "record_kind", "table_name", "child_path").distinct()
    return rows.groupBy("record_kind", "table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record_id").alias("n_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of shape between versions of a definition file."""
    return drift.shape_changes(table(spark, d, "def_files"))


#: Fields that moved to another place or are split out of one, which no renaming tells, approved for promotion.
MOVED = {"icon_mat": {"texture_source": ("material/ui/texture", "material/ui/tex")}, "localization": {"entry_key": ("keys",)}}


def _consistent(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        files = table(spark, d, "def_files")
        found = drift.approvals(drift.shape_changes(files.filter(F.col("file_kind") == kind)), kind)
        for column, names in MOVED.get(kind, {}).items():
            found[column] += tuple(n for n in names if n not in found[column])
        return drift.promote(drift.ingest(files, kind), kind, found)

    query.__doc__ = f"The consistent table of {kind} files, rescued values of renamed and approved fields replayed."
    return query


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_snapshots": p2_snapshots,
    "p3_found": p3_found,
    "p3_connections": p3_connections,
    "p3_table_sizes": p3_table_sizes,
    "p5_found": p5_found,
    **{f"p5_{kind}_table": _consistent(kind) for kind in drift.TARGETS},
}

_UID = "coalesce(nullif(regexp_extract({t}, '^(0x)?0*([0-9a-f]{{1,16}})$', 2), ''), {t})"


def _sql_token(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


def _sql_uid(c: str) -> str:
    return _UID.format(t=_sql_token(c))


def _sql_refs() -> str:
    one = "SELECT '{s}' AS src_table, {k} AS src_key, '{f}' AS ref_field, '{t}' AS ref_table, map_name, {r} AS ref_key, arrived_at FROM {x}"
    parts = [
        one.format(s="roads", k=_sql_uid("uid"), f="start_node_uid", t="nodes", r=_sql_uid("start_node_uid"), x="roads"),
        one.format(s="roads", k=_sql_uid("uid"), f="end_node_uid", t="nodes", r=_sql_uid("end_node_uid"), x="roads"),
        one.format(s="roads", k=_sql_uid("uid"), f="road_look_token", t="road_looks", r=_sql_token("road_look_token"), x="roads"),
        one.format(s="prefabs", k=_sql_uid("uid"), f="node_uids", t="nodes", r=_sql_uid("n"), x="(SELECT uid, map_name, arrived_at, unnest(node_uids) AS n FROM prefabs)"),
        one.format(s="prefabs", k=_sql_uid("uid"), f="token", t="prefab_descriptions", r=_sql_token("token"), x="prefabs"),
        one.format(s="waypoints", k="CAST(waypoint_id AS VARCHAR)", f="node_uid", t="nodes", r=_sql_uid("node_uid"), x="waypoints"),
    ]
    return " UNION ALL ".join(parts)


def _sql_decoded(x: str) -> str:
    """JSON text in a string counts as what it spells."""
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) ELSE {x} END)"


def _sql_list(name: str, source: str, key: str, label: str, own: bool = True) -> str:
    """Rows (record_id, parent, path, v) of the objects in a list below the rows of a source; a lone object is element 0.
    Without rows of its own the source's parent stays the parent."""
    value = _sql_decoded(f"json_extract(v, '$.{key}')") if key else "v"
    element = _sql_decoded("CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[' || i || ']') ELSE x END")
    n = "CASE json_type(x) WHEN 'ARRAY' THEN json_array_length(x) WHEN 'OBJECT' THEN 1 ELSE 0 END"
    return f"""{name} AS (SELECT record_id, {'path' if own else 'parent'} AS parent, path || '{label}[' || i || ']' AS path, e AS v FROM (SELECT *, {element} AS e FROM (SELECT *, unnest(range(CAST({n} AS BIGINT))) AS i
      FROM (SELECT record_id, parent, path, {value} AS x FROM {source}))) WHERE json_type(e) = 'OBJECT')"""


def _sql_map(name: str, source: str, key: str, own: bool) -> str:
    """Rows of a keyed collection: (record_id, parent, path, v); own: only objects, else whatever stands there."""
    value = _sql_decoded(f"""json_extract(x, '$."' || k || '"')""")
    return f"""{name} AS (SELECT record_id, '$' AS parent, '$.{key}[' || k || ']' AS path, v FROM (SELECT record_id, k, {value} AS v FROM (SELECT record_id, x, unnest(json_keys(x)) AS k
      FROM (SELECT record_id, {_sql_decoded(f"json_extract(v, '$.{key}')")} AS x FROM {source}) WHERE json_type(x) = 'OBJECT')){" WHERE json_type(v) = 'OBJECT'" if own else ""})"""


def _sql_one(name: str, source: str, key: str, label: str) -> str:
    value = _sql_decoded(f"json_extract(v, '$.{key}')")
    value = f"CASE WHEN json_type({value}) = 'ARRAY' AND json_array_length({value}) = 1 THEN {_sql_decoded(f'json_extract({value}, chr(36) || chr(91) || 0 || chr(93))')} ELSE {value} END"
    return f"{name} AS (SELECT record_id, path AS parent, path || '{label}' AS path, e AS v FROM (SELECT record_id, path, {value} AS e FROM {source}) WHERE json_type(e) = 'OBJECT')"


_SQL_NESTED = ", ".join(
    [
        "p0 AS (SELECT record_id, record_kind, CAST(payload AS JSON) AS v, '$' AS path, '$' AS parent FROM nested_records WHERE record_id IS NOT NULL AND json_valid(payload) AND json_type(CAST(payload AS JSON)) = 'OBJECT')",
        _sql_map("ferry", "(SELECT * FROM p0 WHERE record_kind = 'ferry')", "ferryData", True),
        _sql_list("con", "ferry", "connections", ".connections"),
        _sql_list("pt", "con", "intermediatePoints", ".intermediatePoints"),
        _sql_map("starts", "(SELECT * FROM p0 WHERE record_kind = 'lanes')", "lanes", False),
        _sql_list("lane", "starts", "", "", False),
        _sql_list("branch", "lane", "branches", ".branches"),
        _sql_list("sem", "branch", "semaphoresEncountered", ".semaphoresEncountered"),
        _sql_list("rule", "branch", "trafficRulesEncountered", ".trafficRulesEncountered"),
        _sql_list("seg", "(SELECT * FROM p0 WHERE record_kind = 'route')", "segments", ".segments"),
        _sql_list("step", "seg", "steps", ".steps"),
        _sql_one("man", "step", "maneuver", ".maneuver"),
        "hint AS (SELECT record_id, parent AS up, parent, path, v FROM (" + _sql_one("h", "man", "laneHint", ".laneHint")[len("h AS (") : -1] + "))",
        _sql_list("hl", "hint", "lanes", ".lanes", False),
        _sql_list("icon", "step", "trafficIcons", ".trafficIcons"),
    ]
)
_NESTED_TABLES = ("ferry", "con", "pt", "lane", "branch", "sem", "rule", "seg", "step", "man", "hl", "icon")
_LEAF_DOUBLE = "CASE WHEN json_type({x}) IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'HUGEINT') OR regexp_full_match({x}->>'$', '[+-]?[0-9]+(\\.[0-9]+)?') THEN TRY_CAST({x}->>'$' AS DOUBLE) END"
_LEAF_BIGINT = "CASE WHEN json_type({x}) IN ('UBIGINT', 'BIGINT') OR regexp_full_match({x}->>'$', '[+-]?[0-9]+') THEN TRY_CAST({x}->>'$' AS BIGINT) END"


def _leaf(kind: str, name: str) -> str:
    return kind.format(x=f"json_extract(v, '$.{name}')")


NESTED_CONNECTIONS = f"""{_SQL_NESTED}, leaf AS (SELECT DISTINCT record_id, parent AS parent_path, path AS child_path, CASE WHEN json_type(json_extract(v, '$.token')) = 'VARCHAR' THEN json_extract_string(v, '$.token') END AS token,
  {_leaf(_LEAF_DOUBLE, "price")} AS price, {_leaf(_LEAF_BIGINT, "time")} AS time, {_leaf(_LEAF_BIGINT, "distance")} AS distance FROM con)"""

ORACLES = {
    "p1_found": """
WITH g AS (SELECT DISTINCT map_name, point_id AS id, x / CASE WHEN fixed_point THEN 256.0 ELSE 1.0 END AS x, y / CASE WHEN fixed_point THEN 256.0 ELSE 1.0 END AS y, dlc_guard
           FROM guard_points WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
e AS (SELECT DISTINCT map_name, entry_id AS id, start_or_end[1] AS x, start_or_end[2] AS y FROM road_entries
      WHERE len(start_or_end) = 2 AND start_or_end[1] IS NOT NULL AND start_or_end[2] IS NOT NULL AND NOT isnan(start_or_end[1]) AND NOT isnan(start_or_end[2])),
v AS (SELECT region_id, map_name, ring, generate_subscripts(ring, 1) AS i FROM map_regions),
s AS (SELECT region_id, map_name, ring[i].x AS x1, ring[i].y AS y1, ring[CASE WHEN i = len(ring) THEN 1 ELSE i + 1 END].x AS x2, ring[CASE WHEN i = len(ring) THEN 1 ELSE i + 1 END].y AS y2 FROM v)
SELECT 'point' AS relation, a.id AS left_id, b.id AS right_id FROM g a JOIN g b ON a.map_name = b.map_name AND a.id < b.id AND abs(a.x - b.x) <= 3 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 9
UNION SELECT 'entry', a.id, b.id FROM e a JOIN g b ON a.map_name = b.map_name AND abs(a.x - b.x) <= 3 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 9
UNION (SELECT 'region', g.id, s.region_id FROM g JOIN s ON g.map_name = s.map_name AND g.dlc_guard IS NULL AND (s.y1 > g.y) <> (s.y2 > g.y) AND g.x < (s.x2 - s.x1) * (g.y - s.y1) / (s.y2 - s.y1) + s.x1
       GROUP BY g.id, s.region_id HAVING count(*) % 2 = 1)""",
    "p2_found": f"""
WITH r AS ({_sql_refs()}),
p AS (SELECT 'nodes' AS t, map_name AS m, {_sql_uid("uid")} AS k, arrived_at AS a, removed_at AS z FROM nodes
      UNION ALL SELECT 'road_looks', map_name, {_sql_token("token")}, arrived_at, removed_at FROM road_looks
      UNION ALL SELECT 'prefab_descriptions', map_name, {_sql_token("token")}, arrived_at, removed_at FROM prefab_descriptions)
SELECT DISTINCT src_table, src_key, ref_field, ref_key, strftime(arrived_at, '%Y-%m') AS arrival_ym FROM r
WHERE src_key IS NOT NULL AND ref_key IS NOT NULL AND ref_key <> '0' AND arrived_at IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM p WHERE p.t = r.ref_table AND p.m = r.map_name AND p.k = r.ref_key AND p.a <= r.arrived_at AND (p.z IS NULL OR p.z > r.arrived_at))""",
    "p3_found": f"WITH {_SQL_NESTED} " + " UNION ".join(f"SELECT record_id, parent AS parent_path, path AS child_path FROM {n}" for n in _NESTED_TABLES),
    "p3_connections": f"WITH {NESTED_CONNECTIONS} SELECT * FROM leaf",
    "p2_snapshots": f"""
WITH r AS (SELECT DISTINCT * FROM ({_sql_refs()}) WHERE ref_key IS NOT NULL AND ref_key <> '0' AND arrived_at IS NOT NULL AND src_key IS NOT NULL),
p AS (SELECT 'nodes' AS t, map_name AS m, {_sql_uid("uid")} AS k, arrived_at AS a, removed_at AS z FROM nodes
      UNION ALL SELECT 'road_looks', map_name, {_sql_token("token")}, arrived_at, removed_at FROM road_looks
      UNION ALL SELECT 'prefab_descriptions', map_name, {_sql_token("token")}, arrived_at, removed_at FROM prefab_descriptions),
lim AS (SELECT date_trunc('quarter', min(arrived_at))::TIMESTAMP AS lo, max(arrived_at) AS hi FROM r),
q AS (SELECT lo + to_months(CAST(3 * i AS INTEGER)) AS b, lo + to_months(CAST(3 * i + 3 AS INTEGER)) AS e FROM (SELECT lo, unnest(range(0, date_diff('quarter', lo, hi) + 1)) AS i FROM lim)),
f AS (SELECT q.e, r.* FROM r JOIN q ON r.arrived_at >= q.b AND r.arrived_at < q.e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.t = r.ref_table AND p.m = r.map_name AND p.k = r.ref_key AND p.a <= r.arrived_at AND (p.z IS NULL OR p.z > r.arrived_at))),
o AS (SELECT q.b, q.e, r.* FROM q JOIN r ON r.arrived_at < q.e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.t = r.ref_table AND p.m = r.map_name AND p.k = r.ref_key AND p.a < q.e AND (p.z IS NULL OR p.z > q.e))),
w AS (SELECT o.e, o.src_table, o.ref_field, prev.src_key IS NULL AND f.src_key IS NULL AS again FROM o
  LEFT JOIN o prev ON prev.e = o.b AND prev.src_table = o.src_table AND prev.src_key = o.src_key AND prev.ref_field = o.ref_field AND prev.map_name IS NOT DISTINCT FROM o.map_name AND prev.ref_key = o.ref_key AND prev.arrived_at = o.arrived_at
  LEFT JOIN f ON f.e = o.e AND f.src_table = o.src_table AND f.src_key = o.src_key AND f.ref_field = o.ref_field AND f.map_name IS NOT DISTINCT FROM o.map_name AND f.ref_key = o.ref_key AND f.arrived_at = o.arrived_at),
a AS (SELECT e, src_table, ref_field, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT e, src_table, ref_field, count(*) AS n, count(*) FILTER (again) AS again FROM w GROUP BY ALL)
SELECT coalesce(a.e, b.e) AS period_end, coalesce(a.src_table, b.src_table) AS src_table, coalesce(a.ref_field, b.ref_field) AS ref_field, coalesce(a.n, 0) AS new_orphans, coalesce(b.again, 0) AS reopened, coalesce(b.n, 0) AS open_orphans
FROM a FULL JOIN b ON a.e = b.e AND a.src_table = b.src_table AND a.ref_field = b.ref_field""",
}
