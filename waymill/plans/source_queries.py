"""Queries of sources, sinks and line operators: round trips over whole tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.keys import uid
from waymill.functions.geometry import lon_lat
from waymill.operators import lines
from waymill.plans.geometry_queries import _LONLAT, _u, nodes
from waymill.plans.registry import Registry, Tables
from waymill.session import Scratch
from waymill.sources import readers, sinks, units

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col


@R.query(f"SELECT DISTINCT {_u('uid')} AS uid, x, y, {_u('forward_item_uid')} AS forward FROM nodes")
def json_table_scan(t: Tables) -> DataFrame:
    """Nodes written as JSON and read back with a declared schema; uids by the naming convention."""
    s = Scratch(t.spark, "json")
    own = t("nodes").select("uid", "x", "y", "z", "rotation", c("forward_item_uid").alias("forwardItemUid"))
    sinks.write_json(own, f"{s.root}/nodes.json")
    back = readers.json_table(t.spark, f"{s.root}/nodes.json", "uid string, x double, y double, forwardItemUid string", lines=True)
    return back.select("uid", "x", "y", c("forwardItemUid").alias("forward")).distinct()


@R.query(f"SELECT {_u('uid')} AS uid, x, y FROM roads WHERE NOT coalesce(is_hidden, false) AND map_name = 'usa' AND sqrt(x*x + y*y) <= 4000 GROUP BY ALL")
def registry_read(t: Tables) -> DataFrame:
    """A table of the registry with focus, without hidden rows, one row a key."""
    s = Scratch(t.spark, "registry")
    own = t("roads").filter("map_name = 'usa'").select(uid("uid").alias("uid"), "x", "y", c("is_hidden").alias("hidden"), c("is_secret").alias("secret"))
    sinks.write_json(own, f"{s.root}/usa-roads.json")
    return readers.MapTables(t.spark, s.root, "usa", ["roads"], lines=True).read("roads", (0.0, 0.0), 4000.0).select("uid", "x", "y")


@R.query("SELECT region_id AS id, map_name, len(ring) AS points FROM map_regions")
def geojson_round_trip(t: Tables) -> DataFrame:
    """Regions written as features, one a line, and read back."""
    s = Scratch(t.spark, "geojson")
    ring = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    own = t("map_regions").select(sinks.feature("Polygon", ring, region_id=c("region_id"), map_name=c("map_name")).alias("f"))
    sinks.write_features(own, "f", f"{s.root}/regions")
    back = readers.feature_lines(t.spark, f"{s.root}/regions")
    props = F.from_json("properties", "region_id bigint, map_name string")
    rings = F.from_json("coordinates", "array<array<array<double>>>")
    return back.filter("kind = 'Polygon'").select(props["region_id"].alias("id"), props["map_name"].alias("map_name"), F.size(rings[0]).cast("bigint").alias("points"))


@R.query("SELECT region_id AS id, map_name, len(ring) AS points FROM map_regions")
def collection_round_trip(t: Tables) -> DataFrame:
    """Regions written as one feature collection and read back."""
    s = Scratch(t.spark, "collection")
    ring = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    own = t("map_regions").select(sinks.feature("Polygon", ring, region_id=c("region_id"), map_name=c("map_name")).alias("f"))
    sinks.write_collection(own, "f", f"{s.root}/regions.geojson")
    back = readers.features(t.spark, f"{s.root}/regions.geojson")
    rings = F.from_json("coordinates", "array<array<array<double>>>")
    return back.select(c("properties")["region_id"].cast("bigint").alias("id"), c("properties")["map_name"].alias("map_name"), F.size(rings[0]).cast("bigint").alias("points"))


@R.query(
    """WITH v AS (SELECT DISTINCT file_path AS path, payload, list_transform(string_split(game_version, '.'), lambda v: CAST(v AS INT)) AS v FROM def_files), a AS (SELECT path, payload, v[1] AS major, v FROM v)
    SELECT path, md5(max_by(payload, (major, v))) AS h FROM a GROUP BY 1"""
)
def last_archive_wins(t: Tables) -> DataFrame:
    """Archives of files, one for each major version, laid over one another: the last one's content counts."""
    from waymill.operators.drift import version_key

    files = t("def_files").select(c("file_path").alias("path"), c("payload").alias("content"), version_key(c("game_version")).alias("v")).withColumn("major", c("v")[0])
    majors = sorted(r[0] for r in files.select("major").distinct().collect())  # archives, a handful
    newest = files.groupBy("major", "path").agg(F.max_by("content", "v").alias("content"))
    return readers.layered(*[newest.filter(c("major") == m) for m in majors]).select("path", F.md5("content").alias("h"))


@R.query(
    """SELECT l.map_name || ':' || l.token AS file, e.key AS key, e.val AS val FROM (SELECT DISTINCT map_name, token, lanes_left, lanes_right FROM road_looks) l, LATERAL (SELECT lanes_left[i] AS key, max_by(lanes_right[i], i) AS val
      FROM (SELECT unnest(range(1, least(len(lanes_left), len(lanes_right)) + 1)) AS i) WHERE lanes_left[i] IS NOT NULL AND lanes_right[i] IS NOT NULL GROUP BY 1) e"""
)
def locale_zip(t: Tables) -> DataFrame:
    """Parallel arrays of keys and values as rows, the last of equal keys counts (the lanes of every look)."""
    df = t("road_looks").select(F.concat_ws(":", "map_name", "token").alias("file"), c("lanes_left").alias("keys"), c("lanes_right").alias("vals")).distinct()
    return readers.locale_entries(df)


@R.query("SELECT doc AS name, md5(text) AS h FROM (SELECT coalesce(source, '') || '.txt' AS doc, arg_max(text, doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1)")
def zip_source(t: Tables) -> DataFrame:
    """Every text as a file of a zip archive named by its source, read by base name: the later of two of one name."""
    s = Scratch(t.spark, "zip")

    def packed(batches):
        for pdf in batches:
            box = io.BytesIO()
            with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
                for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"], strict=True):
                    z.writestr(f"{doc}/{source}.txt", text)
            yield pd.DataFrame({"first": [pdf["doc_id"].iloc[0]], "content": [box.getvalue()]})

    own = t("documents").filter("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    own = own.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    boxes = s.write(own.mapInPandas(packed, "first bigint, content binary"), "boxes")
    found = readers.unzipped(boxes.select(F.format_string("%020d", "first").alias("path"), "content"))
    return found.select("name", F.md5("content").alias("h"))


@R.query(f"SELECT map_name, node, CAST(row_number() OVER (ORDER BY map_name, node) - 1 AS BIGINT) AS number FROM (SELECT DISTINCT map_name, {_u('uid')} AS node FROM nodes)")
def dense_numbers(t: Tables) -> DataFrame:
    """Nodes numbered densely in order, for an export with short ids."""
    return sinks.numbered(t("nodes").select("map_name", uid("uid").alias("node")).distinct(), ["map_name", "node"])


@R.query("SELECT s_suppkey, round(s_acctbal, 2) AS distance, round(s_acctbal / 3, 2) AS nested FROM supplier")
def rounded_distances(t: Tables) -> DataFrame:
    """Fields named distance rounded at any depth."""
    df = t("supplier").select("s_suppkey", c("s_acctbal").alias("distance"), F.array(F.struct((c("s_acctbal") / 3).alias("distance"))).alias("edges"))
    return sinks.rounded(df).select("s_suppkey", "distance", c("edges")[0]["distance"].alias("nested"))


@R.query(f"SELECT map_name, uid, floor(lon * 100000 + 0.5) / 100000 AS lon, floor(lat * 100000 + 0.5) / 100000 AS lat FROM ({_LONLAT})")
def polyline_round_trip(t: Tables) -> DataFrame:
    """Positions encoded as polylines of five decimals and decoded."""
    lon, lat = lon_lat(c("map_name"), c("x"), c("y"))
    own = nodes(t).select("map_name", "uid", lines.encoded(F.array(F.struct(lon.alias("x"), lat.alias("y")))).alias("e"))
    p = own.select("map_name", "uid", lines.decoded(c("e"))[0].alias("p"))
    return p.select("map_name", "uid", c("p.x").alias("lon"), c("p.y").alias("lat"))


@R.query()
def simplified_rings(t: Tables) -> DataFrame:
    """Points of each ring before and after simplifying with a tolerance."""
    own = t("map_regions").select("region_id", "ring", lines.simplified(c("ring"), 200.0).alias("s"))
    return own.select("region_id", F.size("ring").alias("before"), F.size("s").alias("after"))


@R.query("SELECT doc_id AS id, len(regexp_extract_all(text, 'ferry_data : ')) AS n_units, len(regexp_extract_all(text, 'transit: ')) AS n_transit FROM documents WHERE starts_with(text, 'SiiNunit') AND ends_with(trim(text, chr(10) || ' '), '}')")
def unit_files(t: Tables) -> DataFrame:
    """Units and their transit properties in definition texts."""
    own = t("documents").filter(c("text").startswith("SiiNunit") & F.rtrim(F.regexp_replace("text", r"\s+$", "")).endswith("}"))
    rows = units.read_units(own)
    return rows.groupBy("id").agg(F.count_distinct("name").alias("n_units"), F.count_if(c("key") == "transit").alias("n_transit"))
