"""Queries of text functions and searches over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions import texts
from waymill.functions.keys import uid, uid_of_rank, uid_rank
from waymill.plans.geometry_queries import _u
from waymill.plans.registry import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col


@R.query(
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ')) AS h FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\x00-\x7F]')"""
)
def tag_strip(t: Tables) -> DataFrame:
    """Texts in plain letters without tags."""
    own = t("documents").filter(c("text").isNotNull() & ~c("text").rlike(r"[^\x00-\x7F]"))
    return own.select("doc_id", F.md5(texts.strip_tags(c("text"))).alias("h"))


_LABEL = "CASE region_id % 8 WHEN 0 THEN region_name || ' Ck' WHEN 1 THEN 'Ft. ' || region_name WHEN 2 THEN region_name || ' Jct' WHEN 3 THEN 'Mt ' || region_name WHEN 4 THEN region_name || ' Mtn' WHEN 5 THEN 'St. ' || region_name WHEN 6 THEN 'So ' || region_name ELSE region_name || ' Spgs' END"


@R.query(
    f"""SELECT region_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, ' Ck$', ' Creek'), '^Ft\\.? ', 'Fort '), ' Jct$', ' Junction'), '^Mt\\.? ', 'Mount '), ' Mtn$', ' Mountain'), '^St\\.? ', 'Saint '), '^So ', 'South '), ' Spgs$| Sprs\\.$', ' Springs') AS label
      FROM (SELECT region_id, {_LABEL} AS l FROM map_regions)"""
)
def abbrev_expand(t: Tables) -> DataFrame:
    """Abbreviations of names spelt out."""
    return t("map_regions").select("region_id", texts.expand_abbreviations(F.expr(_LABEL)).alias("label"))


@R.query(
    """SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) AS titled, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE upper(p_type[1]) || lower(p_type[2:]) END AS kind FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'x' || p_type ELSE p_type END AS p_type FROM part)"""
)
def title_case(t: Tables) -> DataFrame:
    """Names in one case get capitals, mixed ones stay."""
    kind = F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("x"), "p_type")).otherwise(c("p_type"))
    return t("part").select("p_partkey", texts.title_case(c("p_name")).alias("titled"), texts.title_case(kind).alias("kind"))


@R.query(
    r"""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND (contains(lower(p_name), 'widget') OR contains(lower(p_type), 'widget'))"""
)
def tokenise_and_or(t: Tables) -> DataFrame:
    """Parts that hold every term of a search in one of their fields."""
    terms = texts.search_terms(F.lit('RED "widget"'))
    return t("part").filter(texts.matches_all(terms, c("p_name"), c("p_type"))).select("p_partkey")


@R.query("SELECT p_partkey, CAST(levenshtein(p_name, 'red gizmo') AS INT) AS d FROM part WHERE levenshtein(p_name, 'red gizmo') <= 3 ORDER BY d, p_partkey LIMIT 50")
def lev_topk(t: Tables) -> DataFrame:
    """The fifty names nearest to a text by edit distance."""
    d = F.levenshtein("p_name", F.lit("red gizmo"))
    return t("part").select("p_partkey", d.alias("d")).filter("d <= 3").orderBy("d", "p_partkey").limit(50)


@R.query("SELECT a.region_id AS a, b.region_id AS b FROM map_regions a JOIN map_regions b ON lower(a.region_name) = lower(b.region_name) AND a.map_name = b.map_name AND a.region_id < b.region_id")
def collate_names(t: Tables) -> DataFrame:
    """Regions of one map whose names are equal but for their case."""
    own = t("map_regions").select("map_name", "region_id", F.collate(c("region_name"), "UNICODE_CI").alias("name"))
    other = own.select("map_name", c("region_id").alias("b"), c("name").alias("name_b"))
    met = own.join(other, (own["map_name"] == other["map_name"]) & (own["name"] == other["name_b"]) & (own["region_id"] < other["b"]))
    return met.select(c("region_id").alias("a"), "b")


@R.query(
    """SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[[:alpha:]àáâãäåąçćčďèéêëęěìíîïłñńňòóôõöőøřśšťùúûüůűýÿźżž]+'), lambda w: replace(replace(lower(strip_accents(w)), 'ł', 'l'), 'ø', 'o')), ' ')) AS h FROM documents WHERE text IS NOT NULL"""
)
def fold_accents(t: Tables) -> DataFrame:
    """Words of each text in lower case without accents."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-zàáâãäåąçćčďèéêëęěìíîïłñńňòóôõöőøřśšťùúûüůűýÿźżž]+)"), 1)
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.md5(F.array_join(F.transform(words, texts.fold), " ")).alias("h"))


@R.query("SELECT lower(regexp_replace(s_name, '[^A-Za-z]', '', 'g')) AS k, count(*) AS n FROM supplier GROUP BY 1")
def squash_key(t: Tables) -> DataFrame:
    """Names by their letters alone."""
    return t("supplier").groupBy(texts.squash(c("s_name")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


_KEY = "CASE waypoint_id % 4 WHEN 0 THEN u || '-' || u || '-forward-fastest-' || map_name WHEN 1 THEN u || '-' || u || '-sideways-fastest-' || map_name WHEN 2 THEN u || '-' || u || '-backward-' || map_name ELSE '-' || u || '-forward-x-mars' END"


@R.query(f"SELECT waypoint_id, count(*) AS n, bool_and(waypoint_id % 4 = 0) AS ok FROM (SELECT DISTINCT waypoint_id, map_name, {_u('node_uid')} AS u FROM waypoints WHERE {_u('node_uid')} <> '0') GROUP BY 1")
def route_keys(t: Tables) -> DataFrame:
    """Which route keys are valid."""
    own = t("waypoints").select("waypoint_id", "map_name", uid("node_uid").alias("u")).filter("u <> '0'").distinct()
    return own.withColumn("k", F.expr(_KEY)).groupBy("waypoint_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(texts.is_route_key(c("k"))).alias("ok"))


@R.query(f"SELECT DISTINCT map_name, {_u('uid')} AS node, CAST('0x' || {_u('uid')} AS UBIGINT)::VARCHAR AS number FROM nodes")
def uid_numbers(t: Tables) -> DataFrame:
    """Uids as unsigned numbers and back."""
    own = t("nodes").select("map_name", uid("uid").alias("node")).distinct()
    return own.select("map_name", uid_of_rank(uid_rank("node")).alias("node"), F.conv("node", 16, 10).alias("number"))


@R.query(
    "SELECT p_partkey, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'hot') THEN 'warm' WHEN contains(p_name, 'blue') THEN 'cold' ELSE 'plain' END AS kind, split_part(p_brand, '#', 2) AS brand FROM part"
)
def ordered_contains(t: Tables) -> DataFrame:
    """Classes by ordered parts of a text, and a piece of a split text."""
    kind = texts.first_containing(c("p_name"), [(("red", "hot"), "warm"), (("blue",), "cold")], "plain")
    return t("part").select("p_partkey", kind.alias("kind"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand"))


@R.query("SELECT map_name, token, array_to_string(list_concat(lanes_left[len(lanes_left):], lanes_left[1:len(lanes_left) - 1]), ',') AS turned FROM (SELECT DISTINCT map_name, token, lanes_left FROM road_looks WHERE len(lanes_left) > 0)")
def rotated_arrays(t: Tables) -> DataFrame:
    """Arrays turned right by one."""
    own = t("road_looks").filter("size(lanes_left) > 0").select("map_name", "token", "lanes_left").distinct()
    return own.select("map_name", "token", F.array_join(texts.rotate_right(c("lanes_left"), 1), ",").alias("turned"))


@R.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json_fields(t: Tables) -> DataFrame:
    """A field of a JSON column."""
    return t("events").filter("props IS NOT NULL").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.query("SELECT map_name, token, m.key AS lane, CAST(m.value AS INT) AS last_at FROM (SELECT DISTINCT map_name, token, unnest(map_entries(map_from_entries(list_zip(list_distinct(lanes_left), list_transform(list_distinct(lanes_left), lambda v: len(lanes_left) - list_position(list_reverse(lanes_left), v)))))) AS m FROM road_looks WHERE len(lanes_left) > 0)")
def last_wins_map(t: Tables) -> DataFrame:
    """A map from pairs in which the last of equal keys wins."""
    own = t("road_looks").filter("size(lanes_left) > 0").select("map_name", "token", "lanes_left").distinct()
    rows = own.select("map_name", "token", F.posexplode("lanes_left").alias("i", "lane"))
    return rows.groupBy("map_name", "token", "lane").agg(F.max("i").alias("last_at"))


@R.query(
    "SELECT s_suppkey, CAST(floor(m / 60) % 24 AS INT) AS hour, CAST(m % 60 AS INT) AS minute FROM (SELECT s_suppkey, s_suppkey * 97 + floor(s_nationkey * 30 / 60) * 60 AS m FROM supplier)"
)
def clock_times(t: Tables) -> DataFrame:
    """Hour and minute from minutes, moved by whole hours of a time zone."""
    m = c("s_suppkey") * 97 + F.floor(c("s_nationkey") * 30 / 60) * 60
    return t("supplier").select("s_suppkey", (F.floor(m / 60) % 24).cast("int").alias("hour"), (m % 60).cast("int").alias("minute"))
