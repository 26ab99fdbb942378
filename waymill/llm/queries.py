"""The pN_ queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.llm import grouping, leaks, packing, spam
from waymill.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every road that stands in a match."""
    return grouping.group_matches(table(spark, d, "road_matches")).select("road_feature", "group_feature").distinct()


def p4_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    roads = grouping.group_matches(table(spark, d, "road_matches"))
    sizes = roads.groupBy("map_name", "group_feature").agg(F.count(F.lit(1)).alias("roads"))
    return sizes.groupBy("roads").agg(F.count(F.lit(1)).alias("n_groups"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text with the container of 2,048 tokens it is placed in."""
    return packing.pack(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, tokens placed and the least number of containers they could take."""
    rows = packing.pack(table(spark, d, "documents")).filter("container_id <> '-1'")
    return rows.agg(
        F.count_distinct("container_id").alias("containers"),
        F.sum("n_tokens").alias("tokens"),
        F.ceil(F.sum("n_tokens") / packing.CAPACITY).alias("least"),
    )


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How far the containers filled by each window are from the sources' shares of all tokens."""
    out = packing.mixture(packing.pack(table(spark, d, "documents")))
    return out.select("container_window", "containers", "tokens", F.round("deviation", 4).alias("deviation"), "dry")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p7_similar(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a window similar to one of an item, and the best similarity."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), exact=False)
    return found.select("item_id", "doc_id", F.round("similarity", 4).alias("similarity"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages more than half of whose words stand in spam."""
    pages = spam.spam_pages(table(spark, d, "documents"))
    return pages.filter(F.col("spam_words") * 2 > F.col("words")).select("doc_id").distinct()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the share of their words that stands in spam, in tenths."""
    pages = spam.spam_pages(table(spark, d, "documents"))
    tenth = F.least(F.lit(9), F.floor(F.col("spam_words") * 10 / F.col("words"))).cast("int")
    return pages.groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("pages"))


_T = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_U = "nullif(regexp_extract({t}, '^(0x)?0*([0-9a-f]{{1,16}})$', 2), '')"


def _uid(c: str) -> str:
    return _U.format(t=_T.format(c=c))


QUERIES = {f.__name__: f for f in (p4_found, p4_group_sizes, p6_containers, p6_fill, p6_mixture, p7_found, p7_similar, p8_found, p8_shares)}

_GROUPS = f"""
WITH RECURSIVE m AS (SELECT DISTINCT map_name, {_uid("feature_a")} AS a, {_uid("feature_b")} AS b FROM road_matches WHERE {_uid("feature_a")} IS NOT NULL AND {_uid("feature_b")} IS NOT NULL),
e AS (SELECT map_name, a, b FROM m UNION SELECT map_name, b, a FROM m),
r AS (SELECT map_name, a AS s, a AS t FROM e UNION SELECT r.map_name, r.s, e.b FROM r JOIN e ON e.map_name = r.map_name AND e.a = r.t),
g AS (SELECT map_name, s AS road_feature, ltrim(min(lpad(t, 16, '0')), '0') AS group_feature FROM r GROUP BY map_name, s)"""

ORACLES = {
    "p4_found": f"{_GROUPS} SELECT DISTINCT road_feature, group_feature FROM g",
    "p4_group_sizes": f"{_GROUPS} SELECT roads, count(*) AS n_groups FROM (SELECT map_name, group_feature, count(*) AS roads FROM g GROUP BY ALL) GROUP BY 1",
}
