"""Features derived from map items: signs, traffic, links between neighbours, entrances, and keys of facilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymill.operators import sequence, spatial


def classified(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Rows of df with (kind, value) for every kind whose value isn't null: none, one or several rows each."""
    made = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])
    return df.withColumn("_k", F.explode(F.filter(made, lambda x: x["value"].isNotNull()))).select("*", "_k.kind", "_k.value").drop("_k")


def item_places(members: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, x, y) of items with nodes (key, x, y): the midpoint of two nodes, the centre of the extent of four or
    more; items with other numbers of nodes are left out."""
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    out = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), mid("x").alias("x"), mid("y").alias("y"))
    kind = F.when(F.col("n") == 2, "midpoint").when(F.col("n") >= 4, "extent")
    return out.withColumn("kind", kind).filter("kind IS NOT NULL").select(*key, "kind", "x", "y")


def feature_union(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, map_name, x, y, label) of several kinds of features; columns that a kind lacks are null."""
    cols = {"id": "string", "map_name": "string", "x": "double", "y": "double", "label": "string"}
    made = [df.select(F.lit(k).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()]) for k, df in parts.items()]
    return reduce(DataFrame.unionByName, made)


def neighbour_links(df: DataFrame, by: list[str], order: list[str], item: str, closes: int = 3) -> DataFrame:
    """Rows with `prev` and `next` of their order; a chain of at least `closes` rows is closed into a loop."""
    w = W.partitionBy(*by).orderBy(*order)
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    loop = F.count(F.lit(1)).over(W.partitionBy(*by)) >= closes
    ends = {"prev": (F.lag(item).over(w), F.last(item).over(every)), "next": (F.lead(item).over(w), F.first(item).over(every))}
    return df.withColumns({k: F.coalesce(a, F.when(loop, b)) for k, (a, b) in ends.items()})


def entrance_index(df: DataFrame, key: str, entrances: str, order: list[str]) -> DataFrame:
    """(entrance, key) of rows whose lists name entrances: the later row of an entrance counts."""
    rows = df.select(F.explode(entrances).alias("entrance"), key, F.struct(*order).alias("_o")).filter("entrance IS NOT NULL")
    return rows.groupBy("entrance").agg(F.max_by(key, "_o").alias(key))


def without_inconsistent(items: DataFrame, parents: DataFrame, key: list[str], others: DataFrame, link: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(items that have a parent, others that no removed item points to): an item whose parent (key) is missing goes, and
    the rows of `others` it links to (item column -> their column) go with it."""
    kept = items.join(parents.select(*key).distinct(), key, "left_semi")
    gone = items.join(parents.select(*key).distinct(), key, "left_anti").select(*[F.col(a).alias(b) for a, b in link.items()]).distinct()
    return kept, others.join(gone, list(link.values()), "left_anti")


def facility_nodes(members: DataFrame, facilities: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, node, d): of each item's nodes (by, id, x, y) the one nearest to any facility point (by, id, x, y)."""
    near = spatial.knn_join(facilities, members, by=by)
    own = near.join(facilities.select(F.col("id").alias("q_id"), *by), "q_id")
    return own.groupBy(*by).agg(F.min(F.struct("d", F.col("p_id").alias("node"))).alias("m")).select(*by, "m.node", "m.d")


def island_links(islands: DataFrame, nodes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Edges (src, dst, way, d) of islands (id, x, y, by) to the node nearest to them: both ways out, four back."""
    near = spatial.knn_join(islands, nodes, by=by)
    out = F.array(*[F.struct(F.lit(w).alias("way"), F.lit(o).alias("out")) for w, o in (("forward", True), ("backward", True), ("forward-forward", False), ("forward-backward", False), ("backward-forward", False), ("backward-backward", False))])
    e = near.withColumn("e", F.explode(out))
    return e.select(F.when(F.col("e.out"), F.col("q_id")).otherwise(F.col("p_id")).alias("src"), F.when(F.col("e.out"), F.col("p_id")).otherwise(F.col("q_id")).alias("dst"), F.col("e.way").alias("way"), "d")


def once_within(requests: DataFrame, key: list[str], at: str, ident: str, seconds: float) -> DataFrame:
    """(ident BIGINT, cached) of requests: whether the same key was asked for at most so many seconds after the request
    that last computed it. A computed result lives from its own time on, so hits don't prolong it. Requests are stepped
    through in order, none is held."""
    life = int(seconds * 1e6)
    own = requests.select(*key, F.col(ident).cast("bigint").alias("ident"), F.unix_micros(F.col(at).cast("timestamp")).alias("asked"))

    def step(made, row):
        cached = made is not None and row.asked - made <= life
        return (made if cached else row.asked), (row.ident, cached)

    return sequence.fold(own, key, ["asked", "ident"], step, lambda: None, "ident bigint, cached boolean")
