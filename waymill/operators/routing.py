"""Operators around routes: steps and turns, poses on roads, joined roads, roundabouts, ferries and filled-in types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymill.functions import geometry as g
from waymill.operators import graph, roadgraph, sequence, spatial
from waymill.session import Scratch


def path_nodes(paths: DataFrame) -> DataFrame:
    """(route, ord, node) of routes (route, path)."""
    return paths.select("route", F.posexplode("path").alias("ord", "node"))


def steps(nodes: DataFrame, by: str = "route") -> DataFrame:
    """Steps of routes (by, ord, x, y): straight passages are merged, a turn cuts.

    Returns (by, step, turn, distance, first, last): the turn a step begins with and the range of its nodes; the last
    step of a route is its arrival, of no length.
    """
    w = W.partitionBy(by).orderBy("ord")
    ahead = {"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "lx": F.lag("x").over(w), "ly": F.lag("y").over(w)}
    v = nodes.select(by, "ord", "x", "y").withColumns(ahead)
    angle = g.angle_between(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    turn = F.when(F.col("lx").isNull(), "depart").when(F.col("nx").isNull(), "arrive").otherwise(g.turn_class(F.col("angle")))
    v = v.withColumn("angle", angle).withColumn("turn", turn).withColumn("part", F.coalesce(g.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")), F.lit(0.0)))
    cut = (F.col("turn") != "through").cast("int")
    v = v.withColumn("step", F.sum(cut).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return v.groupBy(by, "step").agg(F.min_by("turn", "ord").alias("turn"), F.sum("part").alias("distance"), F.min("ord").alias("first"), F.max("ord").alias("last"))


def with_next(steps_: DataFrame, within: float, by: str = "route") -> DataFrame:
    """Steps with the turn of the next one where it comes within a distance ("then ...")."""
    w = W.partitionBy(by).orderBy("step")
    return steps_.withColumn("then", F.when(F.col("distance") <= within, F.lead("turn").over(w)))


def located(poses: DataFrame, line: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The line each pose (id, x, y, heading) is on: the one with the best product of alignment and nearness.

    line: (line, ord, x, y). Two-way lines count in either direction. Returns (by, id, line, score); ties go to the
    smaller line.
    """
    near = spatial.near_lines(poses, line, radius, by)
    seg = spatial.segments(line, by).select(*by, "line", F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")).alias("way"), "before", "len")
    met = near.join(seg, [*by, "line"]).filter((F.col("location") >= F.col("before")) & (F.col("location") <= F.col("before") + F.col("len")))
    met = met.join(poses.select(*by, "id", "heading"), [*by, "id"])
    score = F.abs(g.heading_score(F.col("heading"), F.col("way"), F.col("d")))
    best = met.groupBy(*by, "id").agg(F.min(F.struct(F.round(-score, 9).alias("s"), "line")).alias("m"))
    return best.select(*by, "id", "m.line", (-F.col("m.s")).alias("score"))


def joined_roads(ends: DataFrame, gap: float, alike: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Roads (id BIGINT, x0, y0, x1, y1, alike columns) joined end to end into chains: (by, id, chain, links).

    Two ends join when each is the other's nearest end of another road within the gap and the roads agree in the alike
    columns; so the result doesn't depend on the order of rows. A chain is named by its least road.
    """
    scratch = Scratch(ends.sparkSession, "joined")
    keys = [*by, *alike]
    parts = [ends.select(*keys, F.col("id"), F.lit(i).alias("end"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (0, 1)]
    tips = scratch.write(parts[0].unionByName(parts[1]).withColumn("tip", F.col("id") * 2 + F.col("end")), "tips")
    # the three nearest hold the tip itself and the same road's other end at most
    near = spatial.knn_join(tips.withColumn("id", F.col("tip")), tips.withColumn("id", F.col("tip")), 3, gap, tuple(keys))
    other = near.filter(F.floor(F.col("q_id") / 2) != F.floor(F.col("p_id") / 2)).groupBy("q_id").agg(F.min(F.struct("d", "p_id")).alias("m")).select("q_id", F.col("m.p_id").alias("p_id"))
    other = scratch.write(other, "nearest")
    mutual = other.join(other.select(F.col("q_id").alias("p_id"), F.col("p_id").alias("q_id")), ["q_id", "p_id"]).filter("q_id < p_id")
    links = mutual.select(F.lit("").alias("w"), F.floor(F.col("q_id") / 2).alias("a"), F.floor(F.col("p_id") / 2).alias("b"))
    labels = graph.least_labels(links.filter("a <> b").distinct(), scratch)
    n = graph.both_ways(links).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    out = ends.select(*by, "id").distinct().join(labels.select(F.col("a").alias("id"), "root"), "id", "left").join(n, "id", "left")
    return out.select(*by, "id", F.coalesce("root", "id").alias("chain"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


#: Nodes of a composite roundabout, and the least score of one.
SHORTEST, LONGEST, ROUND = 4, 30, 0.55


def roundabouts(edges: DataFrame, places: DataFrame, eps: float = 40.0, shortest: int = SHORTEST, longest: int = LONGEST, least: float = ROUND, by: tuple[str, ...] = ()) -> DataFrame:
    """Cycles of a directed graph (src, dst) whose shape is round: (cycle, score, mean_radius).

    places: (node, x, y, by). A roundabout is small, so cycles are sought among edges whose ends lie in one cluster of
    nodes within eps of one another, pruned of dead ends; the line of a cycle ends at its start.
    """
    scratch = Scratch(edges.sparkSession, "roundabouts")
    named = scratch.write(places.withColumn("id", F.xxhash64("node")), "places")
    groups = spatial.dbscan(named.select(*by, "id", "x", "y"), eps, 2, by).filter("cluster IS NOT NULL")
    of = scratch.write(named.join(groups.select("id", "cluster"), "id").select("node", "cluster"), "clusters")
    own = edges.join(of.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst")
    found = graph.short_cycles(own.filter("a = b").select("src", "dst"), longest).filter(F.col("length") >= shortest)
    cycles = scratch.write(found.withColumn("cycle", F.concat_ws(",", "nodes")), "cycles")
    v = cycles.select("cycle", F.posexplode(F.concat("nodes", F.slice("nodes", 1, 1))).alias("ord", "node")).join(places, "node")
    scores = roadgraph.ring_scores(v, ["cycle"]).filter(F.col("score") >= least)
    return scores.select("cycle", "score", "mean_radius")


def round_prefabs(descriptions: DataFrame, most_circular: float = 0.35) -> DataFrame:
    """Descriptions whose lanes join every node with every other and whose nodes lie on a circle: (map_name, token, score)."""
    from waymill.functions.keys import token

    links = roadgraph.lane_connections(descriptions).filter("start_node <> end_node").groupBy("map_name", "token").agg(F.count_distinct("start_node", "end_node").alias("n_links"))
    v = descriptions.select("map_name", token("token").alias("token"), F.posexplode("nodes").alias("ord", "p")).select("map_name", "token", "ord", "p.x", "p.y")
    c = ["cx", "cy"]
    w = W.partitionBy("map_name", "token")
    r = v.withColumns({k: F.avg(a).over(w) for k, a in zip(c, "xy", strict=True)}).withColumn("r", g.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")))
    shape = r.groupBy("map_name", "token").agg((F.stddev_pop("r") / F.nullif(F.avg("r"), F.lit(0.0))).alias("circularity"), F.count(F.lit(1)).alias("n"))
    both = shape.join(links, ["map_name", "token"])
    return both.filter((F.col("n") >= 3) & (F.col("n_links") == F.col("n") * (F.col("n") - 1)) & (F.col("circularity") <= most_circular)).select("map_name", "token", "circularity")


def filled_by_neighbours(items: DataFrame, value: str, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Items (id, x, y, value) whose missing value is taken from the nearest item that has one, again and again until
    nothing changes; what is out of reach stays empty. Each round only unfilled items look around."""
    scratch = Scratch(items.sparkSession, "filled")
    known, k = scratch.write(items.filter(F.col(value).isNotNull()), "known-0"), 0
    left = scratch.write(items.filter(F.col(value).isNull()), "left-0")
    front = known
    while True:
        near = spatial.knn_join(left, front, 1, radius, by).select(F.col("q_id").alias("id"), F.col("p_id").alias("from"))
        got = left.drop(value).join(near, "id").join(front.select(F.col("id").alias("from"), value), "from").select(items.columns)
        k += 1
        got = scratch.write(got, f"got-{k}")
        if got.isEmpty():
            return known.unionByName(left.select(items.columns))
        known = known.unionByName(got)
        left = scratch.write(left.join(got.select("id"), "id", "left_anti").select(items.columns), f"left-{k}")
        front = got


def ferry_edges(connections: DataFrame, scale: float, mph: float) -> DataFrame:
    """Edges both ways of ferry connections (from, to, distance), lengths scaled, at a given speed."""
    d = F.col("distance") * scale
    one = connections.filter("`from` IS NOT NULL AND `to` IS NOT NULL").select(F.col("from").alias("src"), F.col("to").alias("dst"), d.alias("distance"), g.travel_seconds(d, F.lit(mph)).alias("duration"), F.lit(True).alias("ferry"))
    return one.unionByName(one.withColumns({"src": F.col("dst"), "dst": F.col("src")})).groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("duration").alias("duration"), F.bool_or("ferry").alias("ferry"))


def combined(segments: DataFrame) -> DataFrame:
    """Segments of routes (route, ord, first, last, distance) combined: ends, total, and whether they fit end to end."""
    w = W.partitionBy("route").orderBy("ord")
    fits = F.coalesce(F.lag("last").over(w) == F.col("first"), F.lit(True))
    s = segments.withColumn("fits", fits)
    return s.groupBy("route").agg(F.min_by("first", "ord").alias("first"), F.max_by("last", "ord").alias("last"), F.sum("distance").alias("distance"), F.bool_and("fits").alias("fits"))


def ahead_or_behind(x: Column, y: Column, heading: Column, px: Column, py: Column) -> Column:
    """Whether a place lies ahead of a pose (the product of way and direction isn't negative)."""
    return F.when((px - x) * F.cos(heading) + (py - y) * F.sin(heading) >= 0, "ahead").otherwise("behind")


def merged_steps(df: DataFrame, key: list[str], order: list[str], item: str, length: str) -> DataFrame:
    """Neighbouring rows of one item merged into a step with their length."""
    r = sequence.runs(df, key, order, item)
    return r.groupBy(*key, "run", item).agg(F.sum(length).alias(length), F.count(F.lit(1)).alias("rows"))
