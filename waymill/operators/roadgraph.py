"""A routable graph from roads, looks and prefabs, and measures of its lines.

Edges are (node, dir, to, to_dir, distance, duration, one_lane, guard): a road is passed forward when it has right
lanes, backward when it has left lanes; a prefab joins the nodes its lanes join, as traced once per description.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from waymill.functions import geometry as g
from waymill.functions.keys import token, uid
from waymill.functions.texts import any_lane
from waymill.operators import blocks
from waymill.operators.proximity import placed

#: Lane classes by what a lane's name holds, first match counts, and miles per hour assumed for each (a parameter).
SPEED_RULES = [(("freeway",), "freeway"), (("motorway",), "motorway"), (("expressway",), "expressway"), (("divided",), "divided"), (("slow_road",), "slow")]
#: Fixed value: maps whose speeds are read as kilometres an hour, with miles a kilometre.
MILES_A_KM = {"europe": 0.6213712}
SPEEDS = {"freeway": 65.0, "motorway": 60.0, "expressway": 55.0, "divided": 50.0, "slow": 20.0, "local": 30.0}


def in_mph(mph: Column) -> Column:
    """Speeds of a map by its unit."""
    factor = F.lit(1.0)
    for name, v in MILES_A_KM.items():
        factor = F.when(F.col("map_name") == name, v).otherwise(factor)
    return mph * factor


def road_edges(roads: DataFrame, looks: DataFrame, speeds: dict[str, float] = SPEEDS) -> DataFrame:
    """Edges of roads that aren't hidden; roads without a known look or without a node give none."""
    r = roads.filter(~F.coalesce("is_hidden", F.lit(False)))
    r = r.select("map_name", uid("uid").alias("item"), uid("start_node_uid").alias("s"), uid("end_node_uid").alias("e"), token("road_look_token").alias("look"), "road_length", F.col("dlc_guard").alias("guard")).distinct()
    r = r.filter("s IS NOT NULL AND e IS NOT NULL AND s <> '0' AND e <> '0'")
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    lanes = F.concat(F.coalesce("lanes_left", F.array().cast("array<string>")), F.coalesce("lanes_right", F.array().cast("array<string>")))
    look = looks.select("map_name", token("token").alias("look"), size("lanes_left").alias("nl"), size("lanes_right").alias("nr"), any_lane(lanes, SPEED_RULES, "local").alias("speed")).dropDuplicates(["map_name", "look"])
    mph = F.coalesce(*[F.when(F.col("speed") == k, F.lit(v)) for k, v in speeds.items()])
    both = r.join(look, ["map_name", "look"]).withColumns({"distance": F.col("road_length"), "duration": g.travel_seconds(F.col("road_length"), in_mph(mph)), "one_lane": F.greatest("nl", "nr") == 1})
    ways = F.array(
        F.when(F.col("nr") > 0, F.struct(F.col("s").alias("node"), F.lit("forward").alias("dir"), F.col("e").alias("to"))),
        F.when(F.col("nl") > 0, F.struct(F.col("e").alias("node"), F.lit("backward").alias("dir"), F.col("s").alias("to"))),
    )
    out = both.withColumn("w", F.explode(F.array_compact(ways)))
    return out.select("map_name", "w.node", "w.dir", "w.to", F.col("w.dir").alias("to_dir"), "distance", "duration", "one_lane", "guard", "item")


def trace(inputs: list[list[int]], outputs: list[list[int]], following: list[list[int]]) -> list[tuple[int, int, int]]:
    """(start node, end node, curves passed) that lanes join: from a node's input curves on to any node's output curves.

    Curves may form rings; each start visits a curve once, and the least number of curves counts.
    """
    ends: dict[int, list[int]] = {}
    for node, curves in enumerate(outputs):
        for k in curves:
            ends.setdefault(k, []).append(node)
    rows = []
    for node, curves in enumerate(inputs):
        seen, front, depth, best = set(), [k for k in curves if 0 <= k < len(following)], 1, {}
        while front:
            nxt = []
            for k in front:
                if k in seen:
                    continue
                seen.add(k)
                for end in ends.get(k, ()):
                    best.setdefault(end, depth)
                nxt += [j for j in following[k] if 0 <= j < len(following)]
            front, depth = nxt, depth + 1
        rows += [(node, end, n) for end, n in best.items()]
    return rows


def lane_connections(descriptions: DataFrame) -> DataFrame:
    """(map_name, token, start_node, end_node, curves): which nodes of a description its lanes join.

    One description is one row and small by nature, so its curves are traced where the row is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for world, tok, nodes, curves in zip(pdf["map_name"], pdf["token"], pdf["nodes"], pdf["nav_curves"], strict=True):
                nodes, curves = ([] if v is None else list(v) for v in (nodes, curves))
                part = lambda key: [[] if n is None or n[key] is None else [int(k) for k in n[key]] for n in nodes]  # noqa: B023, E731
                nxt = [[] if k is None or k["next_lines"] is None else [int(j) for j in k["next_lines"]] for k in curves]
                rows += [(world, tok, *x) for x in trace(part("input_lanes"), part("output_lanes"), nxt)]
            yield pd.DataFrame(rows, columns=["map_name", "token", "start_node", "end_node", "curves"])

    own = descriptions.select("map_name", token("token").alias("token"), "nodes", "nav_curves")
    return own.mapInPandas(run, "map_name string, token string, start_node int, end_node int, curves int").distinct()


def prefab_edges(prefabs: DataFrame, descriptions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between a prefab's nodes that its lanes join; node i of a description is the prefab's node i less origin."""
    links = lane_connections(descriptions)
    p = prefabs.filter(~F.coalesce("is_hidden", F.lit(False))).select("map_name", uid("uid").alias("item"), token("token").alias("token"), "node_uids", F.coalesce("origin_node_index", F.lit(0)).alias("origin"), F.col("dlc_guard").alias("guard")).distinct()
    n = F.size("node_uids")
    at = lambda c: uid(F.get("node_uids", F.pmod(F.col(c) - F.col("origin"), n)))
    e = p.filter(n > 0).join(links, ["map_name", "token"]).filter((F.col("start_node") < n) & (F.col("end_node") < n))
    e = e.select("map_name", "item", "guard", at("start_node").alias("node"), at("end_node").alias("to")).filter("node IS NOT NULL AND to IS NOT NULL AND node <> '0' AND to <> '0' AND node <> to").distinct()
    place = nodes.groupBy("map_name", uid("uid").alias("k")).agg(F.max_by(F.struct("x", "y", uid("forward_item_uid").alias("f"), uid("backward_item_uid").alias("b")), F.struct("arrived_at", "x")).alias("p"))
    a = place.select("map_name", F.col("k").alias("node"), F.col("p").alias("a"))
    b = place.select("map_name", F.col("k").alias("to"), F.col("p").alias("b"))
    e = e.join(a, ["map_name", "node"]).join(b, ["map_name", "to"])
    d = g.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    into = F.when(F.col("a.f") == F.col("item"), "forward").otherwise("backward")
    out = F.when(F.col("b.b") == F.col("item"), "forward").otherwise("backward")
    return e.select("map_name", "node", into.alias("dir"), "to", out.alias("to_dir"), d.alias("distance"), g.travel_seconds(d, in_mph(F.lit(SPEEDS["local"]))).alias("duration"), F.lit(False).alias("one_lane"), "guard", "item")


def island_items(members: DataFrame) -> DataFrame:
    """(map_name, item) of items none of whose nodes (map_name, item, node) another item shares."""
    shared = members.groupBy("map_name", "node").agg((F.min("item") != F.max("item")).alias("shared"))
    return members.join(shared, ["map_name", "node"]).groupBy("map_name", "item").agg(F.bool_or("shared").alias("s")).filter("NOT s").select("map_name", "item")


def mode_cost(mode: str) -> Column:
    """Cost of an edge: its length, its time, or its length with a tenfold weight off one-lane roads."""
    if mode == "fastest":
        return F.col("duration")
    if mode == "smallRoads":
        return F.when(F.col("one_lane"), F.col("distance")).otherwise(F.col("distance") * 10)
    return F.col("distance")


#: Fixed values of the roundness of a line: radius up to which it is full and by how much it decays beyond, and the
#: spread of the aspect around a square.
FULL_RADIUS, RADIUS_DECAY, ASPECT_SPREAD = 70, 10, 0.02


def ring_scores(vertices: DataFrame, by: list[str]) -> DataFrame:
    """Roundness of lines (by, ord, x, y): mean radius, circularity, aspect, turning share and direction, and the product.

    Circularity is the deviation of the radii over their mean; the product is 0 unless the line turns left throughout
    more than right.
    """
    w = W.partitionBy(*by)
    v = vertices.withColumns({"cx": F.avg("x").over(w), "cy": F.avg("y").over(w)})
    v = v.withColumn("r", g.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")))
    o = w.orderBy("ord")
    lag, lead = (lambda c, f=f: f(c).over(o) for f in (F.lag, F.lead))
    v = v.withColumn("turn", (F.col("x") - lag("x")) * (lead("y") - F.col("y")) - (F.col("y") - lag("y")) * (lead("x") - F.col("x")))
    s = v.groupBy(*by).agg(
        F.avg("r").alias("mean_radius"), F.stddev_pop("r").alias("sd"), F.count_if(F.col("turn") > 0).alias("pos"), F.count_if(F.col("turn") < 0).alias("neg"),
        ((F.max("x") - F.min("x")) / F.nullif(F.max("y") - F.min("y"), F.lit(0.0))).alias("aspect"),
    )
    s = s.withColumns({"circularity": F.col("sd") / F.nullif(F.col("mean_radius"), F.lit(0.0)), "turning": F.when(F.col("pos") + F.col("neg") == 0, 0.0).otherwise(F.greatest("pos", "neg") / (F.col("pos") + F.col("neg"))), "direction": F.signum(F.col("pos") - F.col("neg")).cast("int")})
    radius = F.when(F.col("mean_radius") <= FULL_RADIUS, 1.0).otherwise(F.exp(-(F.col("mean_radius") - FULL_RADIUS) / RADIUS_DECAY))
    shape = F.exp(-F.pow(F.log("aspect"), F.lit(2)) / ASPECT_SPREAD)
    score = F.when(F.col("direction") != -1, 0.0).otherwise(radius * shape * F.col("turning") * (1 - F.col("circularity")))
    return s.select(*by, "mean_radius", "circularity", "aspect", "turning", "direction", score.alias("score"))


def best_insertions(stops: DataFrame, extra: DataFrame) -> DataFrame:
    """For each extra place (route, id, x, y) the segment of its route (route, ord, x, y) where it adds least length.

    Returns (route, id, after, added): the stop it comes after, the earlier one on ties. Places in one position share the
    answer; positions meet the segments of their route in blocks, which give one row a position, so pairs stay in memory.
    Stops without a position are passed over.
    """
    w = W.partitionBy("route").orderBy("ord")
    s = placed(stops).filter("ord IS NOT NULL").withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).filter("bx IS NOT NULL")
    s = s.select("route", F.col("ord").alias("after"), F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), F.col("bx").cast("double").alias("bx"), F.col("by").cast("double").alias("by"))
    extra = extra.select("route", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    spots = extra.select("route", "x", "y").distinct()
    schema = StructType([*spots.schema, s.schema["after"], StructField("added", DoubleType())])

    def least(places: pa.Table, legs: pa.Table) -> pa.Table:
        legs = legs.sort_by("after")
        (x, y), (ax, ay, bx, by) = blocks.numbers(places, "x", "y"), blocks.numbers(legs, "ax", "ay", "bx", "by")
        own, at, added = np.sqrt((bx - ax) ** 2 + (by - ay) ** 2), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k in blocks.slices(len(x), len(ax)):
            px, py = x[k, None], y[k, None]
            more = np.sqrt((px - ax) ** 2 + (py - ay) ** 2) + np.sqrt((bx - px) ** 2 + (by - py) ** 2) - own
            at[k] = more.argmin(axis=1)  # the first of equals
            added[k] = more[np.arange(len(more)), at[k]]
        return pa.table({"route": places["route"], "x": places["x"], "y": places["y"], "after": legs["after"].take(pa.array(at)), "added": pa.array(added, mask=np.isnan(added))})

    best = blocks.met(spots, s, ["route"], least, schema).groupBy("route", "x", "y").agg(F.min(F.struct("added", "after")).alias("m"))
    best = best.withColumnsRenamed({"route": "r", "x": "sx", "y": "sy"})
    both = extra.join(best, (F.col("route") == F.col("r")) & F.col("x").eqNullSafe(F.col("sx")) & F.col("y").eqNullSafe(F.col("sy")))
    return both.groupBy("route", "id").agg(F.min("m").alias("m")).select("route", "id", "m.after", "m.added")
