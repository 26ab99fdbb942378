"""Points near other points, and points in regions.

near_pairs: a grid join. The probing side is copied to the cells its circle's bounding box covers, both sides meet by
an equi-join on (world, cell), the distance is tested exactly inside the join. A cell that holds more rows of either
side than HOT_CELL is split both ways: each side's rows spread over parts of HOT_CELL and are copied to the parts of the
other, so no task compares more than HOT_CELL rows with as many.

regions_of: polygons are ear-clipped, their triangles packed along a Morton curve into the leaves of a
bounding-volume hierarchy whose levels are tables; points start at the roots, go down by equi-joins on the node with
a box test, and the triangles of the leaves they reach are tested exactly. A point on an edge that triangles of one
region share is assigned once. No level is ever held whole by a task: only the root level, at most ROOTS nodes by
construction, is handed to the tasks.

Rows with a missing, NaN or infinite coordinate take no part; repeated rows count once; a null world is a world of
its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.functions.polygons import ear_clip
from waymill.session import BROADCAST_ROWS, Scratch

HOT_CELL, LEAF, FANOUT, ROOTS = 4096, 16, 16, 1024


def placed(df: DataFrame) -> DataFrame:
    """Rows whose x and y are finite numbers."""
    inf = float("inf")
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < inf) for c in ("x", "y")]
    return df.filter(ok[0] & ok[1])


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


def _salted(points: DataFrame, probes: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns `salt` and `salt2` that split cells which hold many rows of either."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = points.select(*keys, one.alias("p"), none.alias("q")).unionByName(probes.select(*keys, none.alias("p"), one.alias("q")))
    hot = both.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("q").alias("q")).filter((F.col("p") > HOT_CELL) | (F.col("q") > HOT_CELL)).filter("p > 0 AND q > 0")
    parts = {f"parts_{c}": F.ceil(F.col(c) / HOT_CELL).cast("int") for c in "pq"}
    hot = scratch.write(hot.withColumns(parts).select(*keys, "parts_p", "parts_q"), "hot-cells")
    n = hot.count()
    if n == 0:
        return tuple(df.withColumns({"salt": F.lit(0), "salt2": F.lit(0)}) for df in (points, probes))
    if n <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    of = lambda c: F.coalesce(F.col(f"parts_{c}"), F.lit(1))
    mine = lambda c, *cols: F.pmod(F.xxhash64(*cols), of(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), of(c) - 1))
    points = points.join(hot, keys, "left").withColumn("salt", mine("p", "id", "x", "y")).withColumn("salt2", every("q")).drop("parts_p", "parts_q")
    probes = probes.join(hot, keys, "left").withColumn("salt2", mine("q", "q_id", "qx", "qy", "relation")).withColumn("salt", every("p")).drop("parts_p", "parts_q")
    return points, probes


def near_pairs(points: DataFrame, probes: DataFrame, radius: float) -> DataFrame:
    """(relation, probe_id, id, d2) of all pairs within the radius, in one join.

    points: world, id, x, y. probes: relation, world, id, x, y, self (whether they are the points themselves; then
    only pairs of two different ids come out, each once, with the smaller id as probe_id).
    """
    size = float(radius)
    scratch = Scratch(points.sparkSession, "near")
    keys = ["world", "cx", "cy"]
    p = placed(points).select("world", "id", "x", "y").withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})
    q = placed(probes).select("relation", "world", F.col("id").alias("q_id"), F.col("x").alias("qx"), F.col("y").alias("qy"), "self")
    q = q.withColumns({"hx": _cell(F.col("qx"), size), "hy": _cell(F.col("qy"), size)})
    # a point looks at its own cell and half of its neighbours, any other probe at all nine
    half = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    full = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    q = q.withColumn("o", F.explode(F.when(F.col("self"), half).otherwise(full)))
    q = q.withColumns({"cx": F.col("hx") + F.col("o.a"), "cy": F.col("hy") + F.col("o.b")})
    # cells that the circle doesn't reach are left out before the shuffle
    gap = lambda v, c: F.greatest(F.lit(0.0), F.col(c) * size - F.col(v), F.col(v) - (F.col(c) + 1) * size)
    q = q.filter(gap("qx", "cx") * gap("qx", "cx") + gap("qy", "cy") * gap("qy", "cy") <= size * size)
    q = q.select(*keys, "relation", "self", "q_id", "qx", "qy", ((F.col("cx") == F.col("hx")) & (F.col("cy") == F.col("hy"))).alias("home"))
    p, q = _salted(p, q, keys, scratch)
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    once = ~F.col("self") | F.when(F.col("home"), F.col("q_id") < F.col("id")).otherwise(F.col("q_id") != F.col("id"))
    both = [*keys, "salt", "salt2"]
    r = q.withColumnsRenamed({c: f"q_{c}" for c in both})
    out = p.join(r, [p[c] == r[f"q_{c}"] for c in both] + [d2 <= size * size, once])
    return out.select(
        "relation",
        F.when(F.col("self"), F.least("q_id", "id")).otherwise(F.col("q_id")).alias("probe_id"),
        F.when(F.col("self"), F.greatest("q_id", "id")).otherwise(F.col("id")).alias("id"),
        d2.alias("d2"),
    )


TRIANGLES = "world string, region bigint, " + ", ".join(f"{c}{i} double" for i in (1, 2, 3) for c in "xy")


def triangles(regions: DataFrame) -> DataFrame:
    """Ear-clipped triangles of regions (world, region, ring)."""

    def clip(batches):
        for pdf in batches:
            rows = [(w, r, *(v for p in t for v in p)) for w, r, ring in zip(pdf["world"], pdf["region"], pdf["ring"], strict=True) for t in ear_clip(ring)]
            yield pd.DataFrame(rows, columns=["world", "region", "x1", "y1", "x2", "y2", "x3", "y3"])

    return regions.select("world", "region", "ring").filter("region IS NOT NULL AND ring IS NOT NULL").mapInPandas(clip, TRIANGLES)


def _morton(x: Column, y: Column, box) -> Column:
    """Interleaved bits of both coordinates on a 2^16 grid over the box."""
    x0, y0, x1, y1 = box
    code = F.lit(0).cast("bigint")
    for c, lo, hi, shift in ((x, x0, x1, 0), (y, y0, y1, 1)):
        v = F.least(F.lit(65535), F.greatest(F.lit(0), ((c - lo) / max(hi - lo, 1e-9) * 65536).cast("bigint"))).cast("bigint")
        for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask).cast("bigint"))
        code = code.bitwiseOR(F.shiftleft(v, shift))
    return code


class BoxHierarchy:
    """A bounding-volume hierarchy over items with boxes (world, x0, y0, x1, y1), each level a table.

    Items sorted along a Morton curve are cut into leaves of LEAF items, leaves into nodes of FANOUT, and so on until
    at most ROOTS nodes are left. Range partitioning does the sort, so building holds no level in one task.
    """

    def __init__(self, items: DataFrame, scratch: Scratch):
        lim = items.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
        self.empty = lim[0] is None
        if self.empty:
            return
        code = _morton((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, lim)
        ordered = items.withColumn("code", code).repartitionByRange("world", "code", "x0", "y0").sortWithinPartitions("world", "code", "x0", "y0")
        # 33 low bits count within a partition, the high bits hold the partition; once every partition is down to
        # one node, partitions are joined
        at = scratch.write(ordered.withColumn("at", F.monotonically_increasing_id()), "bvh-items")
        part = lambda c: F.shiftright(c, 33)
        nth = lambda c: F.col(c).bitwiseAND(F.lit(2**33 - 1))
        self.items = at.withColumn("node", F.shiftleft(part("at"), 33) + F.floor(nth("at") / LEAF)).drop("at", "code")
        self.levels: list[DataFrame] = []
        below = self.items
        while True:
            node = below.groupBy("world", "node").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
            node = scratch.write(node, f"bvh-level-{len(self.levels)}")
            n, most = node.agg(F.count(F.lit(1)), F.max(nth("node"))).first()
            up = F.shiftleft(part("node"), 33) + F.floor(nth("node") / FANOUT) if most else F.shiftleft(F.floor(part("node") / FANOUT).cast("bigint"), 33)
            node = node.withColumn("up", up)
            self.levels.append(node)
            if n <= max(ROOTS, node.select("world").distinct().count()):
                break
            below = node.drop("node").withColumnRenamed("up", "node")
        # as many roots as worlds may be left; only a bounded number is handed to the tasks
        self.roots = node.select("world", "node", "x0", "y0", "x1", "y1").toPandas() if n <= ROOTS else None

    def descend(self, points: DataFrame) -> DataFrame:
        """points (world, id, x, y) with the leaf `node` of every item whose leaf box holds them."""
        if self.roots is None:
            return self._down(points, self.levels)
        boxes = {w: (g["node"].to_numpy(), g[["x0", "y0", "x1", "y1"]].to_numpy()) for w, g in self.roots.groupby("world")}

        @F.pandas_udf("array<bigint>")
        def roots_of(world: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
            out = np.empty(len(world), dtype=object)
            out[:] = [[]] * len(world)
            for w, rows in world.groupby(world).indices.items():
                if w in boxes:
                    node, b = boxes[w]
                    px, py = x.to_numpy()[rows, None], y.to_numpy()[rows, None]
                    hit = (b[:, 0] <= px) & (px <= b[:, 2]) & (b[:, 1] <= py) & (py <= b[:, 3])
                    for r in np.flatnonzero(hit.any(axis=1)):
                        out[rows[r]] = node[hit[r]].tolist()
            return pd.Series(out)

        return self._down(points.withColumn("up", F.explode(roots_of("world", "x", "y"))), self.levels[:-1])

    def _down(self, at: DataFrame, levels: list[DataFrame]) -> DataFrame:
        """Rows from their node `up` (from the roots of their world, where they have none) to the leaves."""
        for level in reversed(levels):
            b = level.withColumnsRenamed({"world": "b_world", "up": "b_up"})
            inside = (b["x0"] <= at["x"]) & (at["x"] <= b["x1"]) & (b["y0"] <= at["y"]) & (at["y"] <= b["y1"])
            same = at["world"] == b["b_world"]
            if "up" in at.columns:
                same = same & (at["up"] == b["b_up"])
            at = at.join(b, same & inside).select("world", "id", "x", "y", F.col("node").alias("up"))
        return at.withColumnRenamed("up", "node")


def regions_of(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(world, id, region) of every region that holds a point. points: world, id, x, y; regions: world, region, ring."""
    scratch = Scratch(points.sparkSession, "regions")
    box = {f"{c}{i}": f(*[F.col(f"{c}{k}") for k in (1, 2, 3)]) for c in "xy" for i, f in ((0, F.least), (9, F.greatest))}
    tri = triangles(regions).withColumns({f"b{c}": v for c, v in box.items()})
    corners = [f"{c}{i}" for i in (1, 2, 3) for c in "xy"]
    items = tri.select("world", "region", F.array(*corners).alias("t"), F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx9").alias("x1"), F.col("by9").alias("y1"))
    tree = BoxHierarchy(items, scratch)
    if tree.empty:
        return points.select("world", "id", F.lit(None).cast("bigint").alias("region")).limit(0)
    at = tree.descend(placed(points).select("world", "id", "x", "y"))
    t = tree.items.select("t", "region", F.col("node").alias("t_node"), F.col("world").alias("t_world"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    c = [F.col("t")[i] for i in range(6)]
    side = lambda i, j: (c[j] - c[i]) * (F.col("y") - c[i + 1]) - (c[j + 1] - c[i + 1]) * (F.col("x") - c[i])
    a, b, d = side(0, 2), side(2, 4), side(4, 0)
    near = (F.col("x") >= F.col("t_x0")) & (F.col("x") <= F.col("t_x1")) & (F.col("y") >= F.col("t_y0")) & (F.col("y") <= F.col("t_y1"))
    exact = ((a >= 0) & (b >= 0) & (d >= 0)) | ((a <= 0) & (b <= 0) & (d <= 0))
    hits = at.join(t, (F.col("node") == F.col("t_node")) & (F.col("world") == F.col("t_world")) & near & exact)
    return hits.select("world", "id", "region").distinct()
