"""Spatial joins: nearest neighbours, boxes, sectors, lines and density clusters.

All joins are equi-joins on grid cells with an exact test behind them; none is a cross join and no index is handed to
the tasks beyond tables counted as small. Nearest neighbours go down a tree of cells that are cut where the points are
dense, so a crowded spot costs more levels, not more pairs. Boxes stand in cells of their own size. Rows without a
finite position take no part. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from waymill.functions.geometry import distance
from waymill.operators import blocks
from waymill.operators.graph import least_labels
from waymill.operators.proximity import placed
from waymill.session import BROADCAST_ROWS, Scratch


def cell(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("bigint")


def covered_cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Array of the cells (cx, cy) that a box covers."""
    xs, ys = (F.sequence(cell(a, size), cell(b, size)) for a, b in ((x0, x1), (y0, y1)))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def _nearest(candidates: DataFrame, k: int, q_cols: list[str]) -> DataFrame:
    """k nearest of each query among (q columns, p_id, d)."""
    if k == 1:  # a minimum is aggregated before the shuffle
        best = candidates.groupBy(*q_cols).agg(F.min(F.struct("d", "p_id")).alias("m"))
        return best.select(*q_cols, F.col("m.p_id").alias("p_id"), F.col("m.d").alias("d"), F.lit(1).alias("rank"))
    rank = F.row_number().over(W.partitionBy(*q_cols).orderBy("d", "p_id"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Points of a leaf of the tree, levels a round goes down, and the deepest level (for points in one spot).
LEAF, STEP, DEEPEST = 32, 2, 40


def _counted(df: DataFrame, rows: int) -> DataFrame:
    """A side for a join, broadcast if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class _Tree:
    """Cells over points (by, p_id, px, py): a cell with more than `leaf` points is cut into 4 ** STEP.

    levels: tables (by, parent, cell, n, x0, y0, x1, y1, done) with their numbers of rows; a cell that is done is a leaf.
    points: (by, cell, p_id, px, py) by leaf.
    """

    def __init__(self, points: DataFrame, box: tuple[float, float, float], leaf: int, by: tuple[str, ...], scratch: Scratch):
        x0, y0, extent = box
        at = lambda level: F.concat_ws(":", F.lit(level), cell(F.col("px") - x0, extent / 2**level), cell(F.col("py") - y0, extent / 2**level))
        self.levels: list[tuple[DataFrame, int]] = []
        self.points, rest, level = None, points, 0
        while True:
            level += STEP
            own = rest.withColumns({"cell": at(level), "parent": at(level - STEP) if level > STEP else F.lit("0")})
            sides = [F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1")]
            cells = own.groupBy(*by, "parent", "cell").agg(F.count(F.lit(1)).alias("n"), *sides)
            done = (F.col("n") <= leaf) | ((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))) | F.lit(level >= DEEPEST)
            cells = scratch.write(cells.withColumn("done", done), f"cells-{level}")
            n, n_open = cells.agg(F.count(F.lit(1)), F.count_if(~F.col("done"))).first()
            self.levels.append((cells, n))
            marked = own.join(_counted(cells.select(*by, "cell", "done"), n), [*by, "cell"])
            marked = scratch.write(marked.select(*by, "cell", "p_id", "px", "py", "done"), f"points-{level}")
            leaves = marked.filter("done").drop("done")
            self.points = leaves if self.points is None else self.points.unionByName(leaves)
            if not n_open:
                return
            rest = marked.filter("NOT done").select(*by, "p_id", "px", "py")


def knn_join(queries: DataFrame, points: DataFrame, k: int = 1, radius: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, p_id, d, rank): the k nearest points of each query, within a radius if one is given.

    queries: id, x, y and the `by` columns; points likewise; only rows equal in the `by` columns meet (null equals
    nothing). Queries go down a tree of cells: a round replaces the cells a query still looks at by those below them and
    drops those whose box is farther away than a box that surely holds k points, or the radius. Only the points of the
    leaves that are left are measured. Rounds are as many as the deepest spot needs; of points in one position only the
    k with the smallest ids take part.
    """
    scratch = Scratch(queries.sparkSession, "knn")
    p = placed(points).select(*by, F.col("id").alias("p_id"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).filter("p_id IS NOT NULL")
    q = placed(queries).select(*by, F.col("id").alias("q_id"), F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy")).distinct()
    if k == 1:
        p = p.groupBy(*by, "px", "py").agg(F.min("p_id").alias("p_id"))
    else:  # the least ids of a position, by hashed parts first
        part = F.pmod(F.xxhash64("p_id"), F.lit(64))
        for w in (W.partitionBy(*by, "px", "py", part), W.partitionBy(*by, "px", "py")):
            p = p.distinct().withColumn("nth", F.row_number().over(w.orderBy("p_id"))).filter(F.col("nth") <= k).drop("nth")
    p = scratch.write(p.select(*by, "p_id", "px", "py"), "distinct")
    lim = p.agg(F.min("px"), F.min("py"), F.max("px"), F.max("py")).first()
    if lim[0] is None:
        return q.select("q_id", F.lit(None).cast(p.schema["p_id"].dataType).alias("p_id"), F.lit(0.0).alias("d"), F.lit(0).alias("rank")).limit(0)
    extent = max(lim[2] - lim[0], lim[3] - lim[1], 1e-9) * (1 + 1e-9)
    tree = _Tree(p, (lim[0], lim[1], extent), max(LEAF, 2 * k), by, scratch)
    gap = lambda c, f: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(f"q{c}"), F.col(f"q{c}") - F.col(f"{c}1")) if f else F.greatest(F.abs(F.col(f"q{c}") - F.col(f"{c}0")), F.abs(F.col(f"q{c}") - F.col(f"{c}1")))
    length = lambda f: F.sqrt(gap("x", f) * gap("x", f) + gap("y", f) * gap("y", f))
    far = float(radius) if radius is not None else math.inf
    look = q.withColumns({"parent": F.lit("0"), "most": F.lit(far)})
    ready = None
    mine = W.partitionBy(*by, "q_id", "qx", "qy")
    for i, (cells, n) in enumerate(tree.levels):
        met = look.join(_counted(cells, n), [*by, "parent"]).withColumns({"least": length(True), "worst": length(False) * (1 + 1e-12)})
        met = met.filter(F.col("least") <= F.col("most"))
        most = F.least("most", F.coalesce(F.min(F.when(F.col("n") >= k, F.col("worst"))).over(mine), F.lit(math.inf)))
        met = met.withColumn("most", most).filter(F.col("least") <= F.col("most")).select(*by, "q_id", "qx", "qy", "cell", "most", "done")
        met = scratch.write(met, f"looks-{i}")
        leaves = met.filter("done").drop("done")
        ready = leaves if ready is None else ready.unionByName(leaves)
        look = met.filter("NOT done").drop("done").withColumnRenamed("cell", "parent")
    d = distance(F.col("qx"), F.col("qy"), F.col("px"), F.col("py"))
    met = ready.join(tree.points, [*by, "cell"]).withColumn("d", d).filter((F.col("d") <= F.col("most")) & (F.col("d") <= far))
    return _nearest(met.select("q_id", "p_id", "d"), k, ["q_id"]).select("q_id", "p_id", "d", "rank")


def _level(x0: Column, y0: Column, x1: Column, y1: Column, base: float) -> Column:
    """Level of a box: its longer side is at most base * 2 ** level."""
    side = F.greatest(x1 - x0, y1 - y0) / base
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1e-300))))).cast("int")


def _cells_of_level(x0: Column, y0: Column, x1: Column, y1: Column, level: Column, base: float) -> Column:
    """The cells (cx, cy) of a level that a box of at most that level covers: at most four."""
    size = F.pow(F.lit(2.0), level) * base
    at = lambda c: F.floor(c / size).cast("bigint")
    xs, ys = F.sequence(at(x0), at(x1)), F.sequence(at(y0), at(y1))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def _boxed(boxes: DataFrame, size: float) -> tuple[DataFrame, list[int]]:
    """Boxes with finite, ordered sides and their level, and the levels there are (a handful, each twice the last)."""
    sides = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    ok = boxes.filter("x0 <= x1 AND y0 <= y1").filter(F.greatest(*[F.abs(c) for c in sides]) < float("inf"))
    ok = ok.withColumn("level", _level(*sides, size))
    return ok, [r[0] for r in ok.select("level").distinct().collect()]


def box_join(points: DataFrame, boxes: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """points (id, x, y, by) with every box (b_id, x0, y0, x1, y1, by) that holds them, edges included.

    A box stands in the cells, four at most, of a level of its own size (size, doubled again and again); a point looks at
    one cell of each level there is, so no pair comes out twice and a large box costs no more than a small one.
    """
    b, levels = _boxed(boxes, size)
    sides = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    b = b.withColumn("c", F.explode(_cells_of_level(*sides, F.col("level"), size))).select("*", "c.cx", "c.cy").drop("c")
    scale = F.pow(F.lit(2.0), F.col("level")) * size
    p = placed(points).withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels]).cast("array<int>")))
    p = p.withColumns({c: F.floor(F.col(a) / scale).cast("bigint") for c, a in (("cx", "x"), ("cy", "y"))})
    met = p.join(b, [*by, "level", "cx", "cy"]).drop("cx", "cy", "level")
    return met.filter((F.col("x0") <= F.col("x")) & (F.col("x") <= F.col("x1")) & (F.col("y0") <= F.col("y")) & (F.col("y") <= F.col("y1")))


def overlap_join(left: DataFrame, right: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(l_id, r_id) of boxes (id, x0, y0, x1, y1, by) that overlap or touch.

    Boxes of two levels meet in cells of the larger one, of which each covers four at most; a pair counts in the first
    cell that both cover.
    """
    (l, l_levels), (r, r_levels) = _boxed(left, size), _boxed(right, size)

    def copied(df: DataFrame, mark: str, other: list[int], mine: str, theirs: str) -> DataFrame:
        own = df.select(*by, *[F.col(c).alias(f"{mark}_{c}") for c in ("id", "x0", "y0", "x1", "y1")], F.col("level").alias(mine))
        own = own.withColumn(theirs, F.explode(F.array(*[F.lit(i) for i in other]).cast("array<int>")))
        cells = _cells_of_level(*[F.col(f"{mark}_{c}") for c in ("x0", "y0", "x1", "y1")], F.greatest(mine, theirs), size)
        return own.withColumn("c", F.explode(cells)).select("*", "c.cx", "c.cy").drop("c")

    met = copied(l, "l", r_levels, "ll", "rl").join(copied(r, "r", l_levels, "rl", "ll"), [*by, "ll", "rl", "cx", "cy"])
    x, y = (F.greatest(F.col(f"l_{c}0"), F.col(f"r_{c}0")) for c in "xy")
    scale = F.pow(F.lit(2.0), F.greatest("ll", "rl")) * size
    met = met.filter((x <= F.least("l_x1", "r_x1")) & (y <= F.least("l_y1", "r_y1")) & (F.floor(x / scale) == F.col("cx")) & (F.floor(y / scale) == F.col("cy")))
    return met.select("l_id", "r_id")


def sector_neighbours(left: DataFrame, right: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Every pair (l_id, r_id) whose sectors are the same or neighbours."""
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    a = placed(left).select(*by, F.col("id").alias("l_id"), cell("x", size).alias("sx"), cell("y", size).alias("sy"), F.explode(o).alias("o"))
    a = a.select(*by, "l_id", (F.col("sx") + F.col("o.a")).alias("cx"), (F.col("sy") + F.col("o.b")).alias("cy"))
    b = placed(right).select(*by, F.col("id").alias("r_id"), cell("x", size).alias("cx"), cell("y", size).alias("cy"))
    return a.join(b, [*by, "cx", "cy"]).select(*by, "l_id", "r_id")


def segments(line: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Segments of lines given as vertices (line, ord, x, y), with the length run before each. Vertices without a finite
    position are passed over."""
    w = W.partitionBy(*by, "line").orderBy("ord")
    out = placed(line).withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    out = out.withColumn("len", distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))
    return out.withColumn("before", F.coalesce(F.sum("len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).filter("x2 IS NOT NULL")


#: Positions of a tile where lines or boxes meet them, on average over the extent.
TILE_LINES, TILE_BOXES = 40, 512


def _spots(points: DataFrame, by: tuple[str, ...], each: int, scratch: Scratch) -> tuple[DataFrame, tuple[float, float, float, float], float]:
    """The distinct positions (by, x, y), their extent, and the size of tiles that hold so many on average."""
    own = placed(points).select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    own = scratch.write(own, "spots")
    n, *lim = own.agg(F.count(F.lit(1)), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    lim = tuple(0.0 if v is None else v for v in lim)
    return own, lim, max(lim[2] - lim[0], lim[3] - lim[1], 1e-9) / max(1.0, math.sqrt(n / each))


def _at_spots(points: DataFrame, found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Distinct (by, id, x, y) of points with what was found at their positions (by, x, y, ...)."""
    own = placed(points).select(*by, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes may give many rows
    return own.repartition(parts, *by, "x", "y").join(found.repartition(parts, *by, "x", "y"), [*by, "x", "y"])


def _several(points: DataFrame, by: tuple[str, ...]) -> DataFrame | None:
    """(by, id) of points with more than one position, None if there is no such."""
    own = placed(points).groupBy(*by, "id").agg(*[f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in "xy"])
    own = own.filter("min_x <> max_x OR min_y <> max_y").select(*by, "id")
    return None if own.isEmpty() else own


def near_lines(points: DataFrame, line: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(line, id, d, location): points within a radius of a line, with the distance and how far along they lie.

    Points in one position share the answer. A segment is cut into pieces no longer than a tile, each copied to the tiles
    around it, so long segments cost no more tiles than they cross; in a tile positions meet segments in blocks, which give
    one row for each line and position. The nearest segment of each (line, point) counts, the earlier one on ties.
    """
    scratch = Scratch(points.sparkSession, "lines")
    spots, lim, size = _spots(points, by, TILE_LINES, scratch)
    size = max(size, 2 * radius)
    s = segments(line, by)
    n = F.greatest(F.lit(1), F.ceil(F.col("len") / size).cast("int"))
    s = s.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, i: F.col(c) + (F.col(f"{c}2") - F.col(c)) * i / F.col("n")
    pad = radius * (1 + 1e-9)
    s = s.withColumns({f"{c}{e}": f(at(c, F.col("i")), at(c, F.col("i") + 1)) + e_off for c in "xy" for e, f, e_off in ((0, F.least, -pad), (9, F.greatest, pad))})
    s = s.filter((F.col("x0") <= lim[2]) & (F.col("x9") >= lim[0]) & (F.col("y0") <= lim[3]) & (F.col("y9") >= lim[1]))
    s = s.withColumn("c", F.explode(covered_cells(F.col("x0"), F.col("y0"), F.col("x9"), F.col("y9"), size)))
    s = s.select(*by, "c.cx", "c.cy", "line", "ord", *[F.col(a).cast("double").alias(b) for a, b in (("x", "ax"), ("y", "ay"), ("x2", "bx"), ("y2", "by"), ("before", "before"), ("len", "len"))]).distinct()
    p = spots.withColumns({"cx": cell("x", size), "cy": cell("y", size)})
    real = [StructField(c, DoubleType()) for c in ("x", "y", "d", "location")]
    schema = StructType([*[p.schema[k] for k in by], s.schema["line"], s.schema["ord"], *real])

    def nearest(here: pa.Table, legs: pa.Table) -> pa.Table:
        codes = legs["line"].combine_chunks().dictionary_encode(null_encoding="encode").indices
        legs = legs.append_column("_line", codes).sort_by([("_line", "ascending"), ("ord", "ascending")])
        lines = legs["_line"].to_numpy()
        (x, y), (ax, ay, bx, by_, before, length) = blocks.numbers(here, "x", "y"), blocks.numbers(legs, "ax", "ay", "bx", "by", "before", "len")
        dx, dy = bx - ax, by_ - ay
        square = length * length
        own: list[list[np.ndarray]] = [[], [], [], []]
        for k in blocks.slices(len(x), len(ax)):
            px, py = x[k, None], y[k, None]
            t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(square == 0, 1.0, square), 0, 1)
            t[:, square == 0] = 0
            d = np.sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)
            i, j = np.nonzero(d <= radius)
            hit = d[i, j]
            order = np.lexsort((hit, lines[j], i))  # stable: the earlier segment stays first
            i, j, hit = i[order], j[order], hit[order]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1]) | (lines[j[1:]] != lines[j[:-1]])
            i, j, hit = i[first], j[first], hit[first]
            for o, v in zip(own, (i + k.start, j, hit, before[j] + t[i, j] * length[j]), strict=True):
                o.append(v)
        i, j, d, location = map(np.concatenate, own)
        here, legs = here.take(pa.array(i)), legs.take(pa.array(j))
        return pa.table({**{b: here[b] for b in by}, "line": legs["line"], "ord": legs["ord"], "x": here["x"], "y": here["y"], "d": d, "location": location})

    least = lambda df, *keys: df.groupBy(*by, "line", *keys).agg(F.min(F.struct("d", "ord", "location")).alias("m"))
    best = scratch.write(least(blocks.met(p, s, [*by, "cx", "cy"], nearest, schema), "x", "y").select(*by, "line", "x", "y", "m.*"), "nearest")
    out = _at_spots(points, best, by)
    if (several := _several(points, by)) is not None:  # such an id takes the nearest of its positions
        twice = least(out.join(several, [*by, "id"], "left_semi"), "id").select(*by, "line", "id", "m.*")
        out = out.join(several, [*by, "id"], "left_anti").select(twice.columns).unionByName(twice)
    return out.select(*by, "line", "id", "d", "location")


def within_any(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(line, id), each once: points (id, x, y) that any box (line, x0, y0, x1, y1) of a line holds, edges included.

    Points in one position share the answer. Positions meet boxes in tiles and blocks; there the larger boxes of a line
    come first and what they hold is left out of the rest, so boxes that lie over each other cost no pairs.
    """
    scratch = Scratch(points.sparkSession, "within")
    spots, lim, size = _spots(points, (), TILE_BOXES, scratch)
    sides = {c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}
    b = boxes.select("line", *[v.alias(k) for k, v in sides.items()]).filter("x0 <= x1 AND y0 <= y1")
    b = b.filter((F.col("x0") <= lim[2]) & (F.col("x1") >= lim[0]) & (F.col("y0") <= lim[3]) & (F.col("y1") >= lim[1]))
    inside = lambda c, a, z: F.least(F.greatest(F.col(c), F.lit(a)), F.lit(z))
    cells = covered_cells(inside("x0", lim[0], lim[2]), inside("y0", lim[1], lim[3]), inside("x1", lim[0], lim[2]), inside("y1", lim[1], lim[3]), size)
    b = b.withColumn("c", F.explode(cells)).select("c.cx", "c.cy", "line", *sides)
    p = spots.withColumns({"cx": cell("x", size), "cy": cell("y", size)})
    schema = StructType([b.schema["line"], *[StructField(c, DoubleType()) for c in "xy"]])

    def held(here: pa.Table, own: pa.Table) -> pa.Table:
        lines = own["line"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        (x, y), (x0, y0, x1, y1) = blocks.numbers(here, "x", "y"), blocks.numbers(own, "x0", "y0", "x1", "y1")
        order = np.lexsort((-(x1 - x0) * (y1 - y0), lines))
        at, of, rest, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(0, np.int64), None
        for j in order:
            if lines[j] != last:
                rest, last = np.arange(len(x)), lines[j]
            if not len(rest):
                continue
            hit = (x0[j] <= x[rest]) & (x[rest] <= x1[j]) & (y0[j] <= y[rest]) & (y[rest] <= y1[j])
            at.append(rest[hit])
            of.append(np.full(len(at[-1]), j))
            rest = rest[~hit]
        i, j = pa.array(np.concatenate(at)), pa.array(np.concatenate(of))
        return pa.table({"line": own["line"].take(j), "x": here["x"].take(i), "y": here["y"].take(i)})

    found = scratch.write(blocks.met(p, b, ["cx", "cy"], held, schema).distinct(), "held")
    out = _at_spots(points, found, ()).select("line", "id")
    return out if _several(points, ()) is None else out.distinct()


#: Pairs of core points of two neighbouring cells that are compared one by one; beyond, each looks for its nearest.
MOST_PAIRS = 10_000


def dbscan(points: DataFrame, eps: float, min_points: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, cluster, core): density clusters; cluster is the least core id of the cluster, null for noise.

    ids are BIGINTs. A point counts itself; a border point goes to the reachable cluster with the least id. Points of
    one cell of eps / sqrt(2) are all neighbours: a cell of min_points or more makes them core without pairing, the core
    points of a cell are one, and two cells are linked by one close pair, so dense spots cost no pairs within them.
    """
    scratch = Scratch(points.sparkSession, "dbscan")
    keys = list(by)
    p = scratch.write(placed(points).select(*keys, "id", "x", "y").dropDuplicates([*keys, "id"]), "points")
    small = eps / math.sqrt(2.0) * (1 - 1e-12)
    g = p.withColumns({"sx": cell("x", small), "sy": cell("y", small)})
    full = g.groupBy(*keys, "sx", "sy").agg(F.count(F.lit(1)).alias("n"))
    dense = full.filter(F.col("n") >= min_points).withColumn("sure", F.lit(True))
    marked = scratch.write(g.join(dense.select(*keys, "sx", "sy", "sure"), [*keys, "sx", "sy"], "left"), "marked")
    pairs = _pairs(marked.filter("sure IS NULL"), p, eps, keys)
    counted = pairs.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points).select(*keys, "id")
    core = marked.filter("sure").drop("sure").unionByName(marked.filter("sure IS NULL").drop("sure").join(counted, [*keys, "id"], "left_semi"))
    core = scratch.write(core.select(*keys, "sx", "sy", "id", "x", "y"), "core")
    cells = scratch.write(core.groupBy(*keys, "sx", "sy").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")), "cells")
    # cells whose core points may be close: half of the 5 x 5 cells around, without its corners
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(3) if (b > 0 or a > 0) and abs(a) + b < 4])
    two = cells.withColumn("o", F.explode(o)).select(*keys, "sx", "sy", F.col("n").alias("n1"), F.col("first").alias("a"), (F.col("sx") + F.col("o.a")).alias("tx"), (F.col("sy") + F.col("o.b")).alias("ty"))
    two = two.join(cells.select(*keys, F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("n").alias("n2"), F.col("first").alias("b")), [*keys, "tx", "ty"])
    two = scratch.write(two, "neighbours")
    here = core.select(*keys, "sx", "sy", "id", "x", "y")
    there = core.select(*keys, F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    few, many = two.filter(F.col("n1") * F.col("n2") <= MOST_PAIRS), two.filter(F.col("n1") * F.col("n2") > MOST_PAIRS)
    close = few.join(here, [*keys, "sx", "sy"]).join(there, [*keys, "tx", "ty"]).filter(distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) <= eps)
    linked = close.select(*keys, "a", "b").distinct()
    if not many.isEmpty():
        pair = F.xxhash64("a", "b", *keys)
        left = many.join(here, [*keys, "sx", "sy"]).select(pair.alias("pair"), F.struct(*keys, "a", "b", F.col("id").alias("own")).alias("id"), "x", "y")
        right = many.join(there, [*keys, "tx", "ty"]).select(pair.alias("pair"), F.col("other").alias("id"), F.col("ox").alias("x"), F.col("oy").alias("y"))
        near = knn_join(left, right, 1, eps, ("pair",)).select(*[F.col(f"q_id.{c}").alias(c) for c in (*keys, "a", "b")])
        linked = linked.unionByName(near.distinct())
    w = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys], F.lit(""))
    labels = least_labels(linked.select(w.alias("w"), "a", "b"), scratch)
    named = cells.withColumn("_w", w).join(labels.withColumnsRenamed({"w": "_w", "a": "first"}), ["_w", "first"], "left").select(*keys, "sx", "sy", F.coalesce("root", "first").alias("cluster"))
    core = scratch.write(core.join(named, [*keys, "sx", "sy"]).select(*keys, "id", "x", "y", "cluster"), "labelled")
    rest = p.join(core.select(*keys, "id"), [*keys, "id"], "left_anti")
    border = _pairs(rest, core, eps, keys).select(*keys, "id", F.col("other")).join(core.select(*keys, F.col("id").alias("other"), "cluster"), [*keys, "other"])
    border = border.groupBy(*keys, "id").agg(F.min("cluster").alias("cluster"))
    rest = rest.join(border, [*keys, "id"], "left").select(*keys, "id", "cluster", F.lit(False).alias("core"))
    return core.select(*keys, "id", "cluster", F.lit(True).alias("core")).unionByName(rest)


def _pairs(left: DataFrame, right: DataFrame, eps: float, keys: list[str]) -> DataFrame:
    """(keys, id, other) of all pairs within eps, a point with itself included."""
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    a = left.select(*keys, "id", "x", "y", F.explode(o).alias("o"))
    a = a.withColumns({"cx": cell("x", eps) + F.col("o.a"), "cy": cell("y", eps) + F.col("o.b")})
    b = right.select(*keys, F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")).withColumns({"cx": cell("ox", eps), "cy": cell("oy", eps)})
    met = a.join(b, [*keys, "cx", "cy"])
    return met.filter(distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) <= eps).select(*keys, "id", "other")
