"""Graph operators on edge tables (src, dst, ...).

Iterations are joins whose state is written to the shared folder each round; no neighbourhood is ever collected.
"""

from __future__ import annotations

import bisect
import contextlib
import heapq
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.session import Scratch, mounted

#: Edges that may be handed to every task as arrays (16 bytes each), or from which on routes go by given cells.
SNAPSHOT_EDGES = 5_000_000


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("w", "a", "b").unionByName(e.select("w", F.col("b").alias("a"), F.col("a").alias("b")))


def rewired(edges: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Edges (w, a, b) with a > b after round k of minimum propagation over rewired neighbourhoods.

    The larger neighbours of a vertex, then a vertex and its smaller ones, are linked to the least vertex seen, so the
    components stay and distances within them shrink. Minima are aggregated before the shuffle, and both sides of the
    joins are written tables, so AQE splits what a hot vertex receives.
    """
    least = scratch.write(both_ways(edges).groupBy("w", "a").agg(F.min("b").alias("m")), f"least-{k}")
    moved = edges.join(least.select("w", F.col("a").alias("b"), "m"), ["w", "b"]).select("w", "a", F.least("b", "m").alias("b"))
    moved = scratch.write(moved.distinct(), f"moved-{k}")
    least2 = scratch.write(moved.groupBy("w", "a").agg(F.min("b").alias("m")), f"least2-{k}")
    both = moved.join(least2, ["w", "a"])
    pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    new = both.select("w", F.explode(pairs).alias("p")).select("w", "p.a", "p.b").filter("a <> b").distinct()
    new = scratch.write(new, f"rewired-{k}")
    for t in (f"least-{k}", f"moved-{k}", f"least2-{k}"):
        scratch.drop(t)
    return new


def least_labels(edges: DataFrame, scratch: Scratch, k: int = 0) -> DataFrame:
    """(w, a, root) of every vertex of the edges (w, a, b) that isn't the least of its component.

    Rounds of rewired() until nothing changes; their number grows with the logarithm of the longest chain. k is the
    number of the first round.
    """
    state, e = None, scratch.write(edges.select("w", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), f"rewired-{k}")
    while True:
        k += 1
        e = rewired(e, scratch, k)
        scratch.drop(f"rewired-{k - 1}")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("w", "a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select("w", "a", F.col("b").alias("root"))
        state = now


def components(edges: DataFrame) -> DataFrame:
    """(w, node, component) of a graph with BIGINT nodes, by world if the edges (w, src, dst) have one, else with an empty
    w; the component is its least node."""
    scratch = Scratch(edges.sparkSession, "components")
    w = F.col("w") if "w" in edges.columns else F.lit("")
    pairs = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(w.alias("w"), F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = scratch.write(pairs.distinct(), "pairs")
    labels = least_labels(pairs, scratch)
    every = both_ways(pairs).select("w", "a").distinct()
    return every.join(labels, ["w", "a"], "left").select("w", F.col("a").alias("node"), F.coalesce("root", "a").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of every node of an edge."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    inn = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    zero = F.lit(0).cast("bigint")
    return out.join(inn, "node", "full").select("node", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def dead_end_copies(edges: DataFrame) -> DataFrame:
    """Edges (node, dir, to, to_dir, ...) with, for a node without edges one way, copies of its edges the other way
    whose target has any edge back to it."""
    has = edges.select("node", "dir").distinct()
    back = edges.select(F.col("to").alias("node"), F.col("node").alias("to")).distinct()
    other = F.when(F.col("dir") == "forward", "backward").otherwise("forward")
    copy = edges.withColumn("dir", other).join(has, ["node", "dir"], "left_anti").join(back, ["node", "to"], "left_semi")
    return edges.unionByName(copy.select(edges.columns))


def reach(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, hops): nodes reached from seeds (node) along edges, in at most so many rounds."""
    scratch = Scratch(edges.sparkSession, "reach")
    links = scratch.write(edges.select("src", "dst").distinct(), "links")
    new = scratch.write(seeds.select("node").distinct().withColumn("hops", F.lit(0)), "hops-0")
    seen, k = new, 0
    while rounds is None or k < rounds:
        k += 1
        found = new.join(links, new["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        new = scratch.write(found.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)), f"hops-{k}")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def relax(edges: DataFrame, seeds: DataFrame, cost: Column, rounds: int | None = None) -> DataFrame:
    """(source, node, cost): least cost of every node reachable from each source, by frontier relaxation.

    Only nodes whose cost fell in the last round send on; minima are aggregated before the shuffle. With `rounds`
    paths have at most so many edges. Negative costs are an error of the caller.
    """
    scratch = Scratch(edges.sparkSession, "relax")
    e = edges.select("src", "dst", cost.alias("w")).filter("w IS NOT NULL").groupBy("src", "dst").agg(F.min("w").alias("w"))
    e = scratch.write(e, "edges")
    best = scratch.write(seeds.select(F.col("node").alias("source"), "node").distinct().withColumn("cost", F.lit(0.0)), "best-0")
    front, k = best, 0
    while rounds is None or k < rounds:
        k += 1
        step = front.join(e, front["node"] == e["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        both = best.join(step, ["source", "node"], "full")
        both = scratch.write(both.withColumn("fell", F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))), f"best-{k}")
        best = both.select("source", "node", F.least("cost", "new").alias("cost"))
        front = both.filter("fell").select("source", "node", F.col("new").alias("cost"))
        if k > 1:
            scratch.drop(f"best-{k - 2}") if k > 2 else None
        if front.isEmpty():
            break
    return best


def collapse_chains(edges: DataFrame) -> DataFrame:
    """(src, dst, hops) of a graph whose nodes with one edge in and one out are passed through.

    Interior nodes point to their successor; pointers double until they leave the chain, in logarithmic rounds. A ring
    of interior nodes only becomes one loop at its least node.
    """
    scratch = Scratch(edges.sparkSession, "chains")
    e = scratch.write(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    inner = scratch.write(degrees(e).filter("in_degree = 1 AND out_degree = 1").select("node"), "inner")
    nxt = e.join(inner, e["src"] == inner["node"], "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(1).cast("bigint").alias("hops"), F.least("src", "dst").alias("low"))
    nxt = scratch.write(nxt, "next-0")
    n, k = max(nxt.count(), 1), 0
    while 2**k < n:
        k += 1
        step = nxt.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("low").alias("low2"))
        new = nxt.join(step, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.least("low", F.coalesce("low2", "low")).alias("low"))
        nxt = scratch.write(new, f"next-{k}")
        open_ = nxt.join(inner, nxt["to"] == inner["node"], "left_semi").agg(F.count(F.lit(1)), F.sum(F.xxhash64("low").cast("decimal(38,0)"))).first()
        if open_[0] == 0:
            break
    ring = nxt.join(inner, nxt["to"] == inner["node"], "left_semi")
    size = ring.groupBy("low").agg(F.count(F.lit(1)).alias("hops"))
    loops = size.select(F.col("low").alias("src"), F.col("low").alias("dst"), "hops")
    heads = e.join(inner, e["src"] == inner["node"], "left_anti")
    out = heads.join(nxt.select(F.col("node").alias("dst"), "to", "hops"), "dst", "left")
    return out.select("src", F.coalesce("to", "dst").alias("dst"), (F.lit(1) + F.coalesce("hops", F.lit(0))).alias("hops")).unionByName(loops)


def prune_dead_ends(edges: DataFrame) -> DataFrame:
    """Edges left after nodes without an edge in or without one out are taken away again and again."""
    scratch = Scratch(edges.sparkSession, "prune")
    e = scratch.write(edges.select("src", "dst").distinct(), "edges-0")
    n, k = e.count(), 0
    while True:
        k += 1
        new = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        new = scratch.write(new.select("src", "dst"), f"edges-{k}")
        m = new.count()
        if m == n:
            return new
        e, n = new, m


def short_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(nodes, length) of simple cycles of 2 to `longest` nodes, each once, starting with its least node.

    Paths grow only over nodes larger than their first one, and only among edges that lie on some cycle.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    e = scratch.write(prune_dead_ends(edges.filter("src <> dst")), "edges")
    path = e.filter("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes"))
    closing = e.select(F.col("src").alias("last"), F.col("dst").alias("first"))
    found = None
    for length in range(2, longest + 1):
        path = scratch.write(path, f"paths-{length}")
        if found is not None and path.isEmpty():
            break
        done = path.join(closing, ["last", "first"]).select("nodes", F.lit(length).alias("length"))
        found = done if found is None else found.unionByName(done)
        grown = path.join(e, path["last"] == e["src"]).filter((F.col("dst") > F.col("first")) & ~F.array_contains("nodes", F.col("dst")))
        path = grown.select("first", F.col("dst").alias("last"), F.array_append("nodes", F.col("dst")).alias("nodes"))
    return found


class Snapshot:
    """Edges as arrays in order of their source, for searches inside tasks."""

    def __init__(self, pdf: pd.DataFrame):
        nodes = np.union1d(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        src, dst = np.searchsorted(nodes, pdf["src"]), np.searchsorted(nodes, pdf["dst"])
        order = np.lexsort((dst, src))
        self.nodes, self.dst, self.cost = nodes, dst[order], pdf["cost"].to_numpy(float)[order]
        self.start = np.searchsorted(src[order], np.arange(len(nodes) + 1))

    def at(self, node: int) -> int | None:
        i = int(np.searchsorted(self.nodes, node))
        return i if i < len(self.nodes) and self.nodes[i] == node else None

    def search(self, starts: list[tuple[float, int]], goals: set[int] | None = None, bound: float = math.inf) -> tuple[dict[int, float], dict[int, int]]:
        """(least cost, node before) of the nodes reached from starts (cost, node) below a bound, or until all goals are
        settled; ties go to the node with the smaller id."""
        best, came, heap, left = {}, {}, [], set(goals) if goals else None
        for cost, u in starts:
            if cost < best.get(u, bound):
                best[u] = cost
                heap.append((cost, u))
        heapq.heapify(heap)
        while heap:
            cost, u = heapq.heappop(heap)
            if cost > best[u]:
                continue
            if left is not None:
                left.discard(u)
                if not left:
                    break
            for i in range(self.start[u], self.start[u + 1]):
                v, c = int(self.dst[i]), cost + float(self.cost[i])
                if c < best.get(v, bound):
                    best[v], came[v] = c, u
                    heapq.heappush(heap, (c, v))
        return best, came

    def path(self, came: dict[int, int], node: int) -> list[int]:
        """Nodes from a start to a node."""
        out = [node]
        while out[-1] in came:
            out.append(came[out[-1]])
        return [int(self.nodes[i]) for i in reversed(out)]


def _least_edges(edges: DataFrame) -> DataFrame:
    own = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND cost IS NOT NULL")
    return own.groupBy("src", "dst").agg(F.min("cost").alias("cost"))


class Stored:
    """Edges in files of the shared folder, in order of their source; tasks map them into memory, none holds a copy.

    files: (least source, greatest source, path) in order; a path stands for three arrays of equal length.
    """

    def __init__(self, files: list[tuple[int, int, str]]):
        self.files, self.low, self.opened = files, [f[0] for f in files], {}

    def out(self, node: int) -> Iterator[tuple[int, float]]:
        """(node, cost) of the edges from a node."""
        k = bisect.bisect_right(self.low, node) - 1
        if k < 0 or node > self.files[k][1]:
            return iter(())
        if k not in self.opened:
            self.opened[k] = [np.asarray(np.memmap(f"{self.files[k][2]}.{c}", dtype, "r")) for c, dtype in _EDGE.items()]
        src, dst, cost = self.opened[k]
        i, j = np.searchsorted(src, np.int64(node)), np.searchsorted(src, np.int64(node), "right")
        return zip(dst[i:j].tolist(), cost[i:j].tolist(), strict=True)

    def search(self, start: int, goals: set[int]) -> tuple[dict[int, float], dict[int, int]]:
        """(least cost, node before) of the nodes reached from a node until all goals are settled; ties go to the node
        with the smaller id."""
        best, came, heap, left = {start: 0.0}, {}, [(0.0, start)], set(goals)
        while heap and left:
            cost, u = heapq.heappop(heap)
            if cost > best[u]:
                continue
            left.discard(u)
            for v, w in self.out(u) if left else ():
                if cost + w < best.get(v, math.inf):
                    best[v], came[v] = cost + w, u
                    heapq.heappush(heap, (cost + w, v))
        return best, came


_EDGE = {"src": "<i8", "dst": "<i8", "cost": "<f8"}


def _stored(edges: DataFrame, folder: str) -> list[tuple[int, int, str]]:
    """Edges written to a folder that all tasks can open, as files of Stored; the driver gets a row for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        path, low, high = f"{folder}/{uuid.uuid4().hex}", None, None  # a name of its own for every attempt
        with contextlib.ExitStack() as stack:
            to = {c: stack.enter_context(open(f"{path}.{c}", "wb")) for c in _EDGE}
            for b in batches:
                if b.num_rows:
                    for c, dtype in _EDGE.items():
                        b.column(c).to_numpy(zero_copy_only=False).astype(dtype, copy=False).tofile(to[c])
                    low, high = b.column("src")[0].as_py() if low is None else low, b.column("src")[-1].as_py()
        if low is not None:
            yield pa.RecordBatch.from_pydict({"low": [low], "high": [high], "path": [path]})

    sorted_ = edges.select(*_EDGE).repartitionByRange("src").sortWithinPartitions("src", "dst")
    return sorted((r[0], r[1], r[2]) for r in sorted_.mapInArrow(write, "low bigint, high bigint, path string").collect())


def routes(edges: DataFrame, requests: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(src, dst, cost, path): the cheapest route of each distinct request (src, dst) over directed edges (src, dst, cost)
    with BIGINT nodes; requests without a route are left out, one from a node to itself costs 0.

    The edges are sorted into files of the shared folder, which the tasks map into memory and search for their requests.
    With cells given, a graph of more than SNAPSHOT_EDGES edges, counted, is searched by routes_by_cells(); so is any where
    the shared folder is no mounted one. Costs and paths are the same but for ties between equal routes.
    """
    spark = edges.sparkSession
    wanted = requests.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    own = _least_edges(edges)
    scratch = Scratch(spark, "routes")
    folder = mounted(spark, scratch.root)
    if folder is None or (cells is not None and own.count() > SNAPSHOT_EDGES):
        return routes_by_cells(own, wanted, cells)
    files = _stored(own, folder)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = Stored(files)
        for pdf in batches:
            rows = []
            for a, group in pdf.groupby("src"):
                a, goals = int(a), set(group["dst"].tolist())
                best, came = graph.search(a, goals)
                for b in goals & best.keys():
                    path = [b]
                    while path[-1] != a:
                        path.append(came[path[-1]])
                    rows.append((a, b, best[b], path[::-1]))
            yield pd.DataFrame(rows, columns=["src", "dst", "cost", "path"])

    return wanted.repartition("src").mapInPandas(search, _ROUTE)


_ROUTE = "src bigint, dst bigint, cost double, path array<bigint>"
_LABEL = "kind string, cell bigint, block int, source bigint, node bigint, cost double, path array<bigint>"
#: Sources whose searches meet in one task, and cells of a graph that comes without any.
SOURCES, CELLS = 256, 4096


def routes_by_cells(edges: DataFrame, wanted: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """routes() for graphs of any size: the nodes stand in cells (node, cell) of a size that fits a task, by default in
    CELLS hashed ones.

    A round searches every cell that has news to the end, in its own task, for a block of sources at a time: news are
    entries (source, node, cost, path so far), the results are arrivals at goals and entries into neighbouring cells.
    Entries that don't improve on earlier ones, or that cost as much as all goals of their source already do, are
    dropped, so the rounds end after as many as the routes change cells, not after as many as they have edges.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "routes")
    wanted = scratch.write(wanted, "wanted")
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    if cells is None:
        cells = nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(CELLS)).alias("cell"))
    cells = scratch.write(cells.groupBy("node").agg(F.min("cell").cast("bigint").alias("cell")), "cells")
    here = lambda c, name: cells.select(F.col("node").alias(c), F.col("cell").alias(name))
    own = edges.join(here("src", "cell"), "src").join(here("dst", "to_cell"), "dst").select("cell", "src", "dst", "cost", "to_cell")
    goals = wanted.select(F.col("dst").alias("src")).distinct().join(here("src", "cell"), "src").select("cell", "src", F.lit(None).cast("bigint").alias("dst"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("bigint").alias("to_cell"))
    own = scratch.write(own.unionByName(goals), "edges")
    sources = wanted.select(F.col("src").alias("source")).distinct()
    blocks = -(-max(sources.count(), 1) // SOURCES)
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    front = sources.join(here("source", "cell"), "source").select("cell", block.alias("block"), "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.array("source").alias("path"))
    front, best, hits, k = scratch.write(front, "front-0"), None, None, 0
    while not front.isEmpty():
        k += 1
        busy = scratch.read(f"front-{k - 1}", front.schema).select("cell", "block").distinct()
        around = own.join(busy, "cell")
        out = front.groupBy("cell", "block").cogroup(around.groupBy("cell", "block")).applyInPandas(_search_cell, _LABEL)
        out = scratch.write(out, f"labels-{k}")
        new_hits = out.filter("kind = 'hit'").select(F.col("source").alias("src"), F.col("node").alias("dst"), "cost", "path").join(wanted, ["src", "dst"], "left_semi")
        hits = new_hits if hits is None else hits.unionByName(new_hits)
        hits = scratch.write(hits.groupBy("src", "dst").agg(F.min(F.struct("cost", "path")).alias("m")).select("src", "dst", "m.cost", "m.path"), f"hits-{k}")
        limit = wanted.join(hits.select("src", "dst", "cost"), ["src", "dst"], "left").groupBy(F.col("src").alias("source")).agg(F.max(F.coalesce("cost", F.lit(math.inf))).alias("most"))
        news = out.filter("kind = 'entry'").groupBy("cell", "block", "source", "node").agg(F.min(F.struct("cost", "path")).alias("m")).select("cell", "block", "source", "node", "m.cost", "m.path")
        news = news.join(limit, "source").filter("cost < most").drop("most")
        if best is not None:
            news = news.join(best.select("source", "node", F.col("cost").alias("old")), ["source", "node"], "left").filter("old IS NULL OR cost < old").drop("old")
        front = scratch.write(news.select("cell", "block", "source", "node", "cost", "path"), f"front-{k}")
        seen = front.select("source", "node", "cost")
        best = seen if best is None else best.unionByName(seen).groupBy("source", "node").agg(F.min("cost").alias("cost"))
        best = scratch.write(best, f"best-{k}")
    if hits is None:
        hits = spark.createDataFrame([], _ROUTE)
    same = wanted.filter("src = dst").select("src", "dst", F.lit(0.0).alias("cost"), F.array("src").alias("path"))
    return hits.filter("src <> dst").unionByName(same)


def _search_cell(key, news: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
    """Entries of a cell followed to the end within it: arrivals at goals and entries into other cells."""
    names = ["kind", "cell", "block", "source", "node", "cost", "path"]
    goals = around["dst"].isna()
    goal_nodes = around.loc[goals, "src"].astype(np.int64)
    e = around[~goals].astype({"src": np.int64, "dst": np.int64, "to_cell": np.int64})
    if not len(e):
        e = pd.DataFrame({"src": [-1], "dst": [-1], "cost": [math.inf], "to_cell": [key[0]]})
    inside = e["to_cell"] == key[0]
    graph = Snapshot(pd.concat([e[inside][["src", "dst", "cost"]], pd.DataFrame({"src": (own := np.unique(np.concatenate([e["src"], goal_nodes, news["node"]]))), "dst": own, "cost": 0.0})]))
    leaving = {int(u): list(zip(g["dst"], g["cost"], g["to_cell"], strict=True)) for u, g in e[~inside].groupby("src")}
    rows = []
    for source, g in news.groupby("source"):
        entries = {int(n): (float(c), list(p)) for n, c, p in zip(g["node"], g["cost"], g["path"], strict=True)}
        best, came = graph.search([(c, graph.at(n)) for n, (c, _) in entries.items()])

        def whole(i: int, came=came, entries=entries) -> list[int]:
            path = graph.path(came, i)
            return entries[path[0]][1][:-1] + path

        rows += [("hit", key[0], key[1], source, n, best[i], whole(i)) for n in goal_nodes.tolist() if (i := graph.at(n)) in best]
        for u, ways in leaving.items():
            if (i := graph.at(u)) in best:
                path = whole(i)
                rows += [("entry", int(cell), key[1], source, int(v), best[i] + float(c), [*path, int(v)]) for v, c, cell in ways]
    return pd.DataFrame(rows, columns=names)


def costs_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(source, node, cost): least cost from each seed (node) to every node it reaches over edges (src, dst, cost).

    A graph of at most SNAPSHOT_EDGES edges is handed to the tasks of its seeds and searched there; a larger one is
    relaxed by joins.
    """
    own = _least_edges(edges)
    if own.count() > SNAPSHOT_EDGES:
        return relax(own, seeds.filter("node IS NOT NULL"), F.col("cost"))
    graph = edges.sparkSession.sparkContext.broadcast(Snapshot(own.toPandas()))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in pdf["node"]:
                start = graph.value.at(int(a))
                best = graph.value.search([(0.0, start)])[0] if start is not None else {}
                at = np.fromiter(best, np.int64, len(best))
                reached = graph.value.nodes[at] if len(at) else at
                own = pd.DataFrame({"source": a, "node": reached, "cost": np.fromiter(best.values(), float, len(best))})
                yield own if len(at) else pd.DataFrame({"source": [a], "node": [a], "cost": [0.0]})

    return seeds.select("node").filter("node IS NOT NULL").distinct().mapInPandas(search, "source bigint, node bigint, cost double")
