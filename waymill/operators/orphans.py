"""References to records that do not exist: keyed pending-orphan state kept period by period.

A reference is an orphan at time t when no row of the table it names, in the same world, has its key, arrived at
or before t and is not removed at t. OrphanTracker takes in one calendar period of arrivals after the other:

* new references probe the parent index as of their own arrival; those that miss are recorded as found;
* at the end of a period, parents that arrived resolve what waited for their key, and removals reopen the references
  of a key that had been resolved; what is open is counted by table and field as a snapshot.

All references of a key are open or closed together, so the state is one row for each (key, source table, field): how
many references there are and whether the key is missing. A key whose parent is there and never removed can't open
again: references to such a key leave by the first probe, and keys that come to have such a parent leave the state. So
a step handles the few references that are or may become orphans, the intervals that have an end and aren't over, and
its own period's arrivals, never the history. The state is a folder; a tracker opened on a named one goes on after the
last period taken in and leaves out rows of periods that it has seen. Periods without an arrival or removal need no
step: their snapshot is the one before. So a stray time costs one step, and the periods are always those asked for.

Joins are equi-joins on (table, world, key) with the time as a further condition. Tables of few rows (counted, at most
BROADCAST_ROWS) are probed by a broadcast before anything is shuffled, so a hot key of theirs never meets in one task;
anti joins with large tables keep only one row a reference, and AQE splits a hot key of the probing side. References
are counted by key before they are shuffled.

Rows whose reference is null, blank or `0`, or that have no key of their own, take no part. References without arrival
time take no part; parents without arrival time never arrived. Malformed uids equal only themselves. Repeated rows
count once.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from waymill.functions.keys import token, uid, world
from waymill.session import BROADCAST_ROWS, Scratch

REF = ["src_table", "src_key", "ref_field", "ref_table", "map_name", "ref_key", "arrived_at"]
KEY = ["ref_table", "map_name", "ref_key"]
OWNER = [*KEY, "src_table", "ref_field"]
_REFS = "src_table string, src_key string, ref_field string, ref_table string, map_name string, ref_key string, arrived_at timestamp_ntz"
_INDEX = "ref_table string, map_name string, ref_key string, p_from timestamp_ntz, p_to timestamp_ntz"
_STATE = "ref_table string, map_name string, ref_key string, src_table string, ref_field string, n_before bigint, n_new bigint, n_found bigint, was_open boolean, open boolean, settled boolean"
_SNAPSHOT = "period bigint, src_table string, ref_field string, new_orphans bigint, reopened bigint, open_orphans bigint"


def period_of(t: Column, months: int) -> Column:
    """Number of the period of so many calendar months that holds a time."""
    return F.floor((F.year(t) * 12 + F.month(t) - 1) / months)


def period_start(n: Column, months: int) -> Column:
    """First moment of a period."""
    m = n * months
    return F.make_timestamp_ntz(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def reference(df: DataFrame, src_table: str, src_key, ref_field: str, ref_table: str, ref_key) -> DataFrame:
    """One column of references in the common form; ref_key is already in reference form."""
    return df.select(
        F.lit(src_table).alias("src_table"),
        src_key.alias("src_key"),
        F.lit(ref_field).alias("ref_field"),
        F.lit(ref_table).alias("ref_table"),
        world(df["map_name"]).alias("map_name"),
        ref_key.alias("ref_key"),
        df["arrived_at"].alias("arrived_at"),
    ).filter("ref_key IS NOT NULL AND ref_key <> '0' AND arrived_at IS NOT NULL AND src_key IS NOT NULL")


def parent(df: DataFrame, name: str, key) -> DataFrame:
    """A table that is referred to, in the common form."""
    return df.select(
        F.lit(name).alias("ref_table"),
        world(df["map_name"]).alias("map_name"),
        key.alias("ref_key"),
        df["arrived_at"].alias("arrived_at"),
        df["removed_at"].alias("removed_at"),
    ).filter("ref_key IS NOT NULL AND arrived_at IS NOT NULL")


class OrphanTracker:
    """Keyed pending-orphan state over periods of so many months; see the module's text.

    state names a folder in the shared folder that outlives the tracker; without one the state goes with the run.
    """

    def __init__(self, spark: SparkSession, months: int = 3, state: str | None = None):
        self.spark, self.months = spark, months
        self.scratch = Scratch(spark, "orphans", state)
        done = self.scratch.read("steps", "period bigint").collect() if self.scratch.has("steps") else []
        self.periods = sorted(r[0] for r in done)  # periods taken in, one row each

    def _kept(self, name: str, schema: str) -> DataFrame:
        return self.scratch.read(f"{name}-{self.periods[-1]}", schema) if self.periods else self.spark.createDataFrame([], schema)

    def take(self, refs: DataFrame, parents: DataFrame) -> OrphanTracker:
        """Take in every period of the references after the last one seen."""
        last, scratch = self.periods[-1] if self.periods else None, self.scratch
        new = F.lit(True) if last is None else F.col("period") > last
        p = parents.select(*KEY, F.col("arrived_at").alias("p_from"), F.col("removed_at").alias("p_to")).filter("p_to IS NULL OR p_to > p_from")
        p = p.withColumn("period", period_of(F.col("p_from"), self.months)).filter(new)
        # rebalanced by period, a period is a few files of good size however many tasks read the input
        p = scratch.write(p.hint("rebalance", "period"), f"parents/take={len(self.periods)}", ("period",))
        staying = scratch.read("parents", f"{_INDEX}, take int, period bigint").filter("p_to IS NULL").select(*KEY, "p_from")
        size = staying.groupBy("ref_table").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= BROADCAST_ROWS)
        tiny = F.col("ref_table").isin([r[0] for r in size.collect()])
        refs = refs.select(*REF).withColumn("period", period_of(F.col("arrived_at"), self.months)).filter(new)
        span = Observation()
        every, limits = refs, [F.min("period").alias("lo"), F.max("period").alias("hi")]
        refs = refs.observe(span, *limits)
        for some in (F.broadcast(_renamed(staying.filter(tiny))), _renamed(staying.filter(~tiny))):
            refs = refs.join(some, [*_same(), F.col("p_from") <= F.col("arrived_at")], "left_anti")
        refs = scratch.write(refs.distinct().hint("rebalance", "period"), "refs", ("period",))
        try:
            lo, hi = span.get["lo"], span.get["hi"]
        except Py4JJavaError:  # a plan that turned out empty observes nothing
            lo, hi = every.agg(*limits).first()
        if lo is None:
            return self
        lo = lo if last is None else last + 1
        p = p.filter(F.col("period") <= hi).withColumn("period", F.greatest(F.col("period"), F.lit(lo)))
        ends = p.select("p_to").unionByName(self._kept("index", _INDEX).select("p_to")).select(period_of(F.col("p_to"), self.months).alias("period"))
        events = refs.select("period").unionByName(p.select("period")).unionByName(ends).filter(F.col("period").between(lo, hi))
        for period in sorted({lo, hi, *(r[0] for r in events.distinct().collect())}):
            self._step(period, refs.filter(F.col("period") == period).select(*REF), p.filter(F.col("period") == period).select(*KEY, "p_from", "p_to"))
        scratch.drop("refs")
        return self

    def _step(self, period: int, new: DataFrame, arrived: DataFrame) -> None:
        """One period: its references that aren't settled, and its parents."""
        scratch, end = self.scratch, period_start(F.lit(period + 1), self.months)
        index = self._kept("index", _INDEX).unionByName(arrived.filter("p_to IS NOT NULL"))
        state = self._kept("state", _STATE).filter("NOT settled").select(*OWNER, (F.col("n_before") + F.col("n_new")).alias("n_before"), F.col("open").alias("was_open"))
        at_arrival = (F.col("p_from") <= F.col("arrived_at")) & (F.col("p_to") > F.col("arrived_at"))
        found = scratch.write(new.join(_renamed(index), [*_same(), at_arrival], "left_anti"), f"found/period={period}")
        zero, no = F.lit(0).cast("bigint"), F.lit(False)
        counts = [
            state.select(*OWNER, "n_before", zero.alias("n_new"), zero.alias("n_found"), "was_open"),
            new.groupBy(*OWNER).agg(F.count(F.lit(1)).alias("n_new")).select(*OWNER, zero.alias("n_before"), "n_new", zero.alias("n_found"), no.alias("was_open")),
            found.groupBy(*OWNER).agg(F.count(F.lit(1)).alias("n_found")).select(*OWNER, zero.alias("n_before"), zero.alias("n_new"), "n_found", no.alias("was_open")),
        ]
        merged = _union(counts).groupBy(*OWNER).agg(*[F.sum(c).alias(c) for c in ("n_before", "n_new", "n_found")], F.bool_or("was_open").alias("was_open"))
        live = index.filter((F.col("p_from") < end) & (F.col("p_to") > end)).select(*KEY, no.alias("stays")).unionByName(arrived.filter("p_to IS NULL").select(*KEY, F.lit(True).alias("stays")))
        # of the arrivals only keys that something waits for are shuffled further
        live = live.join(merged.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.bool_or("stays").alias("stays"))
        merged = merged.join(live, KEY, "left").withColumns({"open": F.col("stays").isNull(), "settled": F.coalesce("stays", no)})
        merged = scratch.write(merged.select(*OWNER, "n_before", "n_new", "n_found", "was_open", "open", "settled"), f"state-{period}")
        back = F.when(~F.col("was_open"), F.col("n_before")).otherwise(0) + F.col("n_new") - F.col("n_found")
        opened = lambda c: F.sum(F.when(F.col("open"), c).otherwise(0))
        shot = merged.groupBy("src_table", "ref_field").agg(F.sum("n_found").alias("new_orphans"), opened(back).alias("reopened"), opened(F.col("n_before") + F.col("n_new")).alias("open_orphans"))
        scratch.write(shot.select(F.lit(period).cast("bigint").alias("period"), "*"), f"snapshots/at={period}")
        scratch.write(index.filter(F.col("p_to") > end), f"index-{period}")
        scratch.append(self.spark.range(1).select(F.lit(period).cast("bigint").alias("period")), "steps")
        if self.periods:
            scratch.drop(f"state-{self.periods[-1]}")
            scratch.drop(f"index-{self.periods[-1]}")
        self.periods.append(period)

    def all_found(self) -> DataFrame:
        """Every reference that named no record when it arrived."""
        if not self.periods:
            return self.spark.createDataFrame([], _REFS)
        return self.scratch.read([f"found/period={p}" for p in self.periods], _REFS)

    def all_snapshots(self) -> DataFrame:
        """(period_end, src_table, ref_field, new_orphans, reopened, open_orphans) of every period from the first one of
        the references to their last, where any of the counts isn't 0."""
        if not self.periods:
            shots = self.spark.createDataFrame([], _SNAPSHOT).withColumn("upto", F.lit(0))
        else:
            span = self.spark.createDataFrame(list(zip(self.periods, [*self.periods[1:], self.periods[-1] + 1], strict=True)), "period bigint, upto bigint")
            shots = self.scratch.read([f"snapshots/at={p}" for p in self.periods], _SNAPSHOT).join(F.broadcast(span), "period")
        every = shots.withColumn("at", F.explode(F.sequence(F.col("period"), F.col("upto") - 1)))
        own = lambda c: F.when(F.col("at") == F.col("period"), F.col(c)).otherwise(0).cast("bigint").alias(c)
        out = every.select(period_start(F.col("at") + 1, self.months).alias("period_end"), "src_table", "ref_field", own("new_orphans"), own("reopened"), "open_orphans")
        return out.filter("new_orphans > 0 OR open_orphans > 0")


def _renamed(intervals: DataFrame) -> DataFrame:
    return intervals.withColumnsRenamed({c: f"p_{c}" for c in KEY})


def _same() -> list[Column]:
    return [F.col(c) == F.col(f"p_{c}") for c in KEY]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def map_references(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """References and parents of the map tables."""
    roads, prefabs, waypoints = tables["roads"], tables["prefabs"], tables["waypoints"]
    members = prefabs.select("uid", "map_name", "arrived_at", F.explode("node_uids").alias("node"))
    refs = [
        reference(roads, "roads", uid(roads["uid"]), "start_node_uid", "nodes", uid(roads["start_node_uid"])),
        reference(roads, "roads", uid(roads["uid"]), "end_node_uid", "nodes", uid(roads["end_node_uid"])),
        reference(roads, "roads", uid(roads["uid"]), "road_look_token", "road_looks", token(roads["road_look_token"])),
        reference(members, "prefabs", uid(members["uid"]), "node_uids", "nodes", uid(members["node"])),
        reference(prefabs, "prefabs", uid(prefabs["uid"]), "token", "prefab_descriptions", token(prefabs["token"])),
        reference(waypoints, "waypoints", waypoints["waypoint_id"].cast("string"), "node_uid", "nodes", uid(waypoints["node_uid"])),
    ]
    parents = [
        parent(tables["nodes"], "nodes", uid(tables["nodes"]["uid"])),
        parent(tables["road_looks"], "road_looks", token(tables["road_looks"]["token"])),
        parent(tables["prefab_descriptions"], "prefab_descriptions", token(tables["prefab_descriptions"]["token"])),
    ]
    return _union(refs), _union(parents)


def track(spark: SparkSession, tables: dict[str, DataFrame], months: int = 3, state: str | None = None) -> OrphanTracker:
    """Run the tracker over all map tables in periods of so many months, or go on with a named state."""
    return OrphanTracker(spark, months, state).take(*map_references(tables))
