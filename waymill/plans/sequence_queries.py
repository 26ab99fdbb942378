"""Queries of ordered operations over the events and other whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymill.operators import sequence as seq
from waymill.plans.registry import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col
KEY, ORDER = ["user_id"], ["ts", "event_id"]
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_S = "epoch_us(ts) / 1e6"


def events(t: Tables) -> DataFrame:
    return t("events").select("event_id", "user_id", "ts", (F.unix_micros(c("ts").cast("timestamp")) / 1e6).alias("s"), "event_type", "value")


@R.query(f"SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p FROM events {_W}) WHERE p IS DISTINCT FROM event_type")
def change_detect(t: Tables) -> DataFrame:
    """Events of another kind than the one before."""
    return seq.changes(events(t), KEY, ORDER, "event_type").select("user_id", "event_id", "event_type")


@R.query(
    f"SELECT user_id, run, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS cut FROM events {_W})) GROUP BY 1, 2, 3"
)
def merged_runs(t: Tables) -> DataFrame:
    """Neighbouring events of one kind merged into one step."""
    return seq.runs(events(t), KEY, ORDER, "event_type").groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@R.query(f"SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER w AS n FROM events {_W}) WHERE n IS NULL OR (epoch_us(n) - epoch_us(ts)) / 1e6 > 3600")
def debounce(t: Tables) -> DataFrame:
    """Events after which an hour was quiet."""
    return seq.debounce(events(t), KEY, "ts", "event_id", 3600).select("user_id", "event_id")


@R.query(f"SELECT user_id, event_id, round((epoch_us(n) - epoch_us(ts)) / 1e6, 3) AS quiet, round((epoch_us(n) - epoch_us(ts)) / 1e6 - 3600, 3) AS late FROM (SELECT *, lead(ts) OVER w AS n FROM events {_W}) WHERE (epoch_us(n) - epoch_us(ts)) / 1e6 > 3600")
def stale_gaps(t: Tables) -> DataFrame:
    """Silences of more than an hour, with their length and how long they stayed noticed."""
    quiet = seq.seconds_between(c("ts"), c("next_ts"))
    return seq.gaps(events(t), KEY, "ts", "event_id", 3600).select("user_id", "event_id", F.round(quiet, 3).alias("quiet"), F.round(quiet - 3600, 3).alias("late"))


_FOLD = f"""o AS (SELECT user_id, event_id, {_S} AS s, value, row_number() OVER w AS k FROM events {_W})"""


@R.query(
    f"""WITH RECURSIVE {_FOLD}, r AS (SELECT user_id, event_id, s, k, s AS last, true AS pass FROM o WHERE k = 1 UNION ALL
      SELECT o.user_id, o.event_id, o.s, o.k, CASE WHEN o.s - r.last >= 7200 THEN o.s ELSE r.last END, o.s - r.last >= 7200 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id, event_id FROM r WHERE pass"""
)
def throttle_leading(t: Tables) -> DataFrame:
    """At most one event in two hours passes, the first at once."""
    return seq.throttled(events(t), 7200)


@R.query(
    f"""WITH RECURSIVE {_FOLD}, r AS (SELECT user_id, event_id, k, s AS began, 1 AS n FROM o WHERE k = 1 UNION ALL
      SELECT o.user_id, o.event_id, o.k, CASE WHEN o.s - r.began < 86400 THEN r.began ELSE o.s END, CASE WHEN o.s - r.began < 86400 THEN r.n + 1 ELSE 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id, event_id, n <= 3 AS allowed FROM r"""
)
def rate_fixed_window(t: Tables) -> DataFrame:
    """Three events a day are allowed, the day beginning with its first event."""
    return seq.rate_limited(events(t), 86_400, 3)


@R.query(
    f"""WITH RECURSIVE {_FOLD}, r AS (SELECT user_id, event_id, k, value AS mean FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, 0.2 * o.value + 0.8 * r.mean FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
      SELECT user_id, event_id, round(mean, 4) AS mean FROM r"""
)
def ema_user(t: Tables) -> DataFrame:
    """Exponential moving average of the values of each user."""
    return seq.smoothed(events(t), 0.2).select("user_id", "event_id", F.round("mean", 4).alias("mean"))


@R.query(
    "SELECT o_orderkey, e.event_id AS last_event_id FROM (SELECT *, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43000) AS at FROM orders) o ASOF LEFT JOIN events e ON e.user_id = o.user_id AND e.ts <= o.at"
)
def asof_lookup(t: Tables) -> DataFrame:
    """The last event of a user at or before an order."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(o_orderkey % 43000 as int), 0)")
    o = t("orders").select("o_orderkey", (c("o_custkey") % 150).alias("user_id"), at.alias("ts"))
    return seq.latest_before(o, t("events").select("user_id", "ts", "event_id"), KEY, "ts", "event_id").select("o_orderkey", "last_event_id")


@R.query(
    f"""WITH o AS (SELECT user_id, {_S} AS s, value AS v, lead({_S}) OVER (PARTITION BY user_id ORDER BY ts) AS s2, lead(value) OVER (PARTITION BY user_id ORDER BY ts) AS v2 FROM events),
      k AS (SELECT *, unnest(range(CAST(ceil(s / 43200) AS BIGINT), CAST(ceil(s2 / 43200) AS BIGINT))) AS k FROM o WHERE s2 > s) SELECT user_id, CAST(k * 43200 AS BIGINT) AS at, round(v + (v2 - v) * (k * 43200 - s) / (s2 - s), 4) AS value FROM k"""
)
def interpolate_grid(t: Tables) -> DataFrame:
    """Values at every half day, linear between events."""
    return seq.interpolated(t("events"), KEY, "ts", "value", 43_200).select("user_id", "at", F.round("value", 4).alias("value"))


@R.query(
    f"""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 6) AS hour, round(avg(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 6) AS day FROM events"""
)
def rolling_means(t: Tables) -> DataFrame:
    """Means over the last hour and the last day."""
    return t("events").select("user_id", "event_id", F.round(seq.rolling_mean(c("value"), KEY, "ts", 3600), 6).alias("hour"), F.round(seq.rolling_mean(c("value"), KEY, "ts", 86_400), 6).alias("day"))


@R.query(
    f"""SELECT user_id, CAST((k - 1) // 20 AS BIGINT) AS part, round(avg(d), 3) AS mean, count(d) AS n FROM (SELECT user_id, row_number() OVER w AS k, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS d FROM events {_W}) GROUP BY 1, 2"""
)
def mean_every_n(t: Tables) -> DataFrame:
    """Mean gap of every twenty events of a user."""
    w = seq.over(KEY, ORDER)
    e = events(t).withColumns({"k": F.row_number().over(w), "d": seq.seconds_between(F.lag("ts").over(w), c("ts"))})
    return e.groupBy("user_id", F.floor((c("k") - 1) / 20).alias("part")).agg(F.round(F.avg("d"), 3).alias("mean"), F.count("d").alias("n"))


@R.query(f"SELECT user_id, event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000.0 - 500, 3) AS latency FROM events {_W}")
def latency_gap(t: Tables) -> DataFrame:
    """Gap to the event before in milliseconds, less the nominal half second."""
    gap = seq.seconds_between(F.lag("ts").over(seq.over(KEY, ORDER)), c("ts"))
    return events(t).select("user_id", "event_id", F.round(gap * 1000 - 500, 3).alias("latency"))


@R.query(
    "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k, max(ts) OVER () AS now FROM events) WHERE k = 1 AND now - ts <= INTERVAL 2 DAY"
)
def ttl_last_value(t: Tables) -> DataFrame:
    """Last value of each key that hasn't expired at the last event's time."""
    now = t("events").agg(F.max("ts").alias("now"))
    last = t("events").groupBy("event_type", "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))
    fresh = c("now") - c("ts") <= F.expr("INTERVAL '2' DAY")
    if dict(last.dtypes)["ts"] == "timestamp":  # Spark subtracts times with zone on the clock of the session's zone
        fresh = seq.seconds_between(c("ts"), c("now")) <= 2 * 86_400
    return last.crossJoin(F.broadcast(now)).filter(fresh).select("event_type", "user_id", "event_id")  # now is one row


@R.query(
    f"""SELECT user_id, event_id, p AS prev, event_type AS next FROM (SELECT *, lag(event_type) OVER w AS p FROM events {_W}) WHERE p IS NOT NULL AND p || '>' || event_type NOT IN ('view>click', 'click>purchase', 'view>view', 'click>view', 'signup>view', 'view>signup')"""
)
def invalid_transitions(t: Tables) -> DataFrame:
    """Steps between kinds of events that aren't on the list."""
    pairs = [("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("signup", "view"), ("view", "signup")]
    allowed = t.spark.createDataFrame(pairs, "prev string, next string")
    return seq.bad_transitions(events(t), KEY, ORDER, "event_type", allowed).select("user_id", "event_id", "prev", "next")


@R.query(f"SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE ts < m")
def regressing_times(t: Tables) -> DataFrame:
    """Events that arrive with a time before one that arrived earlier."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    return t("events").withColumn("m", F.max("ts").over(w)).filter("ts < m").select("event_id", "user_id")


@R.query(
    "SELECT user_id, CAST(max(open) AS BIGINT) AS most FROM (SELECT user_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS open FROM events) GROUP BY 1"
)
def concurrent_open(t: Tables) -> DataFrame:
    """Most subscriptions open at once, counted up by one kind of event and down by another."""
    step = F.when(c("event_type") == "signup", 1).when(c("event_type") == "purchase", -1).otherwise(0)
    run = F.sum(step).over(seq.over(KEY, ORDER).rowsBetween(W.unboundedPreceding, 0))
    return t("events").select("user_id", run.alias("open")).groupBy("user_id").agg(F.max("open").alias("most"))


@R.query(
    """SELECT region_id, i, round(run, 3) AS run, round(CASE WHEN total = 0 THEN 0 ELSE run / total END, 6) AS progress FROM (SELECT region_id, i, sum(coalesce(d, 0)) OVER (PARTITION BY region_id ORDER BY i) AS run, sum(coalesce(d, 0)) OVER (PARTITION BY region_id) AS total
      FROM (SELECT region_id, i, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM (SELECT region_id, CAST(generate_subscripts(ring, 1) - 1 AS INT) AS i, unnest(ring).x AS x, unnest(ring).y AS y FROM map_regions) WINDOW w AS (PARTITION BY region_id ORDER BY i)))"""
)
def line_progress(t: Tables) -> DataFrame:
    """Length run along every ring and the share of it."""
    v = t("map_regions").select("region_id", F.posexplode("ring").alias("i", "p")).select("region_id", "i", "p.x", "p.y")
    w = W.partitionBy("region_id").orderBy("i")
    d = F.coalesce(F.sqrt(F.pow(c("x") - F.lag("x").over(w), F.lit(2)) + F.pow(c("y") - F.lag("y").over(w), F.lit(2))), F.lit(0.0))
    own = v.withColumn("d", d).withColumns({"run": F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("d").over(W.partitionBy("region_id"))})
    return own.select("region_id", "i", F.round("run", 3).alias("run"), F.round(F.when(c("total") == 0, 0.0).otherwise(c("run") / c("total")), 6).alias("progress"))


@R.query(
    """SELECT region_id, i, CAST((i - e + n) % n AS INT) AS exit_number FROM (SELECT region_id, CAST(generate_subscripts(ring, 1) - 1 AS INT) AS i, len(ring) AS n, region_id % len(ring) AS e FROM map_regions) WHERE i <> e"""
)
def cyclic_exits(t: Tables) -> DataFrame:
    """Exits of a ring numbered from the entrance on."""
    own = t("map_regions").select("region_id", F.size("ring").alias("n"), F.posexplode("ring").alias("i", "p")).withColumn("e", c("region_id") % c("n"))
    return own.filter("i <> e").select("region_id", "i", F.pmod(c("i") - c("e"), c("n")).cast("int").alias("exit_number"))
