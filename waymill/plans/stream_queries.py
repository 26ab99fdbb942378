"""Stream replays over the events; each gives what its batch twin gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.plans.registry import Registry, Tables
from waymill.plans.sequence_queries import ORACLES as BATCH
from waymill.streaming import keyed, replay

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col


def events(t: Tables) -> DataFrame:
    return keyed.as_events(t("events"), "user_id", "event_id", "ts", "event_type", "value")


def _replayed(t: Tables, processor: keyed.Keyed) -> DataFrame:
    return replay.keyed_replay(t.spark, events(t), processor).select(c("key").alias("user_id"), c("seq").alias("event_id"), "kind", "at")


@R.query(f"SELECT user_id, event_id FROM ({BATCH['change_detect']})")
def stream_change(t: Tables) -> DataFrame:
    """Change detection on a stream."""
    return _replayed(t, keyed.Changes()).select("user_id", "event_id")


@R.query(BATCH["throttle_leading"])
def stream_throttle(t: Tables) -> DataFrame:
    """Leading-edge throttle on a stream."""
    return _replayed(t, keyed.Throttle(7200)).select("user_id", "event_id")


@R.query(BATCH["rate_fixed_window"])
def stream_rate(t: Tables) -> DataFrame:
    """Rate limit on a stream."""
    return _replayed(t, keyed.RateLimit(86_400, 3)).select("user_id", "event_id", (c("kind") == "allowed").alias("allowed"))


@R.query(f"SELECT user_id, CAST(coalesce(n, 0) + 1 AS BIGINT) AS n FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, count(*) AS n FROM ({BATCH['stale_gaps']}) GROUP BY 1) USING (user_id)")
def stream_stale(t: Tables) -> DataFrame:
    """Stale spells on a stream, by user; the last one, which no event ends, is told by its timer."""
    return _replayed(t, keyed.Stale(3600)).filter("kind = 'stale'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_PLANS = "['view', 'click', 'purchase'], ['signup', 'view', 'error', 'purchase'], ['click', 'click', 'view']"


@R.query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, [{_PLANS}][1 + user_id % 3] AS plan FROM events),
      r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS done, false AS off, 'planned' AS kind, plan FROM e
      UNION ALL SELECT user_id, k, done + pos, CASE WHEN pos > 0 THEN false ELSE off OR (done > 0 AND done < len(plan)) END, CASE WHEN done >= len(plan) THEN 'none' WHEN pos > 0 THEN CASE WHEN done + pos = len(plan) THEN 'arrived' ELSE 'progress' END WHEN done > 0 AND NOT off THEN 'veered' ELSE 'none' END, plan
      FROM (SELECT r.user_id, e.k, r.done, r.off, r.plan, CAST(CASE WHEN r.done >= len(r.plan) THEN 0 ELSE coalesce(list_position(r.plan[r.done + 1 : r.done + 2], e.v), 0) END AS BIGINT) AS pos FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
      SELECT user_id, kind, count(*) AS n FROM r WHERE kind <> 'none' GROUP BY 1, 2"""
)
def stream_follow(t: Tables) -> DataFrame:
    """Followers of a plan of each user's own: progress, veers and arrivals."""
    own = events(t)
    plan = F.element_at(F.array(*[F.lit("plan:" + ",".join(p)) for p in (("view", "click", "purchase"), ("signup", "view", "error", "purchase"), ("click", "click", "view"))]), (c("key") % 3 + 1).cast("int"))
    first = own.groupBy("key").agg(F.min("ts").alias("ts")).select("key", F.lit(-1).cast("bigint").alias("seq"), (c("ts") - F.expr("INTERVAL 1 SECOND")).alias("ts"), plan.alias("value"), F.lit(None).cast("double").alias("number"))
    out = replay.keyed_replay(t.spark, own.unionByName(first), keyed.Follow(2))
    return out.groupBy(c("key").alias("user_id"), "kind").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT user_id, 'set' AS kind, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1 UNION ALL SELECT user_id, 'updated', count(*) - 1 FROM events GROUP BY 1 HAVING count(*) > 1")
def stream_ttl(t: Tables) -> DataFrame:
    """A store with a day to live: values set anew and updated while they live."""
    return _replayed(t, keyed.Expiring(86_400)).groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0 AS n, 0::BIGINT AS event_id, 'none' AS kind FROM e UNION ALL SELECT r.user_id, e.k, CASE WHEN v = 'view' AND n < 2 THEN n + 1 WHEN v = 'click' AND n > 0 THEN n - 1 ELSE n END, e.event_id,
      CASE WHEN v = 'view' THEN CASE WHEN n < 2 THEN 'opened' ELSE 'refused' END WHEN v = 'click' AND n > 0 THEN 'closed' ELSE 'none' END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
      SELECT user_id, event_id, kind FROM r WHERE kind <> 'none'"""
)
def stream_concurrent(t: Tables) -> DataFrame:
    """At most two open views a user; a click closes one."""
    return _replayed(t, keyed.Concurrent("view", "click", 2)).select("user_id", "event_id", "kind")


@R.query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_latest(t: Tables) -> DataFrame:
    """The newest event of each key after coalescing fan-out in micro-batches."""
    out = replay.latest_values(t.spark, events(t))
    return out.groupBy(c("key").alias("user_id")).agg(F.max_by("seq", F.struct("batch", "seq")).alias("event_id"))


@R.query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    """Counts in windows of six hours of event time behind a watermark."""
    out = replay.windowed_counts(t.spark, events(t), "6 hours", "1 hour")
    return out.select(F.unix_micros("start").alias("start"), "value", "n")
