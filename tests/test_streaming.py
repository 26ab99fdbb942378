"""Operators on streams that need a clock: expiry and silences."""

import time
from datetime import datetime, timedelta

from waymill.session import Scratch
from waymill.streaming import keyed, replay

T0 = datetime(2025, 1, 1)


def written(spark, path, rows):
    data = [(k, s, T0 + timedelta(seconds=t), v, 0.0) for k, s, t, v in rows]
    spark.createDataFrame(data, keyed.EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_values_expire(spark):
    scratch = Scratch(spark, "expire")
    path = f"{scratch.root}/in"
    kinds = []
    for rows, pause in (([(1, 0, 0, "a"), (1, 1, 1, "b"), (2, 2, 0, "c")], 0), ([(1, 3, 5, "d")], 7), ([(1, 4, 6, "e")], 0)):
        time.sleep(pause)
        written(spark, path, rows)
        with keyed.stateful(spark):
            out = replay.run(keyed.apply(replay.files(spark, path, spark.read.parquet(path).schema), keyed.Expiring(5)), scratch, once=True)
        kinds.append({(r.seq, r.kind) for r in out.collect()})
    assert kinds[0] == {(0, "set"), (1, "updated"), (2, "set")}
    assert (3, "set") in kinds[1]  # the first value had expired by then
    assert len(kinds[2]) == 5


def test_a_key_that_stays_silent_is_told(spark):
    rows = [(1, 0, 0, "a"), (1, 1, 5, "b"), (2, 2, 1, "c"), (1, 3, 100, "d"), (3, 4, 2, "e"), (3, 5, 2, "f")]
    events = spark.createDataFrame([(k, s, T0 + timedelta(seconds=t), v, 0.0) for k, s, t, v in rows], keyed.EVENTS)
    out = replay.keyed_replay(spark, events, keyed.Stale(10), 3).collect()
    at = lambda s: (T0 + timedelta(seconds=s)).timestamp()
    told = sorted((r.key, r.kind, r.at) for r in out if r.kind in ("stale", "resumed"))
    base = min(r.at for r in out if r.kind == "first" and r.key == 1) - at(0)
    assert told == sorted((k, kind, at(s) + base) for k, kind, s in ((1, "stale", 15), (1, "resumed", 100), (1, "stale", 110), (2, "stale", 11), (3, "stale", 12)))


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(keyed.STORE, None)
    with keyed.stateful(spark):
        assert spark.conf.get(keyed.STORE) == keyed.ROCKS
    assert spark.conf.get(keyed.STORE, None) == before
