import random
import uuid
from datetime import datetime, timedelta

import duckdb

from tests.compare import difference
from waymill.operators import orphans
from waymill.operators.orphans import OrphanTracker

D = lambda m, d=1: datetime(2025, m, d)
REFS = "src_table string, src_key string, ref_field string, ref_table string, map_name string, ref_key string, arrived_at timestamp_ntz"
PARENTS = "ref_table string, map_name string, ref_key string, arrived_at timestamp_ntz, removed_at timestamp_ntz"


def ref(key, at, src="s"):
    return ("roads", f"{src}{key}", "f", "nodes", "usa", key, at)


def tracked(spark, refs, parents, months, state=None):
    return OrphanTracker(spark, months, state).take(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))


def test_resolved_and_reopened(spark):
    parents = [("nodes", "usa", "a", D(3, 5), D(5, 5)), ("nodes", "usa", "b", D(1), None), ("nodes", "usa", "c", D(1), D(2)), ("nodes", "usa", "c", D(6), None), ("nodes", "europe", "d", D(1), None)]
    refs = [ref("a", D(2, 3)), ref("a", D(4), "t"), ref("b", D(2, 3)), ref("b", D(2, 3)), ref("c", D(1, 20)), ref("d", D(4, 2)), ref("a", D(5, 5), "u"), ref("b", D(6, 20))]
    t = tracked(spark, refs, parents, 1)
    assert {r.src_key for r in t.all_found().collect()} == {"sa", "sd", "ua"}
    got = {r.period_end.month: (r.new_orphans, r.reopened, r.open_orphans) for r in t.all_snapshots().collect()}
    # c is removed when February begins, so its reference is open then; a comes in March; d never exists in that map
    assert got == {2: (0, 1, 1), 3: (1, 0, 2), 4: (0, 0, 1), 5: (1, 0, 2), 6: (1, 2, 5), 7: (0, 0, 4)}


def rows(r, n_refs, n_keys, days):
    at = lambda: datetime(2021, 1, 1) + timedelta(days=r.randrange(days), seconds=r.randrange(86400))
    parents = []
    for k in range(n_keys):
        for _ in range(r.choice([0, 1, 1, 2])):
            a = at()
            parents.append(("nodes" if k % 3 else "looks", r.choice(["usa", "\u0000"]), str(k), a, r.choice([None, a + timedelta(days=r.randrange(-3, 400))])))
    refs = [(r.choice(["roads", "prefabs"]), f"k{i}", r.choice("fg"), "nodes" if (k := r.randrange(n_keys)) % 3 else "looks", r.choice(["usa", "\u0000"]), str(k), at()) for i in range(n_refs)]
    return refs + refs[:9], parents


SQL = """
WITH r AS (SELECT DISTINCT * FROM refs),
lim AS (SELECT date_trunc('month', min(arrived_at))::TIMESTAMP AS lo, max(arrived_at) AS hi FROM r),
q AS (SELECT lo + to_months(CAST(i AS INTEGER)) AS b, lo + to_months(CAST(i + 1 AS INTEGER)) AS e FROM (SELECT lo, unnest(range(0, date_diff('month', lo, hi) + 1)) AS i FROM lim)),
x AS (SELECT q.b, q.e, r.*,
  r.arrived_at >= q.b AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.ref_table = r.ref_table AND p.map_name = r.map_name AND p.ref_key = r.ref_key AND p.arrived_at <= r.arrived_at AND (p.removed_at IS NULL OR p.removed_at > r.arrived_at)) AS found,
  NOT EXISTS (SELECT 1 FROM parents p WHERE p.ref_table = r.ref_table AND p.map_name = r.map_name AND p.ref_key = r.ref_key AND p.arrived_at < q.e AND (p.removed_at IS NULL OR p.removed_at > q.e)) AS open,
  r.arrived_at < q.b AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.ref_table = r.ref_table AND p.map_name = r.map_name AND p.ref_key = r.ref_key AND p.arrived_at < q.b AND (p.removed_at IS NULL OR p.removed_at > q.b)) AS was
  FROM q JOIN r ON r.arrived_at < q.e)
SELECT e AS period_end, src_table, ref_field, count(*) FILTER (found) AS new_orphans, count(*) FILTER (open AND NOT found AND NOT was) AS reopened, count(*) FILTER (open) AS open_orphans
FROM x GROUP BY ALL HAVING count(*) FILTER (found) > 0 OR count(*) FILTER (open) > 0"""


def compared(spark, refs, parents, t):
    con = duckdb.connect()
    for name, data, schema in (("refs", refs, REFS), ("parents", parents, PARENTS)):
        con.register(name, spark.createDataFrame(data, schema).toArrow())
    assert difference(t.all_snapshots(), con, SQL) == ""


def test_snapshots_like_sql_with_gaps_and_a_resumed_state(spark, monkeypatch):
    r = random.Random(4)
    refs, parents = rows(r, 250, 30, 300)
    refs += [(*x[:6], datetime(2024, 3, 1)) for x in refs[:3]]  # two years later, after many empty periods
    monkeypatch.setattr(orphans, "BROADCAST_ROWS", 12)  # one table is broadcast, the other isn't
    name = uuid.uuid4().hex
    early = [x for x in refs if x[6] < datetime(2021, 6, 1)]
    first = tracked(spark, early, parents, 1, name)
    n = len(first.periods)
    again = tracked(spark, refs, parents, 1, name)  # opened anew, takes in only what came since
    assert len(again.periods) > n
    assert again.periods[:n] == first.periods
    assert len(again.periods) < 30  # of 39
    compared(spark, refs, parents, again)
    whole = tracked(spark, refs, parents, 12)
    key = lambda t: sorted((x.src_table, x.src_key, x.ref_field) for x in t.all_found().collect())
    assert key(whole) == key(again)


def test_what_a_step_reads_doesnt_grow_with_the_batches(spark):
    """Forty periods over the same keys: the state and the index keep their number of rows."""
    months = [datetime(2021 + m // 12, m % 12 + 1, 3) for m in range(40)]
    parents = [("nodes", "usa", str(k), t, t + timedelta(days=20)) for t in months for k in range(10)]
    refs = [ref(str(k), t + timedelta(days=1), f"{t:%y%m}-") for t in months for k in range(20)]
    seen = []

    class Watched(OrphanTracker):
        def _step(self, *a):
            super()._step(*a)
            seen.append((self._kept("state", orphans._STATE).count(), self._kept("index", orphans._INDEX).count()))

    Watched(spark, 4).take(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert max(s for s, _ in seen) <= 20
    assert max(i for _, i in seen) <= 10


def test_nothing(spark):
    t = tracked(spark, [], [], 3)
    assert t.all_found().count() == t.all_snapshots().count() == 0
