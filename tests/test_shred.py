import json

import pytest

from waymill.operators.shred import DECLARED, SCHEMAS, assemble, decoded, flat_tables, laid_out, level_columns, shred, typed_table


def paths(kind, payload):
    layout = laid_out([payload], SCHEMAS[kind])
    return sorted((p, c) for t, p, c, _ in assemble(shred(payload, layout), layout) if t in DECLARED)


def walked(kind, payload):
    """The rows by a plain walk over the payload."""
    out = []

    def items(v, path, parent):
        v = decoded(v)
        for i, x in enumerate([v] if isinstance(v, dict) else v if isinstance(v, list) else []):
            x = decoded(x)
            if isinstance(x, dict):
                out.append((parent, f"{path}[{i}]"))
                yield x, f"{path}[{i}]"

    if kind == "ferry":
        for k, f in (decoded(payload.get("ferryData")) or {}).items():
            if isinstance(f := decoded(f), dict):
                p = f"$.ferryData[{k}]"
                out.append(("$", p))
                for x, q in items(f.get("connections"), f"{p}.connections", p):
                    list(items(x.get("intermediatePoints"), f"{q}.intermediatePoints", q))
    elif kind == "lanes":
        for k, v in (decoded(payload.get("lanes")) or {}).items():
            for x, p in items(v, f"$.lanes[{k}]", "$"):
                for b, q in items(x.get("branches"), f"{p}.branches", p):
                    for n in ("semaphoresEncountered", "trafficRulesEncountered"):
                        list(items(b.get(n), f"{q}.{n}", q))
    else:
        for s, p in items(payload.get("segments"), "$.segments", "$"):
            for t, q in items(s.get("steps"), f"{p}.steps", p):
                m = decoded(t.get("maneuver"))
                if isinstance(m, dict):
                    out.append((q, f"{q}.maneuver"))
                    h = decoded(m.get("laneHint"))
                    if isinstance(h, dict):
                        list(items(h.get("lanes"), f"{q}.maneuver.laneHint.lanes", f"{q}.maneuver"))
                list(items(t.get("trafficIcons"), f"{q}.trafficIcons", q))
    return sorted(out)


CASES = [
    ("ferry", {"ferryData": {"f.x": {"connections": [{"intermediatePoints": [{"x": 1}, None, {"x": 2}]}, None, {"a": 1}]}, "f.y": None}}),
    ("ferry", {"ferryData": '{"f.x": {"connections": {"intermediatePoints": {"x": 1}}}}'}),
    ("ferry", {"ferryData": None}),
    ("ferry", {}),
    ("lanes", {"lanes": {"1": [{"branches": [None, {"semaphoresEncountered": {"i": 1}, "trafficRulesEncountered": []}]}, None, {"branches": None}], "2": {"branches": "[{}]"}, "3": None, "4": []}}),
    ("route", {"segments": [{"steps": [{}, None, {"maneuver": {"laneHint": {"lanes": [{}, None, {}]}}, "trafficIcons": {"t": 1}}]}, {"steps": {"maneuver": '{"laneHint": "{\\"lanes\\": [{}]}"}'}}]}),
    ("route", {"segments": "cut off [{"}),
]


@pytest.mark.parametrize(("kind", "payload"), CASES)
def test_levels_rebuild_what_a_walk_finds(kind, payload):
    assert paths(kind, payload) == walked(kind, payload)


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/nested_records.parquet")
    want = set()
    for r in df.collect():
        try:
            want |= {(r.record_id, *x) for x in walked(r.record_kind, json.loads(r.payload))}
        except ValueError:
            pass
    got = {(r.record_id, r.parent_path, r.child_path) for r in flat_tables(df).collect() if r.table_name in DECLARED}
    assert got == want
    levels = level_columns(df).toPandas()
    assert (levels["rep"] <= levels["def"]).all()
    assert (levels[levels["seq"] == 0]["rep"] == 0).all()


def leaf_walk(v, path="$", parent="$", out=None, leaves=None):
    """Rows (path -> leaves) of a payload without declared groups, by a plain walk."""
    out = {} if out is None else out
    leaves = {} if leaves is None else leaves
    for k, x in v.items():
        if isinstance(x, list) and any(isinstance(e, dict) for e in x):
            for i, e in enumerate(x):
                if isinstance(e, dict):
                    out[f"{path}.{k}[{i}]"] = own = {}
                    leaf_walk(e, f"{path}.{k}[{i}]", parent, out, own)
        elif isinstance(x, dict) and x:
            inner = {}
            leaf_walk(x, f"{path}.{k}", parent, out, inner)
            leaves.update({f"{k}.{a}": b for a, b in inner.items()})
        elif x is not None and x != []:
            leaves[k] = x
    return out


def test_every_leaf_comes_back():
    """A payload of an unknown kind: inferred tables hold every leaf of their objects."""
    payload = {
        "id": 7,
        "stops": [{"n": 1, "at": {"x": 1.5, "deep": {"y": [1, 2]}}, "tags": ["a"], "calls": [{"t": 1}, None, {"t": None, "u": "v"}]}, None, {"n": "2", "calls": []}, {}],
        "meta": {"src": "f", "parts": [{"k": True}]},
    }
    layout = laid_out([payload])
    columns = shred(payload, layout)
    got = {c: leaves for _, _, c, leaves in assemble(columns, layout)}
    assert got == leaf_walk(payload)
    assert columns["$.stops.at.x"] == [(0, 4, None, 1.5), (1, 1, None, None), (1, 2, None, None), (1, 2, None, None)]
    assert [(r, d) for r, d, _, _ in columns["$.stops.calls.t"]] == [(0, 5), (2, 3), (2, 4), (1, 1), (1, 2), (1, 2)]
    parents = {c: p for _, p, c, _ in assemble(columns, layout)}
    assert parents["$.stops[0].calls[2]"] == "$.stops[0]"


def test_typed_table(spark):
    payload = {"ferryData": {"f.x": {"connections": [{"token": "a", "price": "1.5", "time": 3, "pier": {"no": 4}}, {"token": 5, "price": "x", "time": 3.5}]}}}
    df = spark.createDataFrame([(1, "ferry", json.dumps(payload))], "record_id bigint, record_kind string, payload string")
    columns = {"token": ("token", "string"), "price": ("price", "double"), "time": ("time", "bigint"), "pier_no": ("pier.no", "bigint")}
    got = sorted(tuple(r)[2:] for r in typed_table(df, "$.ferryData.connections", columns).collect())
    assert got == [("$.ferryData[f.x].connections[0]", "a", 1.5, 3, 4), ("$.ferryData[f.x].connections[1]", None, None, None, None)]


def test_odd_payloads(spark):
    rows = [(1, "ferry", None), (2, "ferry", '{"ferryData": {'), (3, "other", "{}"), (4, None, '{"a": [{"b": 1}]}'), (None, "ferry", '{"ferryData": {"a": {}}}'), (5, "ferry", "[1]"), (6, "ferry", '{"ferryData": {"a": {}}}')]
    got = flat_tables(spark.createDataFrame(rows, "record_id bigint, record_kind string, payload string")).collect()
    assert sorted((r.record_id, r.child_path) for r in got) == [(4, "$.a[0]"), (6, "$.ferryData[a]")]
