"""Deeply nested records shredded into level columns, and flat tables put together again from the levels.

Each record is parsed, brought to one layout (a lone object counts as element 0 of its list, JSON text in a string
as what it spells) and shredded as columnar formats do: every group of objects and every leaf path below it gives a
column of (repetition level, definition level, value). The flat table of a repeated object is rebuilt from these
columns alone: repetition levels restart the ordinals of its ancestors, the definition level tells a null element, an
empty list and a missing ancestor from an object that is there, and a missing leaf from one that has a value.

The layouts of known kinds are declared as far as they need it (maps look like objects, single objects have rows of
their own); everything else is inferred from the record: lists of objects are further tables, objects that aren't
listed give leaves `name.leaf` of the row around them. A record of an unknown kind is laid out by inference alone.

A record is one row, so both halves run in one Arrow-batched pass over the scan without any shuffle; skew between
kinds or keys doesn't matter. Payloads that are null or cut off yield nothing; null elements yield no row but keep
their position; extra columns of the input are left out; a null kind is an unknown one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

from waymill.functions.values import cast_exactly

LIST, MAP, ONE, STRUCT = "list", "map", "one", "struct"


@dataclass(frozen=True)
class Group:
    """A nested object of a schema. kind: list (repeated), map (repeated, keyed), one (single, has rows),
    struct (single, without rows of its own). A map whose items are lists holds a list group named ''."""

    name: str
    kind: str
    children: tuple[Group, ...] = field(default=())


#: Layouts of the nested records, by kind.
SCHEMAS = {
    "ferry": (Group("ferryData", MAP, (Group("connections", LIST, (Group("intermediatePoints", LIST),)),)),),
    "lanes": (Group("lanes", MAP, (Group("", LIST, (Group("branches", LIST, (Group("semaphoresEncountered", LIST), Group("trafficRulesEncountered", LIST))),)),)),),
    "route": (Group("segments", LIST, (Group("steps", LIST, (Group("maneuver", ONE, (Group("laneHint", STRUCT, (Group("lanes", LIST),)),)), Group("trafficIcons", LIST))),)),),
}


def decoded(v):
    """JSON text in a string counts as what it spells; other strings stay."""
    while isinstance(v, str):
        if v.lstrip()[:1] not in ("{", "[", '"') and v.strip() != "null":
            return v
        try:
            v = json.loads(v)
        except ValueError:
            return v
    return v


def _elements(v) -> list:
    """What a list group holds for a value: a lone object counts as element 0."""
    v = decoded(v)
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


def laid_out(objects: list[dict], declared: tuple[Group, ...] = ()) -> tuple[Group, ...]:
    """The groups below objects of one place: declared ones with what is inferred below them, and inferred ones."""
    out = []
    for g in declared:
        below = [decoded(o.get(g.name)) for o in objects]
        if g.kind == MAP:
            below = [x for v in below for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
            if g.children and g.children[0].name == "":
                lists = [x for v in below for x in _elements(v)]
                inner = g.children[0]
                out.append(replace(g, children=(replace(inner, children=laid_out(_objects(lists), inner.children)),)))
                continue
        elif g.kind == LIST:
            below = [x for v in below for x in _elements(v)]
        else:
            below = [v[0] if isinstance(v, list) and len(v) == 1 else v for v in below]
        out.append(replace(g, children=laid_out(_objects(below), g.children)))
    names = {g.name for g in declared}
    rest: dict[str, list] = {}
    for o in objects:
        for k, v in o.items():
            if k not in names and isinstance(v, (dict, list)) and v:
                rest.setdefault(k, []).append(v)
    for k, values in rest.items():
        listed = any(isinstance(x, dict) for v in values if isinstance(v, list) for x in v)
        if listed:
            out.append(Group(k, LIST, laid_out(_objects([x for v in values for x in _elements(v)]))))
        elif all(isinstance(v, dict) for v in values) and all(o.get(k) is None or isinstance(o.get(k), (dict, list)) for o in objects):
            out.append(Group(k, STRUCT, laid_out(values)))
    return tuple(out)


def _objects(values) -> list[dict]:
    return [x for x in map(decoded, values) if isinstance(x, dict)]


def shred(payload: dict, schema: tuple[Group, ...]) -> dict[str, list[tuple[int, int, str | None, object]]]:
    """Columns by path: (repetition level, definition level, map key, value). A group's column tells where its objects
    are; a leaf's column has one entry for each of the group's, one definition level higher where there is a value.

    A list or map adds two definition levels, one for an element being there and one for its being an object;
    single groups add one.
    """
    out: dict[str, list] = {}
    held: dict[str, list] = {}  # by group: its objects, beside its column

    def absent(g: Group, path: str, r: int, d: int) -> None:
        path = f"{path}.{g.name}"
        out.setdefault(path, []).append((r, d, None, None))
        held.setdefault(path, []).append(None)
        for c in g.children:
            absent(c, path, r, d)

    def put(g: Group, path: str, v, r: int, d: int, depth: int, keyed=None) -> None:
        v, path = decoded(v), f"{path}.{g.name}"
        if g.kind in (ONE, STRUCT):
            if isinstance(v, list) and len(v) == 1:
                v = decoded(v[0])
            there = isinstance(v, dict)
            out.setdefault(path, []).append((r, d + there, None, None))
            held.setdefault(path, []).append(v if there else None)
            for c in g.children:
                put(c, path, v.get(c.name), r, d + 1, depth) if there else absent(c, path, r, d)
            return
        if g.kind == MAP:
            if isinstance(v, list):
                v = {str(x.get("token", i)) if isinstance(x, dict) else str(i): x for i, x in enumerate(v)}
            items = list(v.items()) if isinstance(v, dict) else []
        else:
            items = [(None, x) for x in (v if isinstance(v, list) else [v] if isinstance(v, dict) else [])]
        own, objects = out.setdefault(path, []), held.setdefault(path, [])
        if not items:
            own.append((r, d, None, None))
            objects.append(None)
            for c in g.children:
                absent(c, path, r, d)
        lists = bool(g.children) and g.children[0].name == ""
        for i, (key, x) in enumerate(items):
            x, at = decoded(x), depth + 1 if i else r
            there = isinstance(x, dict) or lists and isinstance(x, list)
            own.append((at, d + 1 + there, key, None))
            objects.append(x if there and not lists else None)
            for c in g.children:
                if there:
                    put(c, path, x if lists else x.get(c.name), at, d + 2, depth + 1)
                else:
                    absent(c, path, at, d + 1)

    for g in schema:
        put(g, "$", payload.get(g.name), 0, 0, 0)
    groups = set(out)
    out |= {f"$.{k}": [(0, 1, None, v)] for k, v in payload.items() if f"$.{k}" not in groups}
    for path in groups:
        names = dict.fromkeys(k for o in held[path] if o is not None for k in o if f"{path}.{k}" not in groups)
        for k in names:
            out[f"{path}.{k}"] = [(r, d + 1, None, v) if o is not None and (v := o.get(k)) is not None else (r, d, None, None) for (r, d, _, _), o in zip(out[path], held[path], strict=True)]
    return out


def _group_paths(schema: tuple[Group, ...], at: str = "$") -> Iterator[str]:
    for g in schema:
        yield (path := f"{at}.{g.name}")
        yield from _group_paths(g.children, path)


def assemble(columns: dict[str, list], schema: tuple[Group, ...]) -> Iterator[tuple[str, str, str, dict]]:
    """Rows (table, parent path, path, leaves) of every group that has rows, from the level sequences."""
    groups = set(_group_paths(schema))
    below: dict[str, list] = {}  # leaf columns by group
    for path in columns:
        at, _, name = path.rpartition(".")
        if path not in groups and at in groups:
            below.setdefault(at, []).append((name, columns[path]))

    def leaves_of(g: Group, table: str, full: int, at: str = "") -> list[tuple[str, list, int]]:
        """(name, column, level of a value) of a group's leaves, those of single groups without rows included: their
        columns have an entry for each of the group's."""
        own = [(at + name, col, full + 1) for name, col in below.get(table, ())]
        for c in g.children:
            if c.kind == STRUCT:
                own += leaves_of(c, f"{table}.{c.name}", full + 1, f"{at}{c.name}.")
        return own

    def walk(g: Group, table: str, reps: int, level: int, keys: list[dict], labels: list[tuple[str, bool]], owner: int, owners):
        # labels: by repeated ancestor (text before the ordinal, whether keyed); owner: how many labels the parent row has.
        table = f"{table}.{g.name}"
        repeated = g.kind in (LIST, MAP)
        depth = reps + repeated
        full = level + (2 if repeated else 1)
        lists = g.kind == MAP and bool(g.children) and g.children[0].name == ""
        mine = {}
        leaves = leaves_of(g, table, full) if g.kind != STRUCT and not lists else []
        if repeated:
            labels = [*labels, (f"{'.' if g.name else ''}{g.name}", g.kind == MAP)]
        else:
            labels = [*labels[:-1], (labels[-1][0], labels[-1][1], *labels[-1][2:], f".{g.name}")] if labels else [(f".{g.name}", None)]
        at = [0] * depth
        first = True
        for i, (r, d, key, _) in enumerate(columns[table]):
            if first or r == 0:
                at, first = [0] * depth, False
            else:
                at[r - 1] += 1
                at[r:] = [0] * (depth - r)
            if repeated and g.kind == MAP:
                mine[tuple(at)] = key
            if d == full and g.kind != STRUCT and not lists:
                path = text(labels, at, [*keys, mine] if repeated else keys)
                parent = text(owners, at, keys) if owner else "$"
                yield table, parent, path, {name: col[i][3] for name, col, level in leaves if col[i][1] == level}
        if repeated:
            keys = [*keys, mine]
        rows = g.kind != STRUCT and not lists
        for c in g.children:
            yield from walk(c, table, depth, full, keys, labels, 1 if rows else owner, labels if rows else owners)

    def text(labels, at, keys) -> str:
        out, i = "$", 0
        for label in labels:
            out += label[0]
            if label[1] is not None:
                out += f"[{keys[i][tuple(at[: i + 1])] if label[1] else at[i]}]"
                i += 1
            out += "".join(label[2:])
        return out

    for g in schema:
        yield from walk(g, "$", 0, 0, [], [], 0, [])


LEVELS = "record_id bigint, leaf string, seq int, rep int, def int, map_key string, value string"
TABLES = "record_id bigint, record_kind string, table_name string, parent_path string, child_path string, leaves string"
#: Tables of the declared layouts.
DECLARED = ("$.ferryData", "$.ferryData.connections", "$.ferryData.connections.intermediatePoints", "$.lanes.", "$.lanes..branches", "$.lanes..branches.semaphoresEncountered", "$.lanes..branches.trafficRulesEncountered",
            "$.segments", "$.segments.steps", "$.segments.steps.maneuver", "$.segments.steps.maneuver.laneHint.lanes", "$.segments.steps.trafficIcons")


def _records(batches, schemas) -> Iterator[tuple[int, str | None, tuple, dict]]:
    for pdf in batches:
        for record, kind, payload in zip(pdf["record_id"], pdf["record_kind"], pdf["payload"], strict=True):
            if payload is None or pd.isna(record):
                continue
            try:
                v = json.loads(payload)
            except (ValueError, RecursionError):
                continue
            v = decoded(v)
            if isinstance(v, dict):
                schema = laid_out([v], schemas.get(kind, ()))
                yield int(record), kind, schema, shred(v, schema)


def _text(v) -> str | None:
    return None if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _batched(rows, names, size=20_000):
    hold = []
    for row in rows:
        hold.append(row)
        if len(hold) >= size:
            yield pd.DataFrame(hold, columns=names)
            hold = []
    if hold:
        yield pd.DataFrame(hold, columns=names)


def _input(df: DataFrame) -> DataFrame:
    return df.select("record_id", "record_kind", "payload")


def level_columns(df: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """The shredded form of every record, one row a level entry of a group or leaf; values are JSON."""

    def run(batches):
        rows = ((rec, path, i, r, d, key, _text(v)) for rec, _, _, cols in _records(batches, schemas) for path, col in cols.items() for i, (r, d, key, v) in enumerate(col))
        return _batched(rows, ["record_id", "leaf", "seq", "rep", "def", "map_key", "value"])

    return _input(df).mapInPandas(run, LEVELS)


def flat_tables(df: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """All flat tables in one: table_name tells them apart, (record_id, parent_path) links to the parent's child_path;
    leaves are JSON."""

    def run(batches):
        rows = ((rec, kind, table, parent, path, _text(leaves)) for rec, kind, schema, cols in _records(batches, schemas) for table, parent, path, leaves in assemble(cols, schema))
        return _batched(rows, ["record_id", "record_kind", "table_name", "parent_path", "child_path", "leaves"])

    return _input(df).mapInPandas(run, TABLES)


def typed_table(df: DataFrame, table_name: str, columns: dict[str, tuple[str, str]], schemas=SCHEMAS) -> DataFrame:
    """One flat table with typed columns: name -> (leaf, type). A value that isn't of the type without loss is null."""

    def run(batches):
        rows = ((rec, parent, path, *(cast_exactly(leaves.get(leaf), t) for leaf, t in columns.values())) for rec, _, schema, cols in _records(batches, schemas) for table, parent, path, leaves in assemble(cols, schema) if table == table_name)
        return (pdf.astype(object).where(pdf.notna(), None) for pdf in _batched(rows, ["record_id", "parent_path", "child_path", *columns]))

    fields = "".join(f", {name} {t}" for name, (_, t) in columns.items())
    return _input(df).mapInPandas(run, f"record_id bigint, parent_path string, child_path string{fields}")
