"""Schemas that drift between files: rescue-column ingestion.

Every payload is held against a target schema. Fields that the schema knows, in a type it knows, are typed; all other
fields are kept in a rescue column. The version before supplies the schema for the next one, so the rescue column and
the fields left empty say what changed: unknown fields were added, mistyped fields changed type, empty ones were
removed, and a rescued field whose values equal those of an empty one beside it is that field renamed.

For consistent tables a fixed target schema applies instead; what it doesn't take stays in `rescued` as JSON, and
promote() replays rescued values of approved fields (and approved former names) into typed columns later on, from the
rescue column alone.

Versions of a file are paired by a range sort on (file, version), which also splits a file that holds a third of all
rows; all payloads of one version stand in one partition. What stands at the ends of neighbouring partitions is paired
by an equi-join on the partition's number. Null payloads, paths and versions and
payloads that are cut off yield nothing; of two payloads of one version the one that sorts first counts; repeated rows
count once; versions order number by number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymill.functions.values import cast_exactly
from waymill.session import Scratch

CHANGES = "file_path string, game_version string, change_kind string, old_path string, new_path string"


def _kind(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", dict: "object", list: "array"}[type(v)]


def fields(payload, keyed: str = "ferryData") -> dict[str, tuple[set, dict]]:
    """By field path: its types, and its values by the place they stand in. Nulls are no fields."""
    out: dict[str, tuple[set, dict]] = {}

    def walk(v, path: str, place: tuple) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                if x is None:
                    continue
                if path == keyed:
                    walk(x, f"{path}/*", (*place, k))
                    continue
                p = f"{path}/{k}" if path else k
                types, values = out.setdefault(p, (set(), {}))
                types.add(_kind(x))
                values[place] = json.dumps(x, sort_keys=True)
                walk(x, p, place)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}/[]", (*place, i))

    walk(payload, "", ())
    return out


def _above(path: str) -> str:
    """The field above, '' at the root: list elements and ferry keys are no fields."""
    parts = path.split("/")[:-1]
    while parts and parts[-1] in ("[]", "*"):
        parts.pop()
    return "/".join(parts)


def enforce(found: dict, target: dict) -> tuple[dict, dict, dict]:
    """(conforming, rescued, empty) fields of a payload under a target schema; below a field that doesn't conform
    nothing is listed."""
    good, rescued, empty = {}, {}, {}
    for p in sorted(found.keys() | target.keys(), key=lambda p: (p.count("/"), p)):
        if (up := _above(p)) and up not in good:
            continue
        if p not in found:
            empty[p] = target[p]
        elif p in target and found[p][0] == target[p][0]:
            good[p] = found[p]
        else:
            rescued[p] = found[p]
    return good, rescued, empty


def changes(before: dict, after: dict) -> list[tuple[str, str, str]]:
    """(kind, old path, new path) of every change of shape between two versions' fields."""
    _, rescued, empty = enforce(after, before)
    out = [("type_changed", p, p) for p in rescued if p in before]
    added, beside = [p for p in rescued if p not in before], lambda p: p.rpartition("/")[0]
    for old in empty:
        new = next((p for p in added if beside(p) == beside(old) and rescued[p][1] == empty[old][1]), None)
        if new is None:
            out.append(("removed", old, ""))
        else:
            added.remove(new)
            out.append(("renamed", old, new))
    return out + [("added", "", p) for p in added]


def version_key(c: Column) -> Column:
    """Numbers of a dotted version, for ordering."""
    return F.transform(F.split(c, r"\."), lambda x: x.try_cast("bigint"))


def _refused(text: str):
    raise ValueError(f"{text} is no JSON")


def _parsed(payload):
    try:
        v = json.loads(payload, parse_constant=_refused)
    except (ValueError, TypeError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def shape_changes(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every change of shape between a version of a file and the one before it among the rows.

    partitions: of the range sort, by default the session's; the result doesn't depend on them.
    """
    scratch = Scratch(files.sparkSession, "drift")
    rows = files.select("file_path", "game_version", "payload").filter("file_path IS NOT NULL AND game_version IS NOT NULL AND payload IS NOT NULL").distinct()
    key = ["file_path", "vkey", "game_version"]
    rows = rows.withColumn("vkey", version_key(F.col("game_version")))
    rows = (rows.repartitionByRange(partitions, *key) if partitions else rows.repartitionByRange(*key)).sortWithinPartitions(*key, "payload")
    out = scratch.write(rows.select("file_path", "game_version", "payload").mapInPandas(_compare, f"{CHANGES}, part int, payload string"), "changes")
    ends = out.filter("payload IS NOT NULL")
    # one number a partition: the next one that holds rows
    parts = ends.select("part").distinct().withColumn("next", F.lead("part").over(W.orderBy("part")))
    last = ends.filter("change_kind = 'last'").join(parts, "part").select(F.col("next").alias("part"), F.col("file_path").alias("a_path"), F.col("payload").alias("a"))
    first = ends.filter("change_kind = 'first'").select("part", "file_path", "game_version", "payload")
    across = first.join(last, "part").filter("file_path = a_path").select("file_path", "game_version", "a", "payload").mapInPandas(_compare_ends, CHANGES)
    return out.filter("payload IS NULL").drop("payload", "part").unionByName(across).distinct()


_COMPARED = ["file_path", "game_version", "change_kind", "old_path", "new_path", "part", "payload"]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes between neighbours; the first and the last row of the partition come out themselves."""
    before, last, part = None, None, TaskContext.get().partitionId()
    for pdf in batches:
        rows = []
        for path, version, payload in pdf.itertuples(index=False):
            if last and (path, version) == last[:2]:
                continue
            if (v := _parsed(payload)) is None:
                continue
            now = fields(v)
            if last is None:
                rows.append((path, version, "first", "", "", part, payload))
            elif path == last[0]:
                rows += [(path, version, *c, part, None) for c in changes(before, now)]
            before, last = now, (path, version, payload)
        yield pd.DataFrame(rows, columns=_COMPARED)
    if last:
        yield pd.DataFrame([(last[0], last[1], "last", "", "", part, last[2])], columns=_COMPARED)


def _compare_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes between the last row of a partition and the first of the next."""
    for pdf in batches:
        rows = [(path, version, *c) for path, version, a, b in pdf.itertuples(index=False) for c in changes(fields(_parsed(a)), fields(_parsed(b)))]
        yield pd.DataFrame(rows, columns=["file_path", "game_version", "change_kind", "old_path", "new_path"])


#: Target schemas by file kind: typed columns with the path that fills each.
TARGETS = {
    "ferry": {"ferry_name": ("ferryName", "string"), "ferry_name_localized": ("ferryNameLocalized", "string"), "price": ("price", "double"), "transit": ("transit", "bigint")},
    "icon_mat": {"texture_source": ("source", "string"), "u_address": ("u_address", "string"), "queue": ("queue", "bigint")},
    "localization": {"entry_key": ("key", "string"), "entry_value": ("val", "string")},
}
#: Where the fields of a row stand in a payload's paths.
ROWS = {"ferry": ("ferryData/*/", "ferryData/[]/"), "icon_mat": ("effect/*/", ""), "localization": ("localizationDb/*/",)}


def approvals(changes_: DataFrame, kind: str, hops: int = 8) -> dict[str, tuple[str, ...]]:
    """Other names of each target column's field, from the `renamed` rows of shape_changes() of files of one kind.

    Names are followed from the target's own one over at most so many renamings either way; only names met on the way
    come to the driver.
    """
    names = changes_.filter("change_kind = 'renamed'").select(F.element_at(F.split("old_path", "/"), -1).alias("a"), F.element_at(F.split("new_path", "/"), -1).alias("b")).distinct().cache()
    out = {}
    for column, (path, _) in TARGETS[kind].items():
        known, front = [path], [path]
        for _ in range(hops):
            met = names.filter(F.col("a").isin(front) | F.col("b").isin(front)).collect()
            front = sorted({n for r in met for n in r} - set(known))
            if not front:
                break
            known += front
        out[column] = tuple(n for n in known[1:] if n not in {p for p, _ in TARGETS[kind].values()})
    names.unpersist()
    return out


def _flat(v, path: str = "") -> Iterator[tuple[str, object]]:
    """Scalars and lists by path below an object; empty objects count as values."""
    if isinstance(v, dict) and v:
        for k, x in v.items():
            if x is not None:
                yield from _flat(x, f"{path}/{k}" if path else k)
    else:
        yield path, v


def _units(kind: str, payload: dict) -> Iterator[tuple[str, dict]]:
    """(row key, fields by path) of the rows a payload gives."""
    if kind == "ferry":
        data = payload.get("ferryData")
        items = data.items() if isinstance(data, dict) else ((x.get("token"), {k: v for k, v in x.items() if k != "token"}) for x in data or [] if isinstance(x, dict))
        for key, v in items:
            if key is not None and isinstance(v, dict):
                yield str(key), dict(_flat(v))
    elif kind == "localization":
        db = payload.get("localizationDb")
        if not isinstance(db, dict):
            return
        for unit, v in db.items():
            if not isinstance(v, dict):
                continue
            lists = {k: x.split(";") if isinstance(x, str) else x for k, x in v.items() if isinstance(x, (str, list))}
            for i in range(max(map(len, lists.values()), default=0)):
                yield f"{unit.lstrip('.')}[{i}]", {k: x[i] for k, x in lists.items() if i < len(x) and x[i] is not None}
    else:
        rest = {k: v for k, v in payload.items() if k != "effect" and v is not None}
        effects = payload.get("effect")
        effects = effects if isinstance(effects, dict) and effects else {"": {}}
        for name, v in effects.items():
            texture = v.get("texture") if isinstance(v, dict) else None
            inner = texture.get("texture") if isinstance(texture, dict) else None
            own = {k: x for k, x in v.items() if k != "texture"} if isinstance(v, dict) else {}
            yield name, dict(_flat(own)) | dict(_flat(inner if isinstance(inner, dict) else {})) | dict(_flat(rest))


_TABLE = "file_kind string, file_path string, game_version string, row_key string"


def ingest(files: DataFrame, kind: str) -> DataFrame:
    """One consistent table of a file kind under its target schema, with all other fields in `rescued` (JSON)."""
    target = TARGETS[kind]
    schema = f"{_TABLE}, {', '.join(f'{c} {t}' for c, (_, t) in target.items())}, rescued string"

    def run(batches):
        for pdf in batches:
            rows = []
            for path, version, payload in zip(pdf["file_path"], pdf["game_version"], pdf["payload"], strict=True):
                v = _parsed(payload)
                for key, own in _units(kind, v) if v is not None else ():
                    typed = {c: cast_exactly(own.get(p), t) for c, (p, t) in target.items()}
                    left = {p: x for p, x in own.items() if not any(p == q and typed[c] is not None for c, (q, _) in target.items())}
                    rows.append((kind, path, version, key, *typed.values(), json.dumps(left, sort_keys=True) if left else None))
            yield pd.DataFrame(rows, columns=["file_kind", "file_path", "game_version", "row_key", *target, "rescued"]).astype(object)

    own = files.filter(F.col("file_kind") == kind).select("file_path", "game_version", "payload").distinct()
    return own.mapInPandas(run, schema)


def promote(table: DataFrame, kind: str, approved: dict[str, tuple[str, ...]]) -> DataFrame:
    """Replay approved fields from `rescued` into typed columns that are still empty; what was used leaves the rescue.

    approved: other names of each column's field, in order of preference. A field that became an object with one value
    in it counts as that value.
    """
    names, types = {c: (p, *approved.get(c, ())) for c, (p, _) in TARGETS[kind].items()}, {c: t for c, (_, t) in TARGETS[kind].items()}

    def run(batches):
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for i, text in enumerate(pdf["rescued"]):
                if text is None:
                    continue
                left = json.loads(text)
                for column, own in names.items():
                    for name in own:
                        within = [p for p in left if p.startswith(f"{name}/")]
                        at = name if name in left else within[0] if len(within) == 1 else None
                        if at is not None and pdf.at[i, column] is None and (v := cast_exactly(left[at], types[column])) is not None:
                            pdf.at[i, column] = v
                            del left[at]
                pdf.at[i, "rescued"] = json.dumps(left, sort_keys=True) if left else None
            yield pdf

    return table.mapInPandas(run, table.schema)
