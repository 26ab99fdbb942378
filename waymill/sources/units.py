"""Unit files: text blocks of `class : name { key: value ... }` read into rows."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*|//[^\n]*|/\*.*?\*/)|"(?P<text>(?:[^"\\]|\\.)*)"|(?P<mark>[{}:])|(?P<key>[\w.]+\[\d*\])|(?P<word>[^\s{}:"\#,()\[\]]+)|(?P<vector>\([^)]*\))|(?P<other>.)""",
    re.S | re.X,
)
_ESCAPE = re.compile(r"((?:\\x[0-9a-fA-F]{2})+)")


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    for m in _TOKEN.finditer(text):
        if m.lastgroup != "skip":
            yield m.lastgroup, m.group(m.lastgroup)


def value(kind: str, raw: str):
    """Text, number, boolean, hexadecimal float (the greatest one means nothing), vector or bare word."""
    if kind == "text":
        raw = _ESCAPE.sub(lambda m: bytes.fromhex(m.group(1).replace("\\x", "")).decode("utf-8", "replace"), raw)
        return raw.replace('\\"', '"').replace("\\\\", "\\")
    if kind == "vector":
        return [value("word", v.strip()) for v in raw[1:-1].split(",") if v.strip()]
    if raw.startswith("&") and re.fullmatch(r"&[0-9a-fA-F]{8}", raw):
        return None if raw.lower() == "&7f7fffff" else struct.unpack(">f", bytes.fromhex(raw[1:]))[0]
    if re.fullmatch(r"[-+]?\d+", raw):
        return int(raw)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?", raw):
        return float(raw)
    return {"true": True, "false": False, "nil": None}.get(raw, raw)


def units(text: str) -> list[tuple[str, str, str, int | None, object]]:
    """(class, name, key, index, value) of every property; an indexed or repeated key fills a list. Text that breaks off
    gives what came before."""
    out, tokens = [], list(_tokens(text))
    i = 0
    while i + 3 < len(tokens):
        if tokens[i][0] == "word" and tokens[i + 1] == ("mark", ":") and tokens[i + 3] == ("mark", "{"):
            cls, name, i, counts = tokens[i][1], tokens[i + 2][1], i + 4, {}
            while i < len(tokens) and tokens[i] != ("mark", "}"):
                if i + 2 < len(tokens) and tokens[i][0] in ("word", "key") and tokens[i + 1] == ("mark", ":"):
                    key, _, listed = tokens[i][1].partition("[")
                    at = None
                    if listed:
                        at = counts[key] = counts.get(key, -1) + 1
                    out.append((cls, name, key, at, value(*tokens[i + 2])))
                    i += 3
                else:
                    i += 1
        i += 1
    return out


def read_units(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Properties of the units in each text, values as text (null stays null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *x[:4], None if x[4] is None else str(x[4])) for k, t in zip(pdf["k"], pdf["t"], strict=True) if t for x in units(t)]
            yield pd.DataFrame(rows, columns=["id", "class", "name", "key", "ord", "value"]).astype({"ord": "Int32"})

    own = df.selectExpr(f"cast({key} as bigint) AS k", f"{text} AS t").filter("t LIKE '%{%'")
    return own.mapInPandas(run, "id bigint, class string, name string, key string, ord int, value string")
