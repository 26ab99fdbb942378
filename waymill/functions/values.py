"""Values of semi-structured data cast to declared types without loss."""

from __future__ import annotations

import math
import re

_INTEGER, _NUMBER = re.compile(r"[+-]?[0-9]+"), re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def cast_exactly(v, kind: str):
    """The value as string, bigint, double or boolean, or None if that isn't the same value.

    A number isn't a string, 12.7 is no bigint, nor is 2**70; text counts as the number it spells in plain digits;
    infinities and NaN are no numbers.
    """
    if kind == "string":
        return v if isinstance(v, str) else None
    if kind == "boolean":
        return v if isinstance(v, bool) else None
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return None
    if isinstance(v, str):
        if not (_INTEGER if kind == "bigint" else _NUMBER).fullmatch(v):
            return None
        v = int(v) if kind == "bigint" else float(v)
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if kind == "bigint":
        return int(v) if v == int(v) and -(2**63) <= v < 2**63 else None
    try:
        return float(v) if float(v) == v else None
    except OverflowError:
        return None
