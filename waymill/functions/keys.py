"""Keys: unsigned 64-bit uids in hex, and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(2**63)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token(c: Column | str) -> Column:
    """Trimmed and lower-cased; empty becomes null."""
    text = F.lower(F.regexp_replace(_col(c), r"^\s+|\s+$", ""))
    return F.when(text != "", text)


def uid(c: Column | str) -> Column:
    """Reference form (lower-case hex without leading zeros) of any spelling.

    Null and blank give null; text that is no 64-bit hex number stays as trimmed lower-case text, so it
    equals only itself.
    """
    text = token(c)
    digits = F.regexp_extract(text, r"^(?:0x)?0*([0-9a-f]{1,16})$", 1)
    return F.when(digits != "", digits).otherwise(text)


def is_uid(c: Column | str) -> Column:
    """Whether a reference-form uid is a number at all."""
    return _col(c).rlike("^[0-9a-f]{1,16}$")


def uid_rank(c: Column | str) -> Column:
    """A BIGINT that orders reference-form uids as unsigned numbers; null for text that is no number."""
    signed = F.conv(F.when(is_uid(c), _col(c)), 16, -10).cast("bigint")
    return signed.bitwiseXOR(F.lit(_SIGN).cast("bigint"))


def uid_of_rank(c: Column | str) -> Column:
    """The reference form back from uid_rank."""
    return F.lower(F.hex(_col(c).bitwiseXOR(F.lit(_SIGN).cast("bigint"))))


def world(c: Column | str = "map_name") -> Column:
    """Map name for joins: a null name is a world of its own."""
    return F.coalesce(_col(c), F.lit("\u0000"))
