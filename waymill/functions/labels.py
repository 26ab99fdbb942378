"""Labels: countries of tokens, names that aren't places, camera positions in addresses, signs and instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that differ from ISO 3166.
ISO = {"uk": "GB", "kosovo": "XK"}
#: Names that are junctions, borders or route numbers.
EXCLUDED = [r"\sx\s", r"(?i)\bstate line$", r"(?i)\bborder$", r"^(?:[A-Z]{1,2}|US|SR)-\d+$"]
#: Words of turns at the start of an instruction.
TURNS = {"depart": "Depart", "arrive": "Arrive", "through": "Continue", "u_turn": "Make a U-turn"} | {f"{k}_{s}": f"{w} {s}" for k, w in (("slight", "Keep"), ("turn", "Turn"), ("sharp", "Turn sharp")) for s in ("left", "right")}


def token_country(c: Column) -> Column:
    """Two letters before the first underscore of a token, null without them."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), "^([a-z]{2})_", 1), F.lit(""))


def iso_code(c: Column) -> Column:
    out = F.upper(c)
    for k, v in ISO.items():
        out = F.when(F.lower(c) == k, v).otherwise(out)
    return out


def is_excluded(c: Column) -> Column:
    """Whether a name is no place of its own; null stays null."""
    found = F.lit(False)
    for p in EXCLUDED:
        found = found | c.rlike(p)
    return found


def without_article(c: Column) -> Column:
    return F.regexp_replace(c, "^(?i:The) ", "")


def camera_hash(lat: Column, lon: Column, zoom: Column) -> Column:
    """`#zoom/lat/lon`, with two and five decimals."""
    return F.format_string("#%.2f/%.5f/%.5f", zoom, lat, lon)


def camera_of(hash_: Column) -> Column:
    """(lat, lon, zoom) of such a hash; null fields for what is no number."""
    p = F.split(F.regexp_replace(hash_, "^#", ""), "/")
    at = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.struct(at(1).alias("lat"), at(2).alias("lon"), at(0).alias("zoom"))


def sign_road(path: Column) -> Column:
    """`X-12 NORTH` of a texture's path `.../x_12_north.mat`."""
    p = F.split(F.regexp_extract(path, r"([^/.]+)\.[^/]*$", 1), "_")
    return F.concat(F.upper(p[0]), F.lit("-"), p[1], F.coalesce(F.concat(F.lit(" "), F.upper(F.get(p, F.lit(2)))), F.lit("")))


def instruction(turn: Column, road: Column, toward: Column) -> Column:
    """A step in words: the turn, the road it leads onto and where that goes, as far as they are known."""
    words = F.create_map(*[F.lit(x) for kv in TURNS.items() for x in kv])[turn]
    return F.concat_ws(" ", words, F.concat(F.lit("onto "), road), F.concat(F.lit("toward "), toward))
