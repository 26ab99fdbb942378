"""Text functions as column expressions: tidying of labels, tokenizing of searches, formatting of quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_tags(c: Column) -> Column:
    """Line breaks become spaces, other tags vanish, white space is collapsed and trimmed."""
    text = F.regexp_replace(c, r"(?i)<br\s*/?>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\s+", " "))


def first_line(c: Column) -> Column:
    """What stands before a line break, without tags."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<br>.*", ""), r"<.*?>", "")


def title_case(c: Column) -> Column:
    """Texts all in one case get a capital at the start of each run of letters; others stay."""
    one_case = ~c.rlike(r"\p{Ll}") | ~c.rlike(r"\p{Lu}")
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    titled = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000_000)))), "")
    return F.when(one_case, titled).otherwise(c)


#: Abbreviations of place names and what they stand for.
ABBREVIATIONS = (
    (r" Ck$", " Creek"),
    (r"^Ft\.? ", "Fort "),
    (r" Jct$", " Junction"),
    (r"^Mt\.? ", "Mount "),
    (r" Mtn$", " Mountain"),
    (r"^St\.? ", "Saint "),
    (r"^So ", "South "),
    (r" Spgs$| Sprs\.$", " Springs"),
)


def expand_abbreviations(c: Column) -> Column:
    for pattern, text in ABBREVIATIONS:
        c = F.regexp_replace(c, pattern, text)
    return c


def squash(c: Column) -> Column:
    """Letters only, in lower case: a key for fuzzy equality."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))


#: Accented letters of the maps' languages and their base letters.
ACCENTED, BASE = "àáâãäåąçćčďèéêëęěìíîïłñńňòóôõöőøřśšťùúûüůűýÿźżž", "aaaaaaacccdeeeeeeiiiilnnnooooooorsstuuuuuuyyzzz"


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, BASE)


def search_terms(c: Column) -> Column:
    """Words and "quoted phrases" of a search text."""
    return F.transform(F.regexp_extract_all(c, F.lit(r'("[^"]*"|[^\s"]+)'), 1), lambda w: F.regexp_replace(w, '"', ""))


def matches_all(terms: Column, *fields: Column) -> Column:
    """Every term stands in at least one field, accents and case ignored."""
    hay = [fold(F.coalesce(f, F.lit(""))) for f in fields]

    def somewhere(t: Column) -> Column:
        found = F.lit(False)
        for h in hay:
            found = found | h.contains(fold(t))
        return found

    return F.forall(terms, somewhere)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    tens, one = F.abs(n) % 100, F.abs(n) % 10
    end = F.when(tens.between(11, 13), "th").when(one == 1, "st").when(one == 2, "nd").when(one == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def significant(v: Column, digits: int) -> Column:
    """Rounded to so many significant digits, halves up."""
    size = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, 0.0).otherwise(F.floor(v * size + 0.5) / size)


def plain_number(v: Column) -> Column:
    """At most two decimals, none that are zero."""
    return F.regexp_replace(F.format_number(v, 2), r"\.?0+$", "")


def metric_length(metres: Column) -> Column:
    m = F.floor(metres + 0.5).cast("double")
    near = F.floor(significant(m, 1) / 10 + 0.5) * 10.0
    mid = significant(F.floor(m / 50 + 0.5) * 50.0, 2)
    short = F.when(m <= 100, near).when(m <= 200, significant(m, 2)).otherwise(mid)
    return F.when(m <= 1000, F.concat(plain_number(short), F.lit(" m"))).otherwise(F.concat(plain_number(F.floor(m / 1000 + 0.5)), F.lit(" km")))


def imperial_length(metres: Column) -> Column:
    miles = metres * 0.0006213712
    feet = F.floor(F.greatest(F.lit(1.0), metres * 3.28084) / 50 + 0.5) * 50.0
    far = F.when(miles <= 1, significant(miles, 1)).when(miles <= 10, significant(miles, 2)).otherwise(F.floor(miles + 0.5))
    return F.when(miles <= 0.1, F.concat(plain_number(feet), F.lit(" ft"))).otherwise(F.concat(plain_number(far), F.lit(" mi")))


def duration_text(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600), F.ceil((seconds % 3600) / 60)
    return F.concat_ws(" ", F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" hr"))), F.concat(minutes.cast("string"), F.lit(" min")))


def route_key(start: Column, end: Column, direction: Column, mode: Column, map_name: Column) -> Column:
    return F.concat_ws("-", start, end, direction, mode, map_name)


def is_route_key(c: Column) -> Column:
    """Five parts with two uids, a direction, any mode and a known map."""
    return F.coalesce(c.rlike(r"^(?i:[0-9a-f]{1,16}-[0-9a-f]{1,16})-(?:forward|backward)-[^-]*-(?:usa|europe)(?:-|$)"), F.lit(False))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def rotate_right(a: Column, n: int) -> Column:
    """The array turned right by n places, left for negative n."""
    k = F.pmod(F.lit(n), F.greatest(F.size(a), F.lit(1)))
    return F.when(F.size(a) == 0, a).otherwise(F.concat(F.slice(a, F.size(a) - k + 1, k), F.slice(a, F.lit(1), F.size(a) - k)))


def first_containing(c: Column, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """Class of the first rule of which a text holds any part."""
    out = F.lit(default)
    for parts, name in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | c.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def any_lane(lanes: Column, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """Class of the first rule of which any lane holds any part."""

    def holds(parts: tuple[str, ...]) -> Column:
        return F.exists(lanes, lambda v: sum((v.contains(p).cast("int") for p in parts), F.lit(0)) > 0)

    out = F.lit(default)
    for parts, name in reversed(rules):
        out = F.when(holds(parts), name).otherwise(out)
    return out
