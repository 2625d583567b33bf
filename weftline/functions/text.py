"""Text functions as column expressions; all run in the JVM but re_all with a group that may be missing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel import text as K
from .arrow import batched

_WHITE = r"\p{IsWhite_Space}"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{_WHITE}+|{_WHITE}+$", "")


def decode_entities(c: Column) -> Column:
    for name, char in K.ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def clean(c: Column, remove_entities: bool = False) -> Column:
    out = strip(F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), "[\t\n ]+", " "))
    return decode_entities(out) if remove_entities else out


def replace(c: Column, old: str, new: str) -> Column:
    """All occurrences; an empty old stands between all characters and at both ends."""
    if old == "":
        between = F.concat(F.lit(new), F.array_join(F.transform(F.split(c, ""), lambda x: F.concat(x, F.lit(new))), ""))
        return F.when(c == "", F.lit(new)).otherwise(between)
    return F.replace(c, F.lit(old), F.lit(new))


def split(c: Column, delimiter: str) -> Column:
    """All pieces, empty ones too; by an empty delimiter the characters between two empty pieces."""
    if delimiter == "":
        empty = F.array(F.lit(""))
        return F.concat(empty, F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "")), empty)
    return F.split(c, re.sub(r"([^\w\s])", r"\\\1", delimiter), -1)


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def json_value(c: Column) -> Column:
    """The text as a VARIANT; null if it isn't JSON."""
    return F.try_parse_json(c)


def re_all(c: Column, pattern: str, replace_entities: bool = False, clean_match: bool = False, case_sensitive: bool = True) -> Column:
    """Group 1 of every match, or the match where there is no group; a bad pattern gives an empty array.

    The JVM's expressions are used when they can't differ: no group, or a group
    that takes part in every match.
    """
    text = decode_entities(c) if replace_entities else c
    try:
        groups = re.compile(pattern).groups
    except re.error:
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    if groups and re.search(r"[|]|\)[?*{]|\(\?", pattern) or "(?P" in pattern:
        found = batched(lambda t: None if t is None else K.regex_all(t, pattern, False, False, case_sensitive), "array<string>")(text)
    else:
        found = F.regexp_extract_all(text, F.lit(f"(?U{'' if case_sensitive else 'i'}){pattern}"), F.lit(min(1, groups)))
    return F.transform(found, strip) if clean_match else found


def re_first(c: Column, pattern: str, **flags: bool) -> Column:
    return F.get(re_all(c, pattern, **flags), F.lit(0))


def xpath_literal(c: Column) -> Column:
    """The text as an XPath string: in quotes that it doesn't hold, or put together from parts."""
    parts = F.concat(F.lit("concat('"), F.replace(c, F.lit("'"), F.lit("', \"'\", '")), F.lit("')"))
    return F.when(~c.contains("'"), F.concat(F.lit("'"), c, F.lit("'"))).when(~c.contains('"'), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(parts)


title_case = batched(lambda t: None if t is None else K.title_case(t), "string")


def safe_segment(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), F.lit("")), F.lit("_"))


def xml_name(c: Column) -> Column:
    name = F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")
    return F.when(name.rlike("^[A-Za-z_]"), name).otherwise(F.concat(F.lit("_"), name))


def csv_cell(c: Column) -> Column:
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def round_away(c: Column, digits: int = 2) -> Column:
    """Halves away from zero, for values that aren't negative."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def bounded(c: Column, low: float = 0.0, high: float = 86400.0) -> Column:
    """Within the bounds; 0 in place of what isn't finite."""
    odd = F.isnan(c) | c.isNull() | (F.abs(c) == float("inf"))
    return F.when(odd, F.lit(0.0)).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def retry_after(c: Column) -> Column:
    """Seconds of a Retry-After header; null for dates and nonsense."""
    s = strip(c).try_cast("double")
    return F.when((s >= 0) & (s < float("inf")), s)
