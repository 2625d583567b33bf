"""Scalar functions on text: cleaning, entities, regular expressions."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from .dom import WHITE

_RUN = re.compile(r"[\t\n ]+")
#: In this order, the ampersand last, so that nothing is decoded twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def strip(text: str) -> str:
    return text.strip(WHITE)


def decode_entities(text: str) -> str:
    if "&" in text:
        for name, char in ENTITIES:
            text = text.replace(name, char)
    return text


def clean(text: str, remove_entities: bool = False) -> str:
    """One space in place of runs of tabs, line feeds and spaces; carriage returns go; trimmed."""
    out = strip(_RUN.sub(" ", text.replace("\r", "")))
    return decode_entities(out) if remove_entities else out


@lru_cache(512)
def _compiled(pattern: str, case_sensitive: bool) -> re.Pattern[str] | None:
    try:
        return re.compile(pattern, 0 if case_sensitive else re.I)
    except re.error:
        return None


def regex_all(text: str, pattern: str, replace_entities: bool = False, clean_match: bool = False, case_sensitive: bool = True) -> list[str]:
    """Group 1 of each match, or the match if there are no groups; a match without group 1 is left out; a bad pattern finds nothing."""
    p = _compiled(pattern, case_sensitive)
    if p is None:
        return []
    group = min(1, p.groups)
    found = (m.group(group) for m in p.finditer(decode_entities(text) if replace_entities else text))
    return [strip(x) if clean_match else x for x in found if x is not None]


def regex_first(text: str, pattern: str, *flags: bool) -> str | None:
    found = regex_all(text, pattern, *flags)
    return found[0] if found else None


def parse_json(text: str) -> object | None:
    try:
        return json.loads(text)
    except ValueError:
        return None


def title_case(text: str) -> str:
    """Each letter after a non-letter in upper case, the others in lower case."""
    return text.title()


def safe_segment(text: str) -> str:
    """A name that is safe as a folder: other characters become underscores."""
    return re.sub(r"[^A-Za-z0-9_-]", "_", text) or "_"
