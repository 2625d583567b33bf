"""Items (JSON objects with keys in order) as JSON, JSON Lines, CSV and XML."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def flat(value: object) -> str:
    """A cell: strings as they are, null empty, nested values as compact JSON."""
    return "" if value is None else value if isinstance(value, str) else compact(value)


def keys(items: Iterable[object]) -> list[str]:
    """All keys, in the order in which they are first seen."""
    return list(dict.fromkeys(k for i in items if isinstance(i, dict) for k in i))


def csv_cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if re.search(r'[,"\r\n]', text) else text


def csv_line(cells: Iterable[str]) -> str:
    return ",".join(map(csv_cell, cells)) + "\r\n"


def to_csv(items: list[object]) -> str:
    """A header of all keys and a row for each object, ended by CR LF; without keys a blank line alone."""
    names = keys(items)
    rows = [csv_line(flat(i.get(k)) for k in names) for i in items if isinstance(i, dict)]
    return "".join([csv_line(names), *rows])


_MARKUP = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}


def xml_text(text: str) -> str:
    """Escaped, without the control characters that XML can't hold."""
    return "".join(_MARKUP.get(c, c) for c in text if c in "\t\n\r" or not (unicodedata.category(c) == "Cc" or c in "\ufffe\uffff"))


def xml_name(key: str) -> str:
    name = re.sub(r"[^A-Za-z0-9_.-]", "_", key) or "_"
    return name if re.match(r"[A-Za-z_]", name) else "_" + name


def xml_item(item: dict) -> str:
    cells = ((xml_name(k), xml_text(flat(v))) for k, v in item.items())
    return "  <item>\n" + "".join(f"    <{n}>{t}</{n}>\n" for n, t in cells) + "  </item>\n"


XML_HEAD, XML_FOOT = '<?xml version="1.0" encoding="UTF-8"?>\n<items>\n', "</items>\n"


def to_xml(items: list[object]) -> str:
    return XML_HEAD + "".join(xml_item(i) for i in items if isinstance(i, dict)) + XML_FOOT


def to_json(items: list[object], indent: int = 0) -> str:
    return json.dumps(items, ensure_ascii=False, indent=indent) if indent else compact(items)


def to_jsonl(items: list[object]) -> str:
    return "".join(compact(i) + "\n" for i in items)
