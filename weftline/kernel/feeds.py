"""Feeds: CSV, RSS and Atom, sitemaps, and shop catalogues."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from urllib.parse import unquote

from . import robots
from . import url as U
from .css import elements
from .dom import WHITE, Page, all_text, own_text
from .text import title_case

# ---- CSV ----


def csv_rows(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows after RFC 4180; a quote opens a quoted part at a field's start alone, and blank lines give no row."""
    rows: list[list[str]] = []
    d = re.escape(delimiter)
    plain, line = re.compile(rf"(?:(?!{d})[^\n])*"), len(text)
    at, row, field, started = 0, [], "", False
    while at < line:
        if text[at] == '"' and not field:
            started = True
            end = at + 1
            parts = []
            while True:
                stop = text.find('"', end)
                if stop < 0:
                    parts.append(text[end:])
                    end = line
                    break
                parts.append(text[end:stop])
                if text[stop + 1 : stop + 2] != '"':
                    end = stop + 1
                    break
                parts.append('"')
                end = stop + 2
            field, at = "".join(parts), end
            if field == "" and text[at : at + 1] == '"':
                continue
        m = plain.match(text, at)
        run, at = m.group(), m.end()
        after = text[at : at + 1]
        if after == "\n" and run.endswith("\r"):
            run = run[:-1]
        field += run
        started = started or bool(run)
        if after == "\n" or not after:
            if started or field:
                rows.append([*row, field])
            row, field, started = [], "", False
            at += 1
        else:
            row.append(field)
            field, started = "", True
            at += len(delimiter)
            if at >= line:
                rows.append([*row, ""])
    return rows


def csv_items(text: str, delimiter: str = ",", headers: list[str] | None = None) -> list[dict[str, str]]:
    """A row as header to value; short rows are filled with empty values, and what is beyond the headers is dropped."""
    rows = csv_rows(text, delimiter)
    if headers is None:
        if not rows:
            return []
        headers, rows = rows[0], rows[1:]
    return [dict(zip(headers, [*r, *[""] * len(headers)])) for r in rows]


# ---- RSS and Atom ----

_VOID_NAMES = {"link": "xmlfeed-link", "meta": "xmlfeed-meta"}
_NAMES_BACK = {v: k for k, v in _VOID_NAMES.items()}
_VOID_TAG = re.compile(r"""<(?:/(link|meta)(?=[>\s/]|\Z)|(link|meta)(?=[>\s/])((?:[^>"']|"[^"]*"|'[^']*')*)(>)?)""", re.I)


def rewrite_void_tags(text: str) -> str:
    """Names that HTML takes as void get others, and their self-closing forms an end tag."""

    def new(m: re.Match[str]) -> str:
        if m[1]:
            return "</" + _VOID_NAMES[m[1].lower()]
        name, rest = _VOID_NAMES[m[2].lower()], m[3]
        if not m[4]:
            return f"<{name}{rest}"
        return f"<{name}{rest[:-1]}></{name}>" if rest.endswith("/") else f"<{name}{rest}>"

    return _VOID_TAG.sub(new, text)


def xml_items(text: str, iterate: str = "item", url: str = "") -> list[dict[str, str]]:
    """Of each element named iterate: its child elements' names and trimmed texts; of a repeated name the last."""
    page = Page(rewrite_void_tags(text), url)
    return [{_NAMES_BACK.get(x.tag, x.tag): all_text(x).strip(WHITE) for x in elements(node)} for node in page.select(iterate)]


# ---- sitemaps ----


def sitemap(text: str, alternates: bool = False) -> tuple[list[str], list[str]]:
    """(page URLs, child sitemaps), each once; an index with entries has no pages."""
    page = Page(text)
    children = dict.fromkeys(t for x in page.select("sitemapindex loc") if (t := own_text(x).strip(WHITE)))
    if children:
        return [], list(children)
    urls: dict[str, None] = {}
    for x in page.select("urlset url *"):
        if x.tag == "loc":
            t = own_text(x).strip(WHITE)
        elif alternates and (x.tag == "link" or x.tag.endswith(":link")):
            t = x.attrs.get("href", "").strip(WHITE)
        else:
            continue
        if t:
            urls.setdefault(t)
    return list(urls), []


_SITEMAP = re.compile(r"\ufeff*\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:urlset|sitemapindex)", re.I | re.S)


def looks_like_sitemap(text: str) -> bool:
    """Whether the root element, after a prolog and comments, is a sitemap's."""
    return _SITEMAP.match(text) is not None


def is_robots(url: str) -> bool:
    u = U.parsed(url)
    return u is not None and u.path.endswith("/robots.txt")


def absolute(base: str, link: str) -> str | None:
    for against in (None, U.parsed(base)):
        try:
            return str(U.parse(link, against))
        except ValueError:
            continue
    return None


robots_sitemaps = robots.sitemaps

# ---- shop catalogues ----

PAGE_LIMIT = 250


@dataclass(frozen=True)
class Shop:
    """A store by its host (with a port, if it has one)."""

    host: str

    @classmethod
    def of(cls, target: str) -> Shop:
        u = U.parsed(target if "://" in target else "https://" + target.rstrip("/"))
        return cls((f"{u.host}:{u.port}" if u.port is not None else u.host) if u and u.host else target.strip())

    def collections_url(self, page: int = 1) -> str:
        return f"https://{self.host}/collections.json?page={page}&limit={PAGE_LIMIT}"

    def products_url(self, handle: str, page: int = 1) -> str:
        return f"https://{self.host}/collections/{handle}/products.json?page={page}&limit={PAGE_LIMIT}"

    def product_url(self, handle: str, product: str) -> str:
        return f"https://{self.host}/collections/{handle}/products/{product}"

    def parse(self, url: str, body: str) -> tuple[list[dict], list[str]]:
        """(items, further URLs) of one response; a variant stands as often as pages show it (see first_variants)."""
        u = U.parsed(url)
        try:
            data = json.loads(body)
        except ValueError:
            return [], []
        if u is None or not isinstance(data, dict):
            return [], []
        page = next((int(v) for k, _, v in (p.partition("=") for p in (u.query or "").split("&")) if k == "page" and v.isdecimal()), 1)
        if u.path == "/collections.json":
            found = _list(data, "collections")
            if not found:
                return [], []
            return [], [*(self.products_url(c["handle"]) for c in found if isinstance(c.get("handle"), str) and _number(c.get("products_count")) > 0), self.collections_url(page + 1)]
        parts = u.path.split("/")[1:]
        if len(parts) >= 3 and parts[0] == "collections" and parts[2] == "products.json":
            handle = unquote(parts[1])
            products = _list(data, "products")
            return ([i for p in products for i in self.items(p, handle)], [self.products_url(handle, page + 1)]) if products else ([], [])
        return [], []

    def items(self, product: dict, handle: str) -> list[dict]:
        """An item for each variant of a product."""
        title, body = _text(product, "title"), product.get("body_html")
        description = all_text(Page(body).root, " ", True) if isinstance(body, str) else ""
        images = _list(product, "images")
        out = []
        for v in _list(product, "variants"):
            variant = _text(v, "title")
            before = v.get("compare_at_price")
            out.append(
                {
                    "name": f"{title} - {variant}" if variant and variant != "Default Title" else title,
                    "price": _given(v, "price"),
                    "category": title_case(handle.replace("-", " ")).strip(WHITE),
                    "brand": _text(product, "vendor"),
                    "identifier": v.get("id"),
                    "sku": _given(v, "sku"),
                    "stock": None if v.get("available") is True else 0,
                    "image_url": _text(images[0], "src") if images else "",
                    "url": self.product_url(handle, _text(product, "handle")),
                    "description": description,
                    "old_price": before if isinstance(before, str | int | float) and not isinstance(before, bool) and _number(before) != 0 else "",
                    "barcode": _given(v, "barcode"),
                }
            )
        return out


def first_variants(items: list[dict]) -> list[dict]:
    """Items without those whose identifier came before; items without one all stay."""
    seen: set[object] = set()
    return [i for i in items if i["identifier"] is None or not (i["identifier"] in seen or seen.add(i["identifier"]))]


def _list(data: dict, name: str) -> list[dict]:
    v = data.get(name)
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def _text(data: dict, name: str) -> str:
    v = data.get(name)
    return v if isinstance(v, str) else ""


def _given(data: dict, name: str) -> object:
    v = data.get(name)
    return "" if v is None else v


def _number(v: object) -> float:
    try:
        return float(v) if isinstance(v, str | int | float) else 0.0
    except ValueError:
        return 0.0
