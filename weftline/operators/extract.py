"""Extraction: CSS queries, nodes, links and searches over a table of pages.

Whatever is asked of a page is answered by one Arrow UDF call, hence one parse;
results are arrays that are exploded, so filters on other columns still reach
the scan.  A null html counts as an empty page.  Order is always a column (pos).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_type, batched, streamed
from ..kernel import dom
from ..kernel.css import compile_query
from ..kernel.dom import Page
from ..kernel.html import Node
from ..kernel.links import LinkRules

ATTRS = "array<struct<name: string, value: string>>"
NODE = f"struct<node_id: int, parent_id: int, post: int, depth: int, sib_pos: int, kind: string, tag: string, attrs: {ATTRS}, text: string>"
ELEMENT = f"struct<tag: string, attributes: {ATTRS}, text: string, path: array<string>, parent_name: string, parent_attribs: {ATTRS}, parent_text: string, siblings: array<string>, children: array<string>>"


@dataclass(frozen=True)
class Field:
    """What is wanted of a page: all values of a query, or the first; then a regular expression, cleaning."""

    query: str
    many: bool = False
    regex: str | None = None
    clean: bool = False

    def ddl(self) -> str:
        return "array<string>" if self.many else "string"

    def of(self, page: Page, scope: Node | None = None) -> object:
        from ..kernel import text as K

        q = compile_query(self.query)
        if self.regex is not None and not q.want:
            found = [v for x in page.select(q, scope) for v in K.regex_all(dom.tight_text(x), self.regex)]
        else:
            found = page.values(q, scope)
            if self.regex is not None:
                found = [v for t in found for v in K.regex_all(t, self.regex)]
        if self.clean:
            found = [K.clean(v) for v in found]
        return found if self.many else (found[0] if found else None)


def _field(f: str | Field) -> Field:
    return f if isinstance(f, Field) else Field(f)


def page_udf(fn: Callable[[Page], object], ddl: str, distinct: bool = False) -> Callable[[Column, Column], Column]:
    return batched(lambda html, url: fn(Page(html, url or "")), ddl, distinct)


def extract(pages: DataFrame, fields: Mapping[str, str | Field], html: str = "html", each: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """A column for each field; with each, a row (pos from 0) for every match of that query, and the fields are looked up below it.

    keep: columns to carry, all but html by default.  One parse a page, however many fields.
    """
    wanted = {name: _field(f) for name, f in fields.items()}
    row = f"struct<{', '.join(f'`{n}`: {f.ddl()}' for n, f in wanted.items())}>"
    carried = keep if keep is not None else [c for c in pages.columns if c != html]
    names = list(wanted)
    if each is None:
        kind = arrow_type(row)

        def run(h: pa.Array) -> pa.Array:
            rows = [[wanted[n].of(p) for n in names] for p in map(Page, h.to_pylist())]
            return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind.field(k).type) for k in range(len(names))], fields=[kind.field(k) for k in range(len(names))])

        got = F.arrow_udf(run, row)(F.col(html))
        return pages.withColumn("__got", got).select(*carried, *(F.col("__got")[n].alias(n) for n in names))
    scopes = compile_query(each)

    def below(p: Page) -> list[dict]:
        return [{n: f.of(p, x) for n, f in wanted.items()} for x in p.select(scopes)]

    got = page_udf(below, f"array<{row}>")(F.col(html), F.lit(""))
    return pages.select(*carried, F.posexplode(got).alias("pos", "__got")).select(*carried, "pos", *(F.col("__got")[n].alias(n) for n in names))


def values(pages: DataFrame, query: str, name: str = "value", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """keep, pos, value: every value of a query in document order."""
    carried = keep if keep is not None else [c for c in pages.columns if c != html]
    q = compile_query(query)
    got = page_udf(lambda p: p.values(q), "array<string>")(F.col(html), F.lit(""))
    return pages.select(*carried, F.posexplode(got).alias("pos", name))


def value_array(html: Column, query: str) -> Column:
    q = compile_query(query)
    return page_udf(lambda p: p.values(q), "array<string>")(html, F.lit(""))


def chained(pages: DataFrame, queries: list[str], html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Each query is run below every match of the one before, without removing repeats; the last one's values."""
    carried = keep if keep is not None else [c for c in pages.columns if c != html]
    compiled = [compile_query(q) for q in queries]

    def run(p: Page) -> list[str]:
        scopes: list[Node | None] = [None]
        for q in compiled[:-1]:
            scopes = [x for s in scopes for x in p.select(q, s)]
        return [v for s in scopes for v in p.values(compiled[-1], s)]

    return pages.select(*carried, F.posexplode(page_udf(run, "array<string>")(F.col(html), F.lit(""))).alias("pos", "value"))


def all_text(html: Column, query: str = "html", separator: str = "", strip: bool = False, ignore: tuple[str, ...] = (), valid: Callable[[str], bool] | None = None) -> Column:
    """Recursive text of the first match."""
    q = compile_query(query)

    def run(p: Page) -> str | None:
        found = p.select(q)
        return dom.all_text(found[0], separator, strip, ignore, valid) if found else None

    return page_udf(run, "string")(html, F.lit(""))


def _attrs(attrs: dict[str, str]) -> list[dict]:
    return [{"name": k, "value": v} for k, v in attrs.items()]


def _nodes(p: Page) -> list[dict]:
    out, stack = [], [(p.posted(), -1, 0, 0)]
    while stack:
        n, up, depth, place = stack.pop()
        out.append({"node_id": n.pre, "parent_id": up if up >= 0 else None, "post": n.post, "depth": depth, "sib_pos": place, "kind": n.tag[1:] if n.tag[0] == "#" else "element", "tag": dom.tag_name(n), "attrs": _attrs(n.attrs), "text": n.data if n.tag[0] == "#" and n.tag != "#document" else dom.own_text(n)})
        stack += [(k, n.pre, depth + 1, i) for i, k in reversed(list(enumerate(n.kids)))]
    return out


def nodes(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """A row for each node; node_id is its place in document order, post that in post-order.

    A node is below another of the same page if its node_id is larger and its post smaller.
    """
    carried = keep if keep is not None else [c for c in pages.columns if c not in (html, "url")]
    got = streamed(lambda h: _nodes(Page(h)), f"array<{NODE}>")(F.col(html))
    return pages.select(*carried, F.explode(got).alias("__n")).select(*carried, "__n.*")


def links(pages: DataFrame, rules: LinkRules = LinkRules(), html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """keep, pos, link: the kept URLs of each page in document order, each once a page."""
    carried = keep if keep is not None else [c for c in pages.columns if c != html]
    got = batched(lambda h, u: rules.extract_text(h, u or ""), "array<string>")(F.col(html), F.col(url))
    return pages.select(*carried, F.posexplode(got).alias("pos", "link"))


_FOUND = "struct<node_id: int, tag: string, text: string>"


def _found(n: Node | None) -> dict | None:
    return None if n is None else {"node_id": n.pre, "tag": n.tag, "text": dom.tight_text(n)}


def find_by_text(html: Column, text: str, first: bool = True, partial: bool = False, case_sensitive: bool = True) -> Column:
    return page_udf(lambda p: _found(dom.find_by_text(p.posted(), text, first, partial, case_sensitive)), _FOUND)(html, F.lit(""))


def find_all_by_text(html: Column, text: str, partial: bool = False, case_sensitive: bool = True) -> Column:
    return page_udf(lambda p: [_found(x) for x in dom.find_all_by_text(p.posted(), text, partial, case_sensitive)], f"array<{_FOUND}>")(html, F.lit(""))


def find_by_regex(html: Column, pattern: str, first: bool = True, case_sensitive: bool = True) -> Column:
    return page_udf(lambda p: _found(dom.find_by_regex(p.posted(), pattern, first, case_sensitive)), _FOUND)(html, F.lit(""))


@dataclass(frozen=True)
class Search:
    """One of several searches of a page: by text or pattern, for the first element, the last or (many) all by text."""

    wanted: str
    regex: bool = False
    first: bool = True
    many: bool = False
    partial: bool = False
    case_sensitive: bool = True

    def ddl(self) -> str:
        return f"array<{_FOUND}>" if self.many else _FOUND

    def of(self, page: Page) -> object:
        if self.many:
            return [_found(x) for x in dom.find_all_by_text(page.posted(), self.wanted, self.partial, self.case_sensitive)]
        if self.regex:
            return _found(dom.find_by_regex(page.posted(), self.wanted, self.first, self.case_sensitive))
        return _found(dom.find_by_text(page.posted(), self.wanted, self.first, self.partial, self.case_sensitive))


def searches(html: Column, asked: Mapping[str, Search]) -> Column:
    """A struct with a field for each search; one parse a page, however many."""
    row = f"struct<{', '.join(f'`{n}`: {s.ddl()}' for n, s in asked.items())}>"
    return page_udf(lambda p: {n: s.of(p) for n, s in asked.items()}, row, distinct=True)(html, F.lit(""))


def paths(pages: DataFrame, query: str, full: bool = False, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """keep, pos, css_path, xpath_path of every match."""
    carried = keep if keep is not None else [c for c in pages.columns if c != html]
    q = compile_query(query)
    got = page_udf(lambda p: [{"css_path": dom.css_path(x, full), "xpath_path": dom.xpath_path(x, full)} for x in p.select(q)], "array<struct<css_path: string, xpath_path: string>>")(F.col(html), F.lit(""))
    return pages.select(*carried, F.posexplode(got).alias("pos", "__p")).select(*carried, "pos", "__p.*")


def _element(n: Node) -> dict:
    d = dom.element_data(n)
    return d | {"attributes": _attrs(d["attributes"]), "parent_attribs": _attrs(d["parent_attribs"])}


def fingerprints(pages: DataFrame, query: str = "*", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """keep, pos, node_id, element: what each match is found again by."""
    carried = keep if keep is not None else [c for c in pages.columns if c != html]
    q = compile_query(query)
    got = page_udf(lambda p: [{"node_id": x.pre, "element": _element(x)} for x in p.select(q)], f"array<struct<node_id: int, element: {ELEMENT}>>")(F.col(html), F.lit(""))
    return pages.select(*carried, F.posexplode(got).alias("pos", "__e")).select(*carried, "pos", "__e.*")
