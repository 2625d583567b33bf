"""Reading a parsed tree: text, serialisation, navigation, search, and the paths and fingerprints of elements."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from .css import Index, Query, compile_query, elements
from .html import COMMENT, DOCTYPE, DOCUMENT, PI, RAW, TEXT, VOID, Node, number, number_post, parse

#: Unicode White_Space; str.strip() also takes the separators U+001C to U+001F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Page:
    """A parsed document with its base URL and indexes."""

    def __init__(self, html: str | None, url: str = "") -> None:
        self.root, self.url = parse(html), url
        self._index: Index | None = None
        self._posted = False

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index(number(self.root))
        return self._index

    def posted(self) -> Node:
        """The root, once all nodes have their numbers in document order and in post-order."""
        if not self._posted:
            number_post(self.index.order)
            self._posted = True
        return self.root

    def select(self, query: str | Query, scope: Node | None = None) -> list[Node]:
        q = compile_query(query) if isinstance(query, str) else query
        return q.select(self.index, scope)

    def values(self, query: str | Query, scope: Node | None = None) -> list[str]:
        """The text, attribute or outer HTML of each match; empty texts and missing attributes are left out."""
        q = compile_query(query) if isinstance(query, str) else query
        found = q.select(self.index, scope)
        if q.want == "text":
            return [t for t in (all_text(x).rstrip(WHITE) for x in found) if t]
        if q.want == "attr":
            return [x.attrs[q.attr] for x in found if q.attr in x.attrs]
        return [outer_html(x) for x in found]

    def value(self, query: str | Query, scope: Node | None = None) -> str | None:
        found = self.values(query, scope)
        return found[0] if found else None


# ---- text ----


def texts(node: Node, ignore: frozenset[str] = frozenset()) -> Iterator[str]:
    """The text nodes under node, or its own data, in document order; subtrees of ignored tags are passed over."""
    if node.tag == TEXT:
        yield node.data
        return
    stack = [iter(node.kids)]
    while stack:
        for kid in stack[-1]:
            if kid.tag == TEXT:
                yield kid.data
            elif kid.kids and kid.tag not in ignore:
                stack.append(iter(kid.kids))
                break
        else:
            stack.pop()


def own_text(node: Node) -> str:
    """The text of the node's direct text children."""
    return node.data if node.tag == TEXT else "".join(k.data for k in node.kids if k.tag == TEXT)


def all_text(node: Node, separator: str = "", strip: bool = False, ignore: Iterable[str] = (), valid: Callable[[str], bool] | None = None) -> str:
    """Recursive text; strip trims each part and drops empty ones; valid decides by the trimmed part."""
    kids = node.kids
    if not strip and not ignore and valid is None and len(kids) == 1 and kids[0].tag == TEXT:
        return kids[0].data
    parts = []
    for t in texts(node, frozenset(ignore)):
        bare = t.strip(WHITE)
        if strip and not bare or valid is not None and not valid(bare):
            continue
        parts.append(bare if strip else t)
    return separator.join(parts)


def tight_text(node: Node) -> str:
    """Stripped parts joined without a separator: what searches and regular expressions run on."""
    return all_text(node, strip=True)


def tag_name(node: Node) -> str:
    return "html" if node.tag == DOCUMENT else node.tag


# ---- serialisation ----


def _escape(text: str, quote: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("\xa0", "&nbsp;")
    return text.replace('"', "&quot;") if quote else text.replace("<", "&lt;").replace(">", "&gt;")


def _write(node: Node, out: list[str]) -> None:
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == TEXT:
            raw = x.parent is not None and (x.parent.tag in RAW or x.parent.tag == "plaintext")
            out.append(x.data if raw else _escape(x.data))
        elif x.tag == COMMENT:
            out.append(f"<!--{x.data}-->")
        elif x.tag == DOCTYPE:
            out.append(f"<!DOCTYPE {x.data}>")
        elif x.tag == PI:
            out.append(f"<?{x.data}>")
        else:
            if x.tag != DOCUMENT:
                out.append(f"<{x.tag}{''.join(f' {k}="{_escape(v, True)}"' for k, v in x.attrs.items())}>")
                if x.tag in VOID:
                    continue
                stack.append(f"</{x.tag}>")
            stack += reversed(x.kids)


def outer_html(node: Node) -> str:
    out: list[str] = []
    _write(node, out)
    return "".join(out)


def inner_html(node: Node) -> str:
    out: list[str] = []
    for kid in node.kids:
        _write(kid, out)
    return "".join(out)


# ---- navigation ----


def parent(node: Node) -> Node | None:
    return node.parent


def siblings(node: Node) -> list[Node]:
    return [x for x in elements(node.parent) if x is not node] if node.parent is not None else []


def neighbour(node: Node, step: int) -> Node | None:
    """The element step places after (or before, if negative) node among its siblings."""
    if node.parent is None:
        return None
    row = elements(node.parent)
    k = next((i for i, x in enumerate(row) if x is node), -1) + step
    return row[k] if 0 <= k < len(row) else None


def has_class(node: Node, name: str) -> bool:
    return name in node.attrs.get("class", "").split()


def search_values(node: Node, keyword: str, partial: bool = False) -> list[tuple[str, str]]:
    return [(k, v) for k, v in node.attrs.items() if (keyword in v if partial else keyword == v)]


def walk(node: Node) -> Iterator[Node]:
    """Elements under node in document order, without node."""
    stack = list(reversed(node.kids))
    while stack:
        x = stack.pop()
        if x.tag[0] != "#":
            yield x
            stack += reversed(x.kids)


# ---- search by text ----


def text_matches(haystack: str, needle: str, partial: bool, case_sensitive: bool) -> bool:
    if not case_sensitive:
        haystack, needle = haystack.lower(), needle.lower()
    return needle in haystack if partial else haystack.strip(WHITE) == needle


def find_all_by_text(node: Node, text: str, partial: bool = False, case_sensitive: bool = True) -> list[Node]:
    """Elements in document order whose tight text matches, containers too."""
    return [x for x in walk(node) if text_matches(tight_text(x), text, partial, case_sensitive)]


def find_by_text(node: Node, text: str, first: bool = True, partial: bool = False, case_sensitive: bool = True) -> Node | None:
    """The first match of a deepest-first walk, or the last in document order; the tree has to be numbered (Page.posted)."""
    found = find_all_by_text(node, text, partial, case_sensitive)
    if not found:
        return None
    return min(found, key=lambda x: x.post) if first else found[-1]


def find_by_regex(node: Node, pattern: str, first: bool = True, case_sensitive: bool = True) -> Node | None:
    """The first match in document order (a container before what it holds), or the last; a bad pattern finds nothing."""
    try:
        p = re.compile(pattern, 0 if case_sensitive else re.I)
    except re.error:
        return None
    found = None
    for x in walk(node):
        if p.search(tight_text(x)):
            if first:
                return x
            found = x
    return found


# ---- paths ----


def nth_of_type(node: Node) -> int:
    """Place among siblings of the same tag, from 1; 0 if it is the only one."""
    row = [x for x in node.parent.kids if x.tag == node.tag] if node.parent is not None else [node]
    return next(i for i, x in enumerate(row, 1) if x is node) if len(row) > 1 else 0


def _css_id(value: str) -> str:
    return '[id="' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\a ") + '"]'


def css_path(node: Node, full: bool = False) -> str:
    """A selector of the element; the short form starts at the nearest id."""
    steps: list[str] = []
    while node is not None and node.tag[0] != "#":
        if node.tag == "html":
            break
        if "id" in node.attrs and not full:
            steps.append(_css_id(node.attrs["id"]))
            break
        n = nth_of_type(node)
        steps.append(f"{node.tag}:nth-of-type({n})" if n else node.tag)
        node = node.parent
    return " > ".join(reversed(steps))


def xpath_literal(value: str) -> str:
    if "'" not in value:
        return f"'{value}'"
    if '"' not in value:
        return f'"{value}"'
    return "concat(" + ", \"'\", ".join(f"'{part}'" for part in value.split("'")) + ")"


def xpath_path(node: Node, full: bool = False) -> str:
    steps: list[str] = []
    while node is not None and node.tag[0] != "#":
        if node.tag == "html":
            break
        if "id" in node.attrs and not full:
            steps.append(f"{node.tag}[@id={xpath_literal(node.attrs['id'])}]")
            break
        n = nth_of_type(node)
        steps.append(f"{node.tag}[{n}]" if n else node.tag)
        node = node.parent
    return "//" + "/".join(reversed(steps)) if steps else "/"


def tag_path(node: Node) -> list[str]:
    """Tags from the root element to node."""
    out = []
    while node is not None and node.tag[0] != "#":
        out.append(node.tag)
        node = node.parent
    return out[::-1]


def _kept(attrs: dict[str, str]) -> dict[str, str]:
    return {k: v.strip(WHITE) for k, v in attrs.items() if v.strip(WHITE)}


def element_data(node: Node) -> dict[str, object]:
    """The fingerprint by which an element is found again after a redesign."""
    up = node.parent if node.parent is not None and node.parent.tag[0] != "#" else None
    return {
        "tag": node.tag,
        "attributes": _kept(node.attrs),
        "text": own_text(node).strip(WHITE) or None,
        "path": tag_path(node),
        "parent_name": up.tag if up else None,
        "parent_attribs": dict(up.attrs) if up else {},
        "parent_text": (own_text(up).strip(WHITE) or None) if up else None,
        "siblings": [x.tag for x in siblings(node)] if up else [],
        "children": [x.tag for x in elements(node)],
    }
