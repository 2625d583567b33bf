"""HTML text to a tree, after the tree-construction rules of the public HTML standard.

Tags are found by one regular expression whose parts never backtrack, and the
tree builder keeps the standard's stack of open elements and list of active
formatting elements: implied html, head and body, re-opened formatting, the
adoption agency, foster parenting, raw text, and tables.  Scripting counts as
enabled, so noscript holds text.  Contents of template stand in the tree as its
children.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5 as _NAMED

DOCUMENT, TEXT, COMMENT, DOCTYPE, PI = "#document", "#text", "#comment", "#doctype", "#pi"


class Node:
    """tag: lower-case name, or one of the kinds above; attrs: in document order; data: of text and comments."""

    __slots__ = ("tag", "attrs", "parent", "kids", "data", "foreign", "pre", "post", "last", "clear")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str = "", foreign: str = "") -> None:
        # pre, post and last are set when the tree is numbered; until then post is the place
        # on the stack at which a node was opened. clear: no p is open in button scope from here.
        self.tag = tag
        self.attrs = {} if attrs is None else attrs
        self.data = data
        self.foreign = foreign
        self.parent: Node | None = None
        self.kids: list[Node] = []

    @property
    def is_element(self) -> bool:
        return self.tag[0] != "#"


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


VOID = _set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
RAW = _set("iframe noembed noframes noscript script style xmp")
RCDATA = _set("title textarea")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
_IN_HEAD = _set("base basefont bgsound link meta noframes script style template title")
_BLOCKS = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul")
_CLOSES = _BLOCKS - {"p"} | _set("button listing pre")
_MARKED = _set("applet marquee object")
_TABLE_PARTS = _set("caption col colgroup frame head tbody td tfoot th thead tr")
_IMPLIED = _set("dd dt li optgroup option p rb rp rt rtc")
_SPECIAL = (
    _BLOCKS | HEADINGS | _MARKED | VOID - _set("basefont keygen") | _TABLE_PARTS | RAW - {"noscript"}
    | _set("basefont body button colgroup dd dt form frameset html keygen li listing noscript plaintext pre select table template textarea title")
)
_SCOPE = _set("applet caption html table td th marquee object template")
_BUTTON_SCOPE = _SCOPE | {"button"}
_LIST_SCOPE = _SCOPE | {"ol", "ul"}
_TABLE_SCOPE = _set("html table template")
_BREAKOUT = (FORMATTING - {"a"} | HEADINGS | _set("blockquote body br center dd div dl dt embed head hr img li listing menu meta ol p pre ruby span sub sup table ul var")) - {"font"}
_POINTS = _set("foreignobject desc title mi mo mn ms mtext annotation-xml")

#: Tags with rules of their own in the body; any other is inserted as it comes.
_RULED = _BLOCKS | FORMATTING | HEADINGS | _IN_HEAD | VOID | RAW | RCDATA | _MARKED | _TABLE_PARTS | _set("li dd dt image body html head pre listing form plaintext button table select optgroup option rb rtc rp rt math svg frameset")

ATTR = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+"""
_TOKEN = re.compile(rf"<(?:(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[\s/]*+{ATTR})*+)[\s/]*+>|/(?P<end>[A-Za-z][^\s/>]*+)[^>]*+>|!--(?P<comment>(?s:.*?))(?:--!?>|\Z)|!(?P<declaration>[^>]*+)>?|(?P<bogus>[?/][^>]*+)>?|(?P<odd>[A-Za-z]))")
_ATTRS = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_ODD_ATTRS = re.compile(r"""[\s/]*+(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_BLANK = re.compile(r"[\t\n\f\r ]*")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")
_RAW_END: dict[str, re.Pattern[str]] = {}


def _attribute_reference(m: re.Match[str]) -> str:
    """In attributes a named reference without its semicolon stays if a letter, digit or equals sign follows."""
    ref = m.group()
    if ref[1] == "#" or ref.endswith(";"):
        if ref.endswith(";") and ref[1] != "#" and ref[1:] not in _NAMED:
            return ref
        return unescape(ref)
    after = m.string[m.end() : m.end() + 1]
    return ref if after == "=" or ref[1:] not in _NAMED else unescape(ref)


def _value(text: str) -> str:
    return _REFERENCE.sub(_attribute_reference, text) if "&" in text else text


def attributes(text: str, pattern: re.Pattern[str] = _ATTRS) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in pattern.findall(text):
        if not name:
            continue
        name = name.lower()
        if name not in out:
            value = double or single or bare
            out[name] = _value(value) if "&" in value else value
    return out


def _odd_tag(html: str, at: int) -> tuple[str, dict[str, str], int] | None:
    """A start tag that the quick expression doesn't take, such as one with stray quotes; None at the end of the text."""
    m = re.compile(r"[^\s/>]+").match(html, at)
    name, at, parts = m.group().lower(), m.end(), at
    begin = at
    while at < len(html) and html[at] != ">":
        m = _ODD_ATTRS.match(html, at)
        at = m.end() if m.end() > at else at + 1
    return (name, attributes(html[begin:at], _ODD_ATTRS), at + 1) if at < len(html) else None


class Builder:
    def __init__(self) -> None:
        self.root = Node(DOCUMENT)
        self.open: list[Node] = []
        self.active: list[Node | None] = []
        self.html = self.head = self.form = None
        self.mode = "initial"
        self.template_modes: list[str] = []
        self.foster = False
        self.quirks = True
        self.skip_newline = False
        # Whether nodes on the stack may stand elsewhere than they were opened.
        self.shifted = False

    # ---- insertion ----

    def put(self, node: Node, parent: Node | None = None) -> Node:
        parent = parent or self.open[-1]
        if self.foster and parent.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag == "table":
                    table = self.open[k]
                    if table.parent is not None:
                        self.before(node, table)
                        return node
                    parent = self.open[k - 1]
                    break
            else:
                parent = self.open[0]
        node.parent = parent
        parent.kids.append(node)
        return node

    @staticmethod
    def before(node: Node, place: Node) -> None:
        kids = place.parent.kids
        k = next(i for i, x in enumerate(kids) if x is place)
        if node.tag == TEXT and k and kids[k - 1].tag == TEXT:
            kids[k - 1].data += node.data
            return
        node.parent = place.parent
        kids.insert(k, node)

    def insert(self, tag: str, attrs: dict[str, str], foreign: str = "") -> Node:
        node = Node(tag, attrs, foreign=foreign)
        if self.foster:
            self.put(node)
        else:
            parent = self.open[-1]
            node.parent = parent
            parent.kids.append(node)
        self.push(node)
        return node

    def push(self, node: Node) -> None:
        opened = self.open
        node.post = len(opened)
        node.clear = self._clear(node, opened[-1] if opened else None)
        opened.append(node)

    @staticmethod
    def _clear(node: Node, below: Node | None) -> bool:
        if not node.foreign:
            if node.tag == "p":
                return False
            if node.tag in _BUTTON_SCOPE:
                return True
        return below is None or below.clear

    def text(self, data: str) -> None:
        parent = self.open[-1]
        if self.foster and parent.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            self.put(Node(TEXT, data=data))
        elif parent.kids and parent.kids[-1].tag == TEXT:
            parent.kids[-1].data += data
        else:
            node = Node(TEXT, data=data)
            node.parent = parent
            parent.kids.append(node)

    def comment(self, data: str, parent: Node | None = None) -> None:
        node = Node(COMMENT, data=data)
        node.parent = parent or (self.open[-1] if self.open else self.root)
        node.parent.kids.append(node)

    # ---- the stack ----

    def in_scope(self, tag: str, stops: frozenset[str] = _SCOPE) -> bool:
        for node in reversed(self.open):
            if node.tag == tag and not node.foreign:
                return True
            if node.tag in stops and not node.foreign:
                return False
        return False

    def pop_until(self, *tags: str) -> None:
        # The root stays, whatever is asked for.
        while len(self.open) > 1:
            node = self.open.pop()
            if node.tag in tags and not node.foreign:
                return

    def imply(self, but: str = "") -> None:
        while self.open and self.open[-1].tag in _IMPLIED and self.open[-1].tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.open and not self.open[-1].clear:
            self.imply("p")
            self.pop_until("p")

    def clear_to(self, *tags: str) -> None:
        while self.open[-1].tag not in tags and self.open[-1].tag not in ("html", "template"):
            self.open.pop()

    # ---- active formatting ----

    def push_active(self, node: Node) -> None:
        same = 0
        for k in range(len(self.active) - 1, -1, -1):
            x = self.active[k]
            if x is None:
                break
            if x.tag == node.tag and x.attrs == node.attrs:
                same += 1
                if same == 3:
                    del self.active[k]
                    break
        self.active.append(node)

    def reopen(self) -> None:
        active = self.active
        if not active or active[-1] is None or self._opened(active[-1]):
            return
        k = len(active) - 1
        while k and active[k - 1] is not None and not self._opened(active[k - 1]):
            k -= 1
        for k in range(k, len(active)):
            active[k] = self.insert(active[k].tag, dict(active[k].attrs))

    def _opened(self, node: Node) -> bool:
        opened = self.open
        if node.post < len(opened) and opened[node.post] is node:
            return True
        return self.shifted and any(x is node for x in reversed(opened))

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _drop(self, items: list, node: Node | None) -> None:
        if self is not None and items is self.open:
            self.shifted = True
        for k in range(len(items) - 1, -1, -1):
            if items[k] is node:
                del items[k]
                return

    def _find(self, items: list, node: Node | None) -> int:
        return next((k for k in range(len(items) - 1, -1, -1) if items[k] is node), -1)

    def adopt(self, tag: str) -> None:
        """The adoption agency for an end tag of a formatting element."""
        top = self.open[-1]
        if top.tag == tag and self._find(self.active, top) < 0:
            self.open.pop()
            return
        for _ in range(8):
            element = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.tag == tag:
                    element = x
                    break
            if element is None:
                self.other_end(tag)
                return
            at = self._find(self.open, element)
            if at < 0:
                self._drop(self.active, element)
                return
            if not self._in_scope_node(element):
                return
            block = next((k for k in range(at + 1, len(self.open)) if self.open[k].tag in _SPECIAL and not self.open[k].foreign), -1)
            if block < 0:
                del self.open[at:]
                self._drop(self.active, element)
                return
            self.shifted = True
            furthest, ancestor = self.open[block], self.open[at - 1]
            mark = self._find(self.active, element)
            last, k, inner = furthest, block, 0
            while True:
                inner += 1
                k -= 1
                node = self.open[k]
                if node is element:
                    break
                where = self._find(self.active, node)
                if inner > 3 and where >= 0:
                    del self.active[where]
                    if where < mark:
                        mark -= 1
                    where = -1
                if where < 0:
                    del self.open[k]
                    continue
                new = Node(node.tag, dict(node.attrs))
                new.post, new.clear = k, self.open[k - 1].clear
                self.active[where] = self.open[k] = new
                if last is furthest:
                    mark = where + 1
                self._move(last, new)
                last = new
            if ancestor.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                if last.parent is not None:
                    self._unlink(last)
                was, self.foster = self.foster, True
                self.put(last, ancestor)
                self.foster = was
            else:
                self._move(last, ancestor)
            new = Node(element.tag, dict(element.attrs))
            for kid in furthest.kids:
                kid.parent = new
            new.kids, furthest.kids = furthest.kids, [new]
            new.parent = furthest
            where = self._find(self.active, element)
            if 0 <= where < mark:
                mark -= 1
            self._drop(self.active, element)
            self.active.insert(mark, new)
            self._drop(self.open, element)
            where = self._find(self.open, furthest) + 1
            new.post, new.clear = where, furthest.clear
            self.open.insert(where, new)

    def _in_scope_node(self, target: Node) -> bool:
        for node in reversed(self.open):
            if node is target:
                return True
            if node.tag in _SCOPE and not node.foreign:
                return False
        return False

    @staticmethod
    def _unlink(node: Node) -> None:
        if node.parent is not None:
            Builder._drop(None, node.parent.kids, node)
            node.parent = None

    def _move(self, node: Node, parent: Node) -> None:
        self._unlink(node)
        node.parent = parent
        parent.kids.append(node)

    def other_end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            node = self.open[k]
            if node.tag == tag:
                self.imply(tag)
                del self.open[k:]
                return
            if node.tag in _SPECIAL and not node.foreign:
                return

    # ---- tokens ----

    def characters(self, data: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            if data[0] == "\n":
                data = data[1:]
        data = data.replace("\0", "") if "\0" in data else data
        if not data:
            return
        mode = self.mode
        if mode == "body":
            if self.active:
                self.reopen()
            parent = self.open[-1]
            if parent.kids and parent.kids[-1].tag == TEXT:
                parent.kids[-1].data += data
            else:
                node = Node(TEXT, None, data)
                node.parent = parent
                parent.kids.append(node)
            return
        blank = _BLANK.match(data).end()
        if mode in ("initial", "before html", "before head"):
            if blank == len(data):
                return
            data, blank = data[blank:], 0
            self._to_head()
            mode = self.mode
        if mode in ("head", "after head"):
            if blank:
                self.text(data[:blank])
                data = data[blank:]
            if data:
                self._to_body()
                self.characters(data)
        elif mode in ("table", "tbody", "row"):
            if blank == len(data):
                self.text(data)
            else:
                self.foster = True
                self.reopen()
                self.text(data)
                self.foster = False
        elif mode == "colgroup":
            if blank:
                self.text(data[:blank])
                data = data[blank:]
            if data and self._end_colgroup():
                self.characters(data)
        elif mode == "select":
            self.text(data)
        elif mode == "after body":
            if blank < len(data):
                self.mode = "body"
            self.reopen()
            self.text(data)
        else:
            self.reopen()
            self.text(data)

    def _to_html(self) -> None:
        if self.html is None:
            self.html = Node("html")
            self.html.parent = self.root
            self.root.kids.append(self.html)
            self.push(self.html)
        self.mode = "before head"

    def _to_head(self) -> None:
        if self.mode in ("initial", "before html"):
            self._to_html()
        if self.mode == "before head":
            self.head = self.insert("head", {})
            self.mode = "head"

    def _to_body(self) -> None:
        self._to_head()
        if self.mode == "head":
            self.pop_until("head")
            self.mode = "after head"
        if self.mode == "after head":
            self.insert("body", {})
            self.mode = "body"

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> str:
        """Returns the tag whose raw text follows, or nothing."""
        self.skip_newline = False
        if self.open and self.open[-1].foreign and (out := self._foreign_start(tag, attrs, closed)) is not None:
            return out
        mode = self.mode
        if mode in ("initial", "before html"):
            if tag == "html":
                self._to_html()
                self.html.attrs.update(attrs)
                return ""
            self._to_html()
            mode = self.mode
        if tag == "html":
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return ""
        if mode == "before head":
            if tag == "head":
                self.head = self.insert("head", attrs)
                self.mode = "head"
                return ""
            self._to_head()
            mode = self.mode
        if mode == "head":
            if tag == "head":
                return ""
            if tag in _IN_HEAD or tag == "noscript":
                return self._in_head(tag, attrs)
            self.pop_until("head")
            self.mode = mode = "after head"
        if mode == "after head":
            if tag == "body":
                self.insert("body", attrs)
                self.mode = "body"
                return ""
            if tag == "head":
                return ""
            if tag in _IN_HEAD:
                self.push(self.head)
                out = self._in_head(tag, attrs)
                self._drop(self.open, self.head)
                return out
            if tag == "frameset":
                self.insert(tag, attrs)
                self.mode = "body"
                return ""
            self._to_body()
            mode = "body"
        if mode == "after body":
            self.mode = mode = "body"
        if mode == "body":
            return self._body_start(tag, attrs, closed)
        return self._table_start(tag, attrs, closed)

    def _in_head(self, tag: str, attrs: dict[str, str]) -> str:
        node = self.insert(tag, attrs)
        if tag in VOID:
            self.open.pop()
            return ""
        if tag == "template":
            self.active.append(None)
            self.template_modes.append(self.mode)
            self.mode = "body"
            return ""
        return node.tag

    def _body_start(self, tag: str, attrs: dict[str, str], closed: bool) -> str:
        if tag in _BLOCKS:
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "a":
            for x in reversed(self.active):
                if x is None:
                    break
                if x.tag == "a":
                    self.adopt("a")
                    self._drop(self.active, x)
                    self._drop(self.open, x)
                    break
            self.reopen()
            self.push_active(self.insert(tag, attrs))
        elif tag == "li" or tag in ("dd", "dt"):
            own = (tag,) if tag == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.tag in own:
                    self.imply(node.tag)
                    self.pop_until(node.tag)
                    break
                if node.tag in _SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
        elif tag in FORMATTING:
            if tag == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
            self.reopen()
            self.push_active(self.insert(tag, attrs))
        elif tag in HEADINGS:
            self.close_p()
            if self.open[-1].tag in HEADINGS:
                self.open.pop()
            self.insert(tag, attrs)
        elif tag in _IN_HEAD:
            return self._in_head(tag, attrs)
        elif tag in VOID:
            if tag in ("col", "frame"):
                return ""
            if tag == "hr":
                self.close_p()
            elif tag not in ("param", "source", "track"):
                self.reopen()
            self.insert(tag, attrs)
            self.open.pop()
        elif tag == "image":
            return self._body_start("img", attrs, closed)
        elif tag == "body":
            if len(self.open) > 1 and self.open[1].tag == "body":
                for k, v in attrs.items():
                    self.open[1].attrs.setdefault(k, v)
        elif tag in ("pre", "listing"):
            self.close_p()
            self.insert(tag, attrs)
            self.skip_newline = True
        elif tag == "form":
            if self.form is None or any(x.tag == "template" for x in self.open):
                self.close_p()
                self.form = self.insert(tag, attrs)
        elif tag == "plaintext":
            self.close_p()
            self.insert(tag, attrs)
            return tag
        elif tag == "button":
            if self.in_scope("button"):
                self.imply()
                self.pop_until("button")
            self.reopen()
            self.insert(tag, attrs)
        elif tag in _MARKED:
            self.reopen()
            self.insert(tag, attrs)
            self.active.append(None)
        elif tag == "table":
            if not self.quirks:
                self.close_p()
            self.insert(tag, attrs)
            self.mode = "table"
        elif tag == "textarea":
            self.insert(tag, attrs)
            self.skip_newline = True
            return tag
        elif tag in RAW:
            if tag == "xmp":
                self.close_p()
                self.reopen()
            self.insert(tag, attrs)
            return tag
        elif tag == "select":
            self.reopen()
            self.insert(tag, attrs)
            self.mode = "select"
        elif tag in ("optgroup", "option"):
            if self.open[-1].tag == "option":
                self.open.pop()
            self.reopen()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.imply("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        elif tag in ("math", "svg"):
            self.reopen()
            self.insert(tag, attrs, foreign=tag)
            if closed:
                self.open.pop()
        elif tag in _TABLE_PARTS or tag == "frameset":
            pass
        else:
            if self.active:
                self.reopen()
            self.insert(tag, attrs)
        return ""

    def _foreign_start(self, tag: str, attrs: dict[str, str], closed: bool) -> str | None:
        top = self.open[-1]
        if top.tag in _POINTS and tag not in ("mglyph", "malignmark"):
            return None
        if tag in _BREAKOUT or (tag == "font" and set(attrs) & {"color", "face", "size"}):
            while self.open[-1].foreign and self.open[-1].tag not in _POINTS:
                self.open.pop()
            return None
        self.insert(tag, attrs, foreign=top.foreign)
        if closed:
            self.open.pop()
        return ""

    def _end_colgroup(self) -> bool:
        if self.open[-1].tag != "colgroup":
            return False
        self.open.pop()
        self.mode = "table"
        return True

    def _close_cell(self) -> None:
        self.imply()
        self.pop_until("td", "th")
        self.clear_active()
        self.mode = "row"

    def _table_start(self, tag: str, attrs: dict[str, str], closed: bool) -> str:
        mode = self.mode
        if mode == "select":
            if tag in ("option", "optgroup"):
                if self.open[-1].tag == "option":
                    self.open.pop()
                if tag == "optgroup" and self.open[-1].tag == "optgroup":
                    self.open.pop()
                self.insert(tag, attrs)
            elif tag == "hr":
                while self.open[-1].tag in ("option", "optgroup"):
                    self.open.pop()
                self.insert(tag, attrs)
                self.open.pop()
            elif tag in ("select", "input", "keygen", "textarea") or (tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th") and self._select_in_table()):
                self.pop_until("select")
                self._reset_mode()
                if tag != "select":
                    return self.start(tag, attrs, closed)
            elif tag in ("script", "template"):
                return self._in_head(tag, attrs)
            return ""
        if mode in ("cell", "caption"):
            if tag in _set("caption col colgroup tbody td tfoot th thead tr"):
                if mode == "cell":
                    if not (self.in_scope("td", _TABLE_SCOPE) or self.in_scope("th", _TABLE_SCOPE)):
                        return ""
                    self._close_cell()
                else:
                    if not self.in_scope("caption", _TABLE_SCOPE):
                        return ""
                    self.imply()
                    self.pop_until("caption")
                    self.clear_active()
                    self.mode = "table"
                return self._table_start(tag, attrs, closed)
            return self._body_start(tag, attrs, closed)
        if mode == "colgroup":
            if tag == "col":
                self.insert(tag, attrs)
                self.open.pop()
                return ""
            return self.start(tag, attrs, closed) if self._end_colgroup() else ""
        if mode == "row":
            if tag in ("td", "th"):
                self.clear_to("tr")
                self.insert(tag, attrs)
                self.mode = "cell"
                self.active.append(None)
                return ""
            if tag in _set("caption col colgroup tbody tfoot thead tr"):
                if not self.in_scope("tr", _TABLE_SCOPE):
                    return ""
                self.clear_to("tr")
                self.open.pop()
                self.mode = mode = "tbody"
        if mode == "tbody":
            if tag == "tr":
                self.clear_to("tbody", "tfoot", "thead")
                self.insert(tag, attrs)
                self.mode = "row"
                return ""
            if tag in ("td", "th"):
                self.clear_to("tbody", "tfoot", "thead")
                self.insert("tr", {})
                self.mode = "row"
                return self._table_start(tag, attrs, closed)
            if tag in _set("caption col colgroup tbody tfoot thead"):
                if not any(self.in_scope(t, _TABLE_SCOPE) for t in ("tbody", "thead", "tfoot")):
                    return ""
                self.clear_to("tbody", "tfoot", "thead")
                self.open.pop()
                self.mode = mode = "table"
        if tag == "caption" and mode == "table":
            self.clear_to("table")
            self.active.append(None)
            self.insert(tag, attrs)
            self.mode = "caption"
        elif tag in ("colgroup", "col") and mode == "table":
            self.clear_to("table")
            self.insert("colgroup", attrs if tag == "colgroup" else {})
            self.mode = "colgroup"
            if tag == "col":
                return self._table_start(tag, attrs, closed)
        elif tag in ("tbody", "tfoot", "thead") and mode == "table":
            self.clear_to("table")
            self.insert(tag, attrs)
            self.mode = "tbody"
        elif tag in ("td", "th", "tr") and mode == "table":
            self.clear_to("table")
            self.insert("tbody", {})
            self.mode = "tbody"
            return self._table_start(tag, attrs, closed)
        elif tag == "table":
            if self.in_scope("table", _TABLE_SCOPE):
                self.pop_until("table")
                self._reset_mode()
                return self.start(tag, attrs, closed)
        elif tag in ("style", "script", "template"):
            return self._in_head(tag, attrs)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.insert(tag, attrs)
            self.open.pop()
        elif tag == "form":
            if self.form is None:
                self.form = self.insert(tag, attrs)
                self.open.pop()
        else:
            self.foster = True
            was = self.mode
            out = self._body_start(tag, attrs, closed)
            self.foster = False
            if self.mode == "body":
                self.mode = was
            return out
        return ""

    def _select_in_table(self) -> bool:
        return any(x.tag == "table" for x in self.open)

    def _reset_mode(self) -> None:
        for node in reversed(self.open):
            mode = {"select": "select", "td": "cell", "th": "cell", "tr": "row", "tbody": "tbody", "thead": "tbody", "tfoot": "tbody", "caption": "caption", "colgroup": "colgroup", "table": "table", "template": "body", "head": "head", "body": "body"}.get(node.tag)
            if mode:
                self.mode = mode
                return
        self.mode = "body"

    def end(self, tag: str) -> None:
        self.skip_newline = False
        if self.open and self.open[-1].foreign and tag not in ("p", "br"):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    return
                if not self.open[k].foreign:
                    break
        mode = self.mode
        if mode in ("initial", "before html", "before head"):
            if tag not in ("head", "body", "html", "br"):
                return
            self._to_head()
            mode = self.mode
        if mode == "head":
            if tag == "head":
                self.pop_until("head")
                self.mode = "after head"
                return
            if tag == "template":
                self._end_template()
                return
            if tag not in ("body", "html", "br"):
                return
            self._to_body()
        elif mode == "after head":
            if tag not in ("body", "html", "br"):
                return
            self._to_body()
        if self.mode == "after body":
            if tag in ("html", "body"):
                return
            self.mode = "body"
        if self.mode == "body":
            self._body_end(tag)
        else:
            self._table_end(tag)

    def _end_template(self) -> None:
        if any(x.tag == "template" and not x.foreign for x in self.open):
            self.imply()
            self.pop_until("template")
            self.clear_active()
            self.mode = self.template_modes.pop() if self.template_modes else "body"

    def _body_end(self, tag: str) -> None:
        top = self.open[-1]
        if top.tag == tag and not top.foreign and len(self.open) > 2:
            # The common case, in which all of the rules below come to this.
            if tag in FORMATTING:
                if self.active and self.active[-1] is top:
                    self.active.pop()
                    self.open.pop()
                    return
            elif tag in _CLOSES or tag == "p" or tag == "li" or tag in HEADINGS or tag not in _SPECIAL:
                self.open.pop()
                return
        if tag == "p":
            if top.clear:
                self.insert("p", {})
            self.imply("p")
            self.pop_until("p")
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in _CLOSES:
            if self.in_scope(tag):
                self.imply()
                self.pop_until(tag)
        elif tag == "li":
            if self.in_scope(tag, _LIST_SCOPE):
                self.imply(tag)
                self.pop_until(tag)
        elif tag in ("dd", "dt"):
            if self.in_scope(tag):
                self.imply(tag)
                self.pop_until(tag)
        elif tag in HEADINGS:
            if any(self.in_scope(h) for h in HEADINGS):
                self.imply()
                self.pop_until(*HEADINGS)
        elif tag in ("body", "html"):
            if self.in_scope("body"):
                self.mode = "after body"
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and self._in_scope_node(node):
                self.imply()
                self._drop(self.open, node)
        elif tag in _MARKED:
            if self.in_scope(tag):
                self.imply()
                self.pop_until(tag)
                self.clear_active()
        elif tag == "br":
            self.reopen()
            self.insert("br", {})
            self.open.pop()
        elif tag == "template":
            self._end_template()
        else:
            self.other_end(tag)

    def _table_end(self, tag: str) -> None:
        mode = self.mode
        if mode == "select":
            if tag == "optgroup":
                if self.open[-1].tag == "option" and len(self.open) > 1 and self.open[-2].tag == "optgroup":
                    self.open.pop()
                if self.open[-1].tag == "optgroup":
                    self.open.pop()
            elif tag == "option":
                if self.open[-1].tag == "option":
                    self.open.pop()
            elif tag == "select" or (tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th") and self._select_in_table() and self.in_scope(tag, _TABLE_SCOPE)):
                self.pop_until("select")
                self._reset_mode()
                if tag != "select":
                    self.end(tag)
            return
        if mode == "cell":
            if tag in ("td", "th"):
                if self.in_scope(tag, _TABLE_SCOPE):
                    self.imply()
                    self.pop_until(tag)
                    self.clear_active()
                    self.mode = "row"
            elif tag in ("table", "tbody", "tfoot", "thead", "tr"):
                if self.in_scope(tag, _TABLE_SCOPE):
                    self._close_cell()
                    self.end(tag)
            elif tag not in _set("body caption col colgroup html"):
                self._body_end(tag)
            return
        if mode == "caption":
            if tag in ("caption", "table"):
                if self.in_scope("caption", _TABLE_SCOPE):
                    self.imply()
                    self.pop_until("caption")
                    self.clear_active()
                    self.mode = "table"
                    if tag == "table":
                        self.end(tag)
            elif tag not in _set("body col colgroup html tbody td tfoot th thead tr"):
                self._body_end(tag)
            return
        if mode == "colgroup":
            if tag == "colgroup":
                self._end_colgroup()
            elif tag != "col" and self._end_colgroup():
                self.end(tag)
            return
        if mode == "row" and tag in ("tr", "table", "tbody", "tfoot", "thead"):
            if self.in_scope("tr", _TABLE_SCOPE) and (tag in ("tr", "table") or self.in_scope(tag, _TABLE_SCOPE)):
                self.clear_to("tr")
                self.open.pop()
                self.mode = "tbody"
                if tag != "tr":
                    self.end(tag)
            return
        if mode == "tbody" and tag in ("tbody", "tfoot", "thead", "table"):
            if tag != "table" and not self.in_scope(tag, _TABLE_SCOPE):
                return
            self.clear_to("tbody", "tfoot", "thead")
            if self.open[-1].tag in ("tbody", "tfoot", "thead"):
                self.open.pop()
            self.mode = "table"
            if tag == "table":
                self.end(tag)
            return
        if tag == "table":
            if self.in_scope("table", _TABLE_SCOPE):
                self.pop_until("table")
                self._reset_mode()
        elif tag == "template":
            self._end_template()
        elif tag not in _set("body caption col colgroup html tbody td tfoot th thead tr"):
            self.foster = True
            self._body_end(tag)
            self.foster = False

    def doctype(self, declaration: str) -> None:
        if self.mode == "initial":
            name = declaration[7:].strip().split(None, 1)
            node = Node(DOCTYPE, data=name[0].lower() if name else "")
            node.parent = self.root
            self.root.kids.append(node)
            self.quirks = not name or name[0].lower() != "html"
            self.mode = "before html"


def _raw_end(tag: str) -> re.Pattern[str]:
    if tag not in _RAW_END:
        _RAW_END[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)
    return _RAW_END[tag]


def _go_on(b: Builder, html: str, at: int) -> None:
    """Builds from a place on, token by token."""
    n, search, opened = len(html), _TOKEN.search, b.open
    while at < n:
        m = search(html, at)
        begin = m.start() if m else n
        if begin > at:
            data = html[at:begin]
            b.characters(unescape(data) if "&" in data else data)
        if not m:
            break
        at = m.end()
        kind = m.lastindex
        if kind <= 2:
            name, attrs = m.group(1, 2)
            if not name.islower():
                name = name.lower()
            values = attributes(attrs) if attrs else {}
            if b.mode == "body" and not opened[-1].foreign and (name in _BLOCKS or name not in _RULED):
                # The most frequent rules, without the calls.
                if name in _BLOCKS:
                    b.close_p()
                elif b.active:
                    b.reopen()
                b.skip_newline = False
                b.insert(name, values)
                continue
            follow = b.start(name, values, html[at - 2] == "/" and not attrs.endswith("/"))
        elif kind == 3:
            name = m.group(3)
            b.end(name if name.islower() else name.lower())
            continue
        elif kind == 4:
            b.comment(m.group(4), b.html if b.mode == "after body" else None)
            continue
        elif kind == 5:
            text = m.group(5)
            if text[:7].lower() == "doctype":
                b.doctype(text)
            elif b.open and b.open[-1].foreign and text.startswith("[CDATA["):
                stop = html.find("]]>", m.start())
                b.characters(html[m.start() + 9 : stop if stop >= 0 else n] or "\0")
                at = stop + 3 if stop >= 0 else n
            else:
                b.comment(text)
            continue
        elif kind == 6:
            if (text := m.group(6)) != "/":
                b.comment(text.lstrip("/") if text[0] == "/" else text)
            continue
        else:
            found = _odd_tag(html, m.start() + 1)
            if found is None:
                break
            name, attrs, at = found
            follow = b.start(name, attrs, html[at - 2] == "/")
        if follow:
            if follow == "plaintext":
                b.text(html[at:])
                break
            stop = _raw_end(follow).search(html, at)
            data = html[at : stop.start() if stop else n]
            at = stop.end() if stop else n
            if b.skip_newline:
                b.skip_newline = False
                data = data.removeprefix("\n")
            if data:
                b.text(unescape(data) if follow in RCDATA and "&" in data else data)
            b.open.pop()


#: A text cut at all of its tokens: text, token, name and attributes of a start tag, name of an end tag, text and so on.
_CUTS = re.compile(rf"(<(?:([A-Za-z][^\s/>]*+)((?:[\s/]*+{ATTR})*+)[\s/]*+>|/([A-Za-z][^\s/>]*+)[^>]*+>|!--(?s:.*?)(?:--!?>|\Z)|![^>]*+>?|[?/][^>]*+>?|[A-Za-z]))")
#: How frequent start tags are handled in the body: 1 closes p, 2 is inserted as it comes, 3 is a heading, 4 is formatting.
_START = dict.fromkeys(_BLOCKS, 1) | dict.fromkeys(HEADINGS, 3) | dict.fromkeys(FORMATTING - {"nobr"}, 4)
_START |= dict.fromkeys(_RULED - set(_START), 0) | dict.fromkeys("abbr bdi bdo cite data del dfn figcaption ins kbd label map mark output picture progress q ruby samp slot span sub sup time var video".split(), 2) | dict.fromkeys(_BLOCKS, 1)
#: End tags that, when they name the innermost element, close it alone: 1, or with its entry among the active ones: 2.
_END = dict.fromkeys(_CLOSES | HEADINGS | {"p", "li"}, 1) | dict.fromkeys(FORMATTING, 2) | {k: 1 for k, v in _START.items() if v == 2}


def parse(html: str | None) -> Node:
    """The document node of a tree that isn't numbered yet (see number).

    The text is cut at its tokens at once, and the frequent ones are handled here; what
    makes the cuts wrong (raw text that a token runs out of, and the like) is left to _go_on.
    """
    html = html or ""
    if "\r" in html:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
    b = Builder()
    parts = _CUTS.split(html)
    opened, active, last = b.open, b.active, len(parts) - 1
    known: dict[str, dict[str, str]] = {"": {}}
    start, end, new = _START.get, _END.get, Node.__new__
    i = base = begin = 0  # begin: where parts[base] begins
    while True:
        data = parts[i]
        if data:
            if b.mode != "body" or b.skip_newline or "\0" in data:
                b.characters(unescape(data) if "&" in data else data)
            else:
                if "&" in data:
                    data = unescape(data)
                    if "\0" in data:
                        data = data.replace("\0", "")
                if active:
                    b.reopen()
                parent = opened[-1]
                kids = parent.kids
                if kids and kids[-1].tag == TEXT:
                    kids[-1].data += data
                else:
                    node = new(Node)
                    node.tag, node.attrs, node.data, node.foreign, node.parent, node.kids = TEXT, {}, data, "", parent, []
                    kids.append(node)
        if i == last:
            break
        name = parts[i + 2]
        if name is not None:
            text = parts[i + 3]
            attrs = known.get(text)
            if attrs is None:
                attrs = attributes(text)
                if len(known) < 1000:
                    known[text] = attrs
            kind = start(name)
            if kind is None:
                name = name.lower()
                kind = start(name, 2)
            if kind and b.mode == "body" and not (parent := opened[-1]).foreign and (kind < 4 or not active):
                if kind == 2:
                    if active:
                        b.reopen()
                        parent = opened[-1]
                elif kind < 4:
                    if not parent.clear:
                        b.close_p()
                        parent = opened[-1]
                    if kind == 3 and parent.tag in HEADINGS:
                        opened.pop()
                        parent = opened[-1]
                b.skip_newline = False
                node = new(Node)
                node.tag, node.attrs, node.data, node.foreign, node.parent, node.kids = name, attrs, "", "", parent, []
                node.clear = parent.clear and name != "p"
                parent.kids.append(node)
                if kind == 4:
                    node.post = len(opened)
                    active.append(node)
                opened.append(node)
                i += 5
                continue
            token = parts[i + 1]
            follow = b.start(name, dict(attrs), token[-2] == "/" and not text.endswith("/"))
            if follow:
                at = begin + sum(map(len, parts[base : i + 1 : 5])) + sum(map(len, parts[base + 1 : i + 2 : 5]))
                if follow == "plaintext":
                    b.text(html[at:])
                    break
                stop = _raw_end(follow).search(html, at)
                data = html[at : stop.start() if stop else len(html)]
                if b.skip_newline:
                    b.skip_newline = False
                    data = data.removeprefix("\n")
                if data:
                    b.text(unescape(data) if follow in RCDATA and "&" in data else data)
                b.open.pop()
                to = stop.end() if stop else len(html)
                # Tokens within the raw text are passed over.
                i += 5
                while to > at + len(parts[i]) and i < last:
                    at += len(parts[i]) + len(parts[i + 1])
                    i += 5
                if at > to:
                    _go_on(b, html, to)
                    break
                parts[i] = parts[i][to - at :]
                base, begin = i, to
                continue
            i += 5
            continue
        name = parts[i + 4]
        if name is not None:
            top = opened[-1] if opened else None
            if top is not None and top.tag == name and b.mode == "body" and not top.foreign and len(opened) > 2:
                kind = end(name)
                if kind == 1:
                    b.skip_newline = False
                    opened.pop()
                    i += 5
                    continue
                if kind == 2 and active and active[-1] is top:
                    b.skip_newline = False
                    opened.pop()
                    active.pop()
                    i += 5
                    continue
            b.end(name if name.islower() else name.lower())
            i += 5
            continue
        token = parts[i + 1]
        if token.startswith("<!--"):
            b.comment(_TOKEN.match(token).group(4), b.html if b.mode == "after body" else None)
            i += 5
            continue
        # Declarations, and what is no tag after all.
        at = begin + sum(map(len, parts[base : i + 1 : 5])) + sum(map(len, parts[base + 1 : i + 1 : 5]))
        if token[:9].lower() == "<!doctype":
            b.doctype(_TOKEN.match(token).group(5))
            i += 5
            continue
        _go_on(b, html, at)
        break
    b._to_body()
    return b.root


def number(root: Node) -> list[Node]:
    """Numbers the nodes in document order (pre) and returns them so."""
    order: list[Node] = []
    put, stack, n = order.append, [root], 0
    pop, push = stack.pop, stack.append
    while stack:
        node = pop()
        node.pre = n
        n += 1
        put(node)
        if kids := node.kids:
            if len(kids) == 1:
                push(kids[0])
            else:
                stack += kids[::-1]
    return order


def number_post(order: list[Node]) -> None:
    """Numbers nodes in post-order (post): a node's place is after all that end before it does."""
    # A node ends after its descendants and before all that begin later, so post = pre + descendants - ancestors.
    below = [0] * len(order)
    for node in reversed(order):
        if node.parent is not None:
            below[node.parent.pre] += below[node.pre] + 1
    depth = [0] * len(order)
    for node in order:
        if node.parent is not None:
            depth[node.pre] = depth[node.parent.pre] + 1
        node.post = node.pre + below[node.pre] - depth[node.pre]


def number_last(order: list[Node]) -> None:
    """Sets last: the number of each node's last descendant, or its own."""
    for node in reversed(order):
        node.last = node.kids[-1].last if node.kids else node.pre
