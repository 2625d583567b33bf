"""CSS selectors, compiled once to predicates over nodes and matched from right to left.

Type, universal, id, class and attribute selectors (all operators, with the i and
s flags), the four combinators, lists, and the pseudo-classes root, empty, first-,
last- and only-child and -of-type, nth-child, nth-last-child, nth-of-type,
nth-last-of-type (An+B), not, is, where and has.  A trailing ::text or
::attr(name) says what of each match is wanted.  Anything else is unknown and
gives a query without matches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from .html import TEXT, Node, number_last

Test = Callable[[Node], bool]
_IDENT = r"(?:--|-?(?:[A-Za-z_\u0080-\U0010ffff]|\\(?:[0-9a-fA-F]{1,6}\s?|[^\n0-9a-fA-F])))(?:[\w\u0080-\U0010ffff-]|\\(?:[0-9a-fA-F]{1,6}\s?|[^\n0-9a-fA-F]))*"
_NAME = re.compile(_IDENT)
_HASH = re.compile(rf"(?:[\w\u0080-\U0010ffff-]|\\(?:[0-9a-fA-F]{{1,6}}\s?|[^\n0-9a-fA-F]))+")
_ATTRIBUTE = re.compile(rf"""\s*(?:\*?\|)?({_IDENT})\s*(?:([~|^$*]?=)\s*(?:"((?:[^"\\\n]|\\(?s:.))*)"|'((?:[^'\\\n]|\\(?s:.))*)'|({_IDENT}))\s*([iIsS])?\s*)?\]""")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"\s*(?:(even|odd)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*", re.I)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|\n|((?s:.)))")


class Unknown(ValueError):
    """A selector that isn't understood."""


def _plain(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: (chr(int(m[1], 16)) if 0 < int(m[1], 16) < 0x110000 else "\ufffd") if m[1] else m[2] or "", text)


def elements(node: Node) -> list[Node]:
    return [k for k in node.kids if k.tag[0] != "#"]


def _position(node: Node, last: bool, typed: bool) -> int:
    kids = node.parent.kids if node.parent is not None else [node]
    count = 0
    for k in reversed(kids) if last else kids:
        if k.tag[0] != "#" and (not typed or k.tag == node.tag):
            count += 1
            if k is node:
                return count
    return count


def _nth(a: int, b: int, last: bool, typed: bool) -> Test:
    def test(node: Node) -> bool:
        d = _position(node, last, typed) - b
        return d == 0 if a == 0 else d % a == 0 and d // a >= 0

    return test


def _only(typed: bool) -> Test:
    return lambda node: _position(node, False, typed) == 1 and _position(node, True, typed) == 1


@dataclass
class Compound:
    """The tests of one compound; tag, id or cls name an index that holds all candidates."""

    tests: list[Test]
    tag: str = ""
    id: str = ""
    cls: str = ""

    def __call__(self, node: Node) -> bool:
        return all(t(node) for t in self.tests)


@dataclass
class Complex:
    """Compounds from right to left, each with the combinator that ties it to the one on its right."""

    right: Compound
    left: list[tuple[str, Compound]]

    def __post_init__(self) -> None:
        # An index of the only test needs no second look.
        self.plain = not self.left and len(self.right.tests) == 1 and bool(self.right.cls or self.right.tag or self.right.id)

    def matches(self, node: Node, scope: Node | None = None) -> bool:
        return self.right(node) and (not self.left or self._left(node, 0, scope))

    def _left(self, node: Node, k: int, scope: Node | None) -> bool:
        if k == len(self.left):
            return True
        how, test = self.left[k]
        if how == " ":
            up = node.parent
            while up is not None and up.tag[0] != "#":
                if test(up) and self._left(up, k + 1, scope):
                    return True
                up = up.parent
            return False
        if how == ">":
            up = node.parent
            return up is not None and up.tag[0] != "#" and test(up) and self._left(up, k + 1, scope)
        before: list[Node] = []
        for kid in node.parent.kids if node.parent is not None else ():
            if kid is node:
                break
            if kid.tag[0] != "#":
                before.append(kid)
        if how == "+":
            return bool(before) and test(before[-1]) and self._left(before[-1], k + 1, scope)
        return any(test(x) and self._left(x, k + 1, scope) for x in reversed(before))


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def take(self, pattern: re.Pattern[str]) -> re.Match[str] | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def space(self) -> None:
        while self.peek() and self.peek() in " \t\r\n\f":
            self.at += 1

    def list(self, closing: str = "", relative: bool = False) -> list[tuple[str, Complex]]:
        out = []
        while True:
            self.space()
            lead = " "
            if relative and self.peek() and self.peek() in ">+~":
                lead = self.peek()
                self.at += 1
                self.space()
            out.append((lead, self.complex(closing)))
            self.space()
            c = self.peek()
            if c == ",":
                self.at += 1
            elif c == closing:
                self.at += bool(closing)
                return out
            else:
                raise Unknown(self.text)

    def complex(self, closing: str) -> Complex:
        parts, hows = [self.compound()], []
        while True:
            here = self.at
            m = self.take(_COMBINATOR)
            if not m or not self.peek() or self.peek() in f",{closing}" and not m[1]:
                if m and m[1]:
                    raise Unknown(self.text)
                self.at = here
                break
            hows.append(m[1] or " ")
            parts.append(self.compound())
        return Complex(parts[-1], list(zip(reversed(hows), reversed(parts[:-1]))))

    def compound(self) -> Compound:
        out, begin = Compound([]), self.at
        if self.peek() == "*":
            self.at += 1
        elif m := self.take(_NAME):
            tag = _plain(m[0]).lower()
            out.tag = tag
            out.tests.append(lambda n: n.tag == tag)
        while True:
            c = self.peek()
            if c == "#":
                self.at += 1
                name = _plain(self._name(_HASH))
                out.id = out.id or name
                out.tests.append(lambda n, v=name: n.attrs.get("id") == v)
            elif c == ".":
                self.at += 1
                name = _plain(self._name(_NAME))
                out.cls = out.cls or name
                out.tests.append(lambda n, v=name: v in n.attrs.get("class", "").split())
            elif c == "[":
                self.at += 1
                out.tests.append(self.attribute())
            elif c == ":":
                out.tests.append(self.pseudo())
            else:
                break
        if self.at == begin:
            raise Unknown(self.text)
        return out

    def _name(self, pattern: re.Pattern[str]) -> str:
        m = self.take(pattern)
        if not m:
            raise Unknown(self.text)
        return m[0]

    def attribute(self) -> Test:
        m = self.take(_ATTRIBUTE)
        if not m:
            raise Unknown(self.text)
        name, how = _plain(m[1]).lower(), m[2]
        if not how:
            return lambda n: name in n.attrs
        want = _plain(next(x for x in (m[3], m[4], m[5]) if x is not None))
        fold = (m[6] or "").lower() == "i"
        if fold:
            want = want.lower()
        tests: dict[str, Callable[[str], bool]] = {
            "=": lambda v: v == want,
            "~=": lambda v: bool(want) and want in v.split(),
            "|=": lambda v: v == want or v.startswith(want + "-"),
            "^=": lambda v: bool(want) and v.startswith(want),
            "$=": lambda v: bool(want) and v.endswith(want),
            "*=": lambda v: bool(want) and want in v,
        }
        test = tests[how]

        def run(n: Node) -> bool:
            v = n.attrs.get(name)
            return v is not None and test(v.lower() if fold else v)

        return run

    def pseudo(self) -> Test:
        self.at += 1
        name = self._name(_NAME).lower()
        if self.peek() == "(":
            self.at += 1
            if name in ("not", "is", "where"):
                chosen = [c for _, c in self.list(")")]
                return (lambda n: not any(c.matches(n) for c in chosen)) if name == "not" else (lambda n: any(c.matches(n) for c in chosen))
            if name == "has":
                wanted = self.list(")", relative=True)
                return lambda n: any(_has(n, how, c) for how, c in wanted)
            if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
                m = self.take(_NTH)
                if not m or self.peek() != ")":
                    raise Unknown(self.text)
                self.at += 1
                if m[1]:
                    a, b = 2, int(m[1].lower() == "odd")
                elif m[5] is not None:
                    a, b = 0, int(m[5])
                else:
                    a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
                    b = int(f"{m[3]}{m[4]}") if m[4] else 0
                return _nth(a, b, "last" in name, name.endswith("type"))
            raise Unknown(self.text)
        simple: dict[str, Test] = {
            "root": lambda n: n.parent is None or n.parent.tag == "#document",
            "empty": lambda n: not any(k.tag[0] != "#" or (k.tag == TEXT and k.data) for k in n.kids),
            "first-child": _nth(0, 1, False, False),
            "last-child": _nth(0, 1, True, False),
            "only-child": _only(False),
            "first-of-type": _nth(0, 1, False, True),
            "last-of-type": _nth(0, 1, True, True),
            "only-of-type": _only(True),
        }
        if name not in simple:
            raise Unknown(self.text)
        return simple[name]


def _below(node: Node) -> Iterator[Node]:
    stack = list(reversed(node.kids))
    while stack:
        x = stack.pop()
        if x.tag[0] != "#":
            yield x
            stack += reversed(x.kids)


def _has(node: Node, how: str, want: Complex) -> bool:
    if how in " >":
        for x in _below(node):
            if want.matches(x) and _anchored(x, want, node, how):
                return True
        return False
    after, seen = [], False
    for k in node.parent.kids if node.parent is not None else ():
        if seen and k.tag[0] != "#":
            after.append(k)
        seen = seen or k is node
    return any(want.matches(x) for x in (after[:1] if how == "+" else after))


def _anchored(x: Node, want: Complex, node: Node, how: str) -> bool:
    return how == " " or (x.parent is node if not want.left else _leftmost(x, want, node))


def _leftmost(x: Node, want: Complex, node: Node) -> bool:
    up = x
    for combinator, _ in want.left:
        if combinator not in ">":
            return any(k is up for k in _below(node))
        up = up.parent
    return up.parent is node


@dataclass
class Query:
    """A selector list, and what is wanted: "" (the element), "text" or "attr"."""

    source: str
    selectors: list[Complex]
    want: str = ""
    attr: str = ""

    def select(self, index: Index, scope: Node | None = None) -> list[Node]:
        """Matches among the descendants of scope, or in the whole document, in document order."""
        if len(self.selectors) == 1:
            s = self.selectors[0]
            found = index.candidates(s.right, scope)
            return list(found) if s.plain else [x for x in found if s.matches(x)]
        out: dict[int, Node] = {}
        for s in self.selectors:
            for x in index.candidates(s.right, scope):
                if s.plain or s.matches(x):
                    out[x.pre] = x
        return [out[k] for k in sorted(out)]


class Index:
    """Elements of a numbered document by tag, class and id, each made when first asked for."""

    def __init__(self, order: list[Node]) -> None:
        self.order = order
        self.all = [x for x in order if x.tag[0] != "#"]
        self._by: dict[str, dict[str, list[Node]]] = {}
        self._places: dict[tuple[str, str], list[int]] = {}
        self._bounded = False

    def _named(self, kind: str) -> dict[str, list[Node]]:
        out = self._by.get(kind)
        if out is None:
            out = self._by[kind] = defaultdict(list)
            if kind == "tag":
                for x in self.all:
                    out[x.tag].append(x)
            elif kind == "id":
                for x in self.all:
                    if (v := x.attrs.get("id")) is not None:
                        out[v].append(x)
            else:
                names: dict[str, list[str]] = {}
                for x in self.all:
                    if v := x.attrs.get("class"):
                        of = names.get(v)
                        if of is None:
                            of = names[v] = list(dict.fromkeys(v.split()))
                        for name in of:
                            out[name].append(x)
        return out

    def candidates(self, c: Compound, scope: Node | None = None) -> list[Node]:
        """Elements below scope that the compound may match."""
        kind, name = ("id", c.id) if c.id else ("class", c.cls) if c.cls else ("tag", c.tag)
        found = self._named(kind).get(name, []) if name else self.all
        if scope is None or scope.parent is None:
            return found
        if not self._bounded:
            number_last(self.order)
            self._bounded = True
        places = self._places.get((kind, name))
        if places is None:
            places = self._places[kind, name] = [x.pre for x in found]
        low = bisect_right(places, scope.pre)
        return found[low : bisect_right(places, scope.last, low)]


_SUFFIX = re.compile(r"::(?:(text)|attr\(([^()]*)\))\s*$")


@lru_cache(512)
def compile_query(query: str) -> Query:
    """A query, with its trailing ::text or ::attr(name); unknown selectors match nothing."""
    m = _SUFFIX.search(query)
    source = query[: m.start()] if m else query
    want, attr = ("text", "") if m and m[1] else ("attr", m[2].strip()) if m else ("", "")
    try:
        p = _Parser(source.strip())
        selectors = [c for _, c in p.list()]
        if p.at != len(p.text):
            raise Unknown(source)
    except Unknown:
        selectors = []
    return Query(source, selectors, want, attr)
