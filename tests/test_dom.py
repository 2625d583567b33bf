"""CSS queries, text, navigation, search and paths."""

import re

import pytest

from weftline.kernel import dom
from weftline.kernel.css import compile_query
from weftline.kernel.dom import Page

HTML = """<html><head><title>Shop</title></head><body><div id="main" class="a b"><h1>Hi  <em>you</em></h1>
<ul id="it.ems"><li class="x" data-k="v w">one</li><li lang="en-US">two</li><li>three<span> deep </span></li></ul><p></p><a href="/n?b=2">Next</a></div><script>track(7)</script></body></html>"""


@pytest.fixture(scope="module")
def page():
    return Page(HTML, "https://shop.example/a/b")


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("li::text", ["one", "two", "three deep"]),
        ("div > ul li.x::text", ["one"]),
        ("li:nth-child(2)::text", ["two"]),
        ("li:nth-child(odd)::attr(class)", ["x"]),
        ("li:nth-last-of-type(1)::text", ["three deep"]),
        ("li:not(.x):not(:last-child)::text", ["two"]),
        ('[data-k~="w"]::attr(data-k)', ["v w"]),
        ("[lang|=en]::text", ["two"]),
        ("[LANG='EN-us' i]::text", ["two"]),
        ("ul + p::text", []),
        ("ul ~ a::attr(href)", ["/n?b=2"]),
        ("li:has(span)::text", ["three deep"]),
        ("div:has(> ul > li.x)::attr(id)", ["main"]),
        ("h1, title::text", ["Shop", "Hi  you"]),
        ("p:empty", ["<p></p>"]),
        (":root > body > #main::attr(class)", ["a b"]),
        ('[id="it.ems"] > li:first-child::text', ["one"]),
        ("#it\\.ems > :is(.x, :last-of-type)::text", ["one", "three deep"]),
        ("li::attr(nope)", []),
        ("bad[", []),
        ("p >", []),
        ("li:unknown", []),
        ("", []),
    ],
)
def test_values(page, query, want):
    assert page.values(query) == want


def test_lists_are_in_document_order(page):
    assert [x.tag for x in page.select("a, h1, li")] == ["h1", "li", "li", "li", "a"]


def test_selection_below_an_element_excludes_itself(page):
    ul = page.select("ul")[0]
    assert page.select("ul", ul) == [] and len(page.select("li", ul)) == 3
    assert len(page.select("div li", ul)) == 3


def test_text(page):
    li = page.select("li")[2]
    assert dom.own_text(li) == "three" and dom.all_text(li) == "three deep " and dom.tight_text(li) == "threedeep"
    assert dom.all_text(page.select("#main")[0], " ", True, ("ul",)) == "Hi you Next"
    assert dom.all_text(page.select("h1")[0], "|", True, valid=lambda t: t != "you") == "Hi"


def test_navigation(page):
    a, b, c = page.select("li")
    assert dom.neighbour(a, 1) is b and dom.neighbour(a, -1) is None and dom.siblings(b) == [a, c]
    assert dom.parent(a).tag == "ul" and dom.has_class(a, "x") and not dom.has_class(a, "X")
    assert dom.search_values(a, "v", True) == [("data-k", "v w")] and dom.search_values(a, "x") == [("class", "x")]


def test_find_by_text_prefers_the_deepest_and_regex_the_outermost(page):
    root = page.posted()
    assert dom.find_by_text(root, "deep", partial=True).tag == "span"
    assert dom.find_by_text(root, "deep", first=False, partial=True).tag == "span"
    assert dom.find_by_text(root, "deep").tag == "span" and dom.find_by_text(root, " deep ") is None
    assert [x.tag for x in dom.find_all_by_text(root, "ONE", case_sensitive=False)] == ["li"]
    assert dom.find_by_regex(root, "deep").tag == "html" and dom.find_by_regex(root, "deep", first=False).tag == "span"
    assert dom.find_by_regex(root, "(") is None


def test_paths_lead_back(page):
    for x in dom.walk(page.root):
        for full in (False, True):
            path = dom.css_path(x, full)
            if path:
                assert page.select(path) == [x], path
    li = page.select("li")[1]
    assert dom.css_path(li) == '[id="it.ems"] > li:nth-of-type(2)' and dom.xpath_path(li) == "//ul[@id='it.ems']/li[2]"
    assert dom.xpath_path(li, True) == "//body/div/ul/li[2]" and dom.xpath_path(page.select("html")[0]) == "/"
    assert dom.xpath_literal("a'b") == '"a\'b"' and dom.xpath_literal("a'b\"c") == "concat('a', \"'\", 'b\"c')"


def test_selectors_agree_with_brute_force():
    import random

    rng = random.Random(5)
    tags, classes = ["div", "p", "ul", "li"], ["a", "b", "c"]

    def make(depth):
        t = rng.choice(["div", "section", "span"])
        inner = "".join(make(depth - 1) for _ in range(rng.randrange(4))) if depth else ""
        return f'<{t} class="{" ".join(rng.sample(classes, rng.randrange(3)))}">{inner}</{t}>'

    page = Page("".join(make(4) for _ in range(4)))
    everything = list(dom.walk(page.root))
    for x, y in [("div", "span"), (".a", ".b"), ("section.c", "*")]:
        ok = lambda n, s: (not (m := re.match(r"[a-z]+", s)) or n.tag == m[0]) and ("." not in s or s.split(".")[1] in n.attrs.get("class", "").split())
        ups = lambda n: [n.parent, *ups(n.parent)] if n.parent is not None else []
        assert page.select(f"{x} {y}") == [n for n in everything if ok(n, y) and any(u.tag[0] != "#" and ok(u, x) for u in ups(n))]
        assert page.select(f"{x} > {y}") == [n for n in everything if ok(n, y) and n.parent.tag[0] != "#" and ok(n.parent, x)]
        assert page.select(f"{x} + {y}") == [n for n in everything if ok(n, y) and (b := dom.neighbour(n, -1)) is not None and ok(b, x)]
    assert tags


def test_compiled_once():
    assert compile_query("a") is compile_query("a")
