"""URLs, links, robots, text, similarity, throttling, feeds, exports and decoding."""

import gzip
import json
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftline.kernel import dom, export, feeds, fetching, robots, similarity, text, throttle, url
from weftline.kernel.dom import Page
from weftline.kernel.links import IGNORED_EXTENSIONS, LinkRules, extension_chains


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("http://a.b/c/d?e", "f", "http://a.b/c/f"),
        ("http://a.b/c/d?e", "../../x/./y/", "http://a.b/x/y/"),
        ("http://a.b/c/d?e", "?q", "http://a.b/c/d?q"),
        ("http://a.b/c/d?e", "#f", "http://a.b/c/d?e#f"),
        ("http://a.b/c/d?e", "//H.Ost:80/p", "http://h.ost/p"),
        ("https://a.b", "HTTPS://X.y:443", "https://x.y/"),
        ("https://a.b", "\\x\\y", "https://a.b/x/y"),
        ("https://a.b/", " a b\t", "https://a.b/a%20b"),
        ("https://a.b/", "/é?ü", "https://a.b/%C3%A9?%C3%BC"),
        ("https://a.b/", "mailto:x@y", "mailto:x@y"),
        ("https://a.b/", "http://[", "http://["),
        ("", "rel", "rel"),
    ],
)
def test_join(base, href, want):
    assert url.join(base, href) == want


def test_canonical_forms():
    assert url.canonicalize("http://A.b/p?b=2&&a=1&a=%FF#x") == "http://a.b/p?a=%FF&a=1&b=2"
    assert url.canonicalize("http://a.b/p?") == "http://a.b/p" and url.canonicalize("http://a.b/p#x", True) == "http://a.b/p#x"
    assert url.canonicalize("nope") == "nope" and url.without_fragment("http://a.b?b&a#c") == "http://a.b/?b&a"
    assert url.host("http://münchen.de/") == "xn--mnchen-3ya.de" and url.host("http://0x7f.1/") == "127.0.0.1"
    assert url.origin("https://u:p@a.b:8443/x") == "https://a.b:8443" and url.origin("data:x") is None
    assert url.parsed("http://a.b:99999/") is None and url.parsed("http://a b/") is None


def test_search_links():
    assert url.search_target("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2F%3Fx%3D1&rut=2") == "https://a.b/?x=1"
    assert url.search_target("https://duckduckgo.com.evil/l/?uddg=x") == "https://duckduckgo.com.evil/l/?uddg=x"
    assert url.search_blocked(202, "https://html.duckduckgo.com/", "x") and url.search_blocked(200, "https://duckduckgo.com/", "home")
    assert not url.search_blocked(200, "https://duckduckgo.com/", 'class="result__a"') and not url.search_blocked(202, "https://a.b/?q=duckduckgo.com", "")


def test_links():
    p = Page('<a href=" /b ">1</a><area href="/c.PDF"><a href="/a?z=1&y=2#f">2</a><a href="/b">3</a><a href="javascript:x">4</a><a>5</a><a href="">6</a><nav><a href="http://sub.other.org/q">7</a></nav>', "http://x.org/d/")
    assert LinkRules().extract(p) == ["http://x.org/b", "http://x.org/a?y=2&z=1", "http://sub.other.org/q"]
    assert LinkRules(allow_domains=("OTHER.org",)).extract(p) == ["http://sub.other.org/q"]
    assert LinkRules(deny_domains=("other.org",), deny=("y=",)).extract(p) == ["http://x.org/b"]
    assert LinkRules(restrict_css=("nav",)).extract(p) == ["http://sub.other.org/q"]
    assert LinkRules(deny_extensions=frozenset()).extract(p)[1] == "http://x.org/c.PDF"
    assert LinkRules(process=lambda u: u + "!" if "b" in u else None).extract(p) == ["http://x.org/b!", "http://sub.other.org/q!"]
    assert LinkRules(canonicalize=False).extract(p)[1] == "http://x.org/a?z=1&y=2#f"
    assert extension_chains("http://a/x.tar.gz?y=.z") == ["tar.gz", "gz"] and extension_chains("http://a/..b") == ["b"] and len(IGNORED_EXTENSIONS) == 91
    with pytest.raises(re.error):
        LinkRules(allow=("(",))


def test_robots():
    r = robots.rules_for("User-agent: a\nUser-agent: B\nDisallow: /x\nAllow: /x/y$\n\nUser-agent: *\nDisallow: /\nuser-agent: b\ncrawl-delay: inf\nCrawl-delay: 3 # c\nDisallow:\n", "B/1.0 (+x)")
    assert r.rules == [(False, "/x"), (True, "/x/y$")] and r.delay == 3.0
    assert not r.allowed("/x/z") and r.allowed("/x/y") and r.allowed("/q")
    assert not robots.rules_for("User-agent: *\nDisallow: /", "zz").allowed("/") and robots.rules_for(None, "zz").allowed("/")
    assert robots.Rules([(False, "/a"), (True, "/a")]).allowed("/a")
    assert robots.sitemaps("Sitemap: http://a/b # c\nsitemap:http://c\nx: y") == ["http://a/b", "http://c"]
    assert [robots.crawl_delay(x) for x in ("1.5", "-1", "nan", "90000", "x")] == [1.5, None, None, None, None]


@given(st.text("a/*$.", max_size=8), st.text("a/.$", max_size=8))
def test_patterns_agree_with_regular_expressions(pattern, target):
    assert robots.matches(pattern, target) == bool(re.search(robots.pattern_regex(pattern).replace(r"\z", r"\Z"), target))


def test_text():
    assert text.clean(" a\r\n\t b \xa0 &amp;lt; ", True) == "a b \xa0 &lt;"
    assert text.strip(" \xa0a\x1c") == "a\x1c" and text.decode_entities("&amp;quot;&#39;") == "&quot;'"
    assert text.regex_all("a1 b c3", r"[a-c](\d)?") == ["1", "3"] and text.regex_all("aA", "a", False, False, False) == ["a", "A"]
    assert text.regex_all("x", "(") == [] and text.regex_first("&lt;5", "<(.)", True) == "5" and text.regex_first("x", "y") is None
    assert text.title_case("2in1 sETS") == "2In1 Sets" and text.safe_segment("a b/é") == "a_b__" and text.safe_segment("") == "_"


def test_similarity():
    old = Page("<div class=list><article class=product data-sku=1><h2>Item</h2></article></div>")
    new = Page("<main><section><article class='product new' data-sku=1><h2>Item</h2></article><article class=other>x</article></section></main>")
    saved = dom.element_data(old.select("article")[0])
    nodes = new.select("*")
    found = similarity.relocate(saved, [dom.element_data(x) for x in nodes])
    assert [nodes[i].attrs.get("data-sku") for i in found] == ["1"]
    assert similarity.score(saved, saved) == 100.0 and similarity.relocate(saved, []) == []
    twins = [saved, saved]
    assert similarity.relocate(saved, twins) == [0, 1] and similarity.relocate(saved, [dom.element_data(new.select("main")[0])], 99) == []


def test_throttle():
    t = throttle.Throttle(1.0, 10.0, 2.0)
    s = throttle.slot(t, 0.0, 0.0)
    assert throttle.reserve(t, s, 0.0, 0.0) == 0.0 and throttle.reserve(t, s, 0.0, 0.0) == 1.0
    assert throttle.record(t, s, 8.0, 200, None, 0.0, 0.0) == 4.0  # straight up to the target
    assert throttle.record(t, s, 0.0, 404, None, 0.0, 0.0) == 4.0  # only a 200 lowers it
    assert throttle.record(t, s, 0.0, 200, None, 0.0, 0.0) == 2.0
    assert throttle.record(t, s, 0.0, 503, 99.0, 0.0, 5.0) == 10.0 and s.next_allowed == 15.0
    assert throttle.record(t, s, 0.0, 200, None, 7.0, 5.0) == 7.0
    assert throttle.retry_after(" 3 ") == 3.0 and throttle.retry_after("Wed, 21 Oct") is None and throttle.retry_after("inf") is None


def test_csv():
    assert feeds.csv_rows('a,b\r\n"x, ""y""\nz",1\r\n\r\n2\n') == [["a", "b"], ['x, "y"\nz', "1"], ["2"]]
    assert feeds.csv_rows('a"b,c"\n') == [['a"b', 'c"']] and feeds.csv_rows("a;b;", ";") == [["a", "b", ""]] and feeds.csv_rows("") == []
    assert feeds.csv_items("h,i\n1\n1,2,3\n") == [{"h": "1", "i": ""}, {"h": "1", "i": "2"}] and feeds.csv_items("1,2", headers=["x"]) == [{"x": "1"}]


@given(st.lists(st.lists(st.text("a,\"\n\r ", max_size=4), min_size=1, max_size=3), max_size=4))
def test_csv_round_trip(rows):
    rows = [r for r in rows if r != [""]]
    assert feeds.csv_rows("".join(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\r\n" for r in rows)) == rows


def test_xml_feeds():
    assert feeds.rewrite_void_tags('<link>u</link><LINK a="x>y"/><links/>') == '<xmlfeed-link>u</xmlfeed-link><xmlfeed-link a="x>y"></xmlfeed-link><links/>'
    rss = '<?xml version="1.0"?><rss><channel><link>no</link><item><title> T &amp; </title><link>http://u</link><x>1</x><x>2</x></item></channel></rss>'
    assert feeds.xml_items(rss) == [{"title": "T &", "link": "http://u", "x": "2"}]
    assert feeds.xml_items('<feed><entry><link href="h"/><id>7</id></entry></feed>', "entry") == [{"link": "", "id": "7"}]


def test_sitemaps():
    body = '<?xml version="1.0"?><!-- x --><urlset><url><loc> a </loc><xhtml:link href="b"/></url><url><loc>a</loc></url><url><loc>c</loc></url></urlset>'
    assert feeds.sitemap(body) == (["a", "c"], []) and feeds.sitemap(body, True) == (["a", "b", "c"], []) and feeds.looks_like_sitemap(body)
    assert feeds.sitemap("<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>") == ([], ["s"])
    assert not feeds.looks_like_sitemap("<html><urlset>") and feeds.is_robots("http://a/robots.txt") and feeds.absolute("http://a/b", "c") == "http://a/c"


def test_shop():
    s = feeds.Shop.of("https://shop.example:8080/x")
    items, more = s.parse(s.collections_url(), json.dumps({"collections": [{"handle": "a", "products_count": 2}, {"handle": "b", "products_count": 0}]}))
    assert (items, more) == ([], [s.products_url("a"), s.collections_url(2)])
    product = {"title": "P", "handle": "p", "vendor": "V", "body_html": "<p>x<br>y", "images": [{"src": "i"}], "variants": [{"id": 1, "title": "Default Title", "price": "5", "available": True}, {"id": 1, "title": "Red", "price": 6.5, "compare_at_price": "7"}]}
    items, more = s.parse("https://shop.example:8080/collections/two-2in1/products.json?page=3", json.dumps({"products": [product]}))
    assert more == [s.products_url("two-2in1", 4)] and [i["name"] for i in items] == ["P", "P - Red"] and items[0]["category"] == "Two 2In1"
    assert [(i["price"], i["stock"], i["old_price"], i["sku"]) for i in items] == [("5", None, "", ""), (6.5, 0, "7", "")] and items[0]["description"] == "x y"
    assert len(feeds.first_variants([*items, {"identifier": None}, {"identifier": None}])) == 3


def test_exports():
    items = [{"a": "x,\"y\"", "b": None}, 5, {"c d": [1, {"k": True}], "a": "\x01<'"}]
    assert export.to_csv(items) == 'a,b,c d\r\n"x,""y""",,\r\n\x01<\',,"[1,{""k"":true}]"\r\n' and export.to_csv([]) == "\r\n"
    assert "<c_d>[1,{&quot;k&quot;:true}]</c_d>" in export.to_xml(items) and "<a>&lt;&apos;</a>" in export.to_xml(items) and "<b></b>" in export.to_xml(items)
    assert export.xml_name("1a b") == "_1a_b" and export.xml_name("") == "_" and export.to_jsonl([{"b": 1, "a": "é"}]) == '{"b":1,"a":"é"}\n'
    assert json.loads(export.to_json(items, 2)) == items


def test_decoding():
    assert fetching.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and fetching.decode("日本".encode("shift_jis"), 'x; charset="Shift_JIS"') == "日本"
    assert fetching.decode(b"\xef\xbb\xbfa", "charset=latin1") == "a" and fetching.decode("é".encode(), "x; boundary=charset=latin1") == "é" and fetching.decode(b"\xff") == "�"
    two = gzip.compress(b"ab") + gzip.compress(b"c")
    assert fetching.decode(two) == "abc" and fetching.gunzip(two, 2) is None and fetching.gunzip(two[:-3]) is None and fetching.gunzip(b"ab") is None
    assert fetching.charset("text/html;  Charset = 'utf-8'") == "utf-8" and fetching.charset("x-charset=a") is None


def test_headers_and_proxies():
    h = fetching.build_headers(fetching.FetchConfig(headers=(("Accept", "x"), ("User-Agent", "no"))), "http://a/")
    assert h["accept"] == "x" and h["user-agent"] in fetching.USER_AGENTS and h["sec-fetch-mode"] == "navigate"
    fox = fetching.build_headers(fetching.FetchConfig(user_agent=fetching.USER_AGENTS[3]), "u")
    assert "sec-ch-ua" not in fox and fetching.build_headers(fetching.FetchConfig(user_agent=fetching.USER_AGENTS[1]), "u")["sec-ch-ua-platform"] == '"macOS"'
    assert "accept" not in fetching.build_headers(fetching.FetchConfig(stealth=False), "u")
    p = fetching.Proxies(["a", "b"])
    assert [p.next() for _ in range(3)] == ["a", "b", "a"] and fetching.Proxies([]).next() is None and p.scattered() in "ab"
