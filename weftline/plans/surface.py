"""Queries over the parts of the surface that pages and tables leave out: bodies, requests, responses, searches, spiders and crawl state."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..functions.arrow import batched
from ..kernel.fetching import FetchConfig
from ..kernel.links import LinkRules
from ..operators import crawl as C
from ..operators import extract as E
from ..operators import frontier, relocate, spiders
from ..operators import navigate as N
from ..sources import export
from ..sources.fetch import fetch_requests
from ..sources.shared import new_path
from ..sources.tables import ResponseCache
from .echo import base
from .pages import _LI, _LINKS, ROBOTS, _RULE_ROWS, pages
from .register import Registry, spread, table

query = Registry()

#: MB a task of events, of which each is a small page.
_SHORT = 1.0

# ---- bodies ----

_zip = batched(lambda b: None if b is None else gzip.compress(b[: len(b) // 2], 1) + gzip.compress(b[len(b) // 2 :], 1), "binary")


@query("SELECT page_id, kind, html AS text FROM pages, (VALUES ('utf-8 mark'), ('utf-16-le mark'), ('utf-16-be mark'), ('latin-1'), ('windows-1252'), ('no charset'), ('gzip'), ('unknown charset')) t(kind)")
def decode_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of many encodings; a byte-order mark wins over a charset that says otherwise."""
    h = F.col("html")
    coded = lambda name, mark=b"": F.concat(F.lit(bytearray(mark)), F.encode(h, name))
    kinds = {
        "utf-8 mark": (coded("UTF-8", b"\xef\xbb\xbf"), "text/html; charset=latin1"),
        "utf-16-le mark": (coded("UTF-16LE", b"\xff\xfe"), "text/html; charset=utf-8"),
        "utf-16-be mark": (coded("UTF-16BE", b"\xfe\xff"), "text/html"),
        "latin-1": (coded("ISO-8859-1"), 'text/html; Charset="ISO-8859-1"'),
        "windows-1252": (coded("ISO-8859-1"), "text/html;charset=windows-1252"),
        "no charset": (coded("UTF-8"), "text/html"),
        "gzip": (_zip(coded("UTF-8")), "text/html; charset=utf-8"),
        "unknown charset": (coded("UTF-8"), "text/html; charset=none-such"),
    }
    bodies = F.array(*(F.struct(F.lit(k).alias("kind"), b.alias("body"), F.lit(t).alias("type")) for k, (b, t) in kinds.items()))
    rows = pages(spark, sf_dir).select("page_id", F.explode(bodies).alias("b"))
    return rows.select("page_id", "b.kind", U.decode_body(F.col("b.body"), F.col("b.type")).alias("text"))


@query("SELECT page_id, html AS whole, strlen(html) <= 3000 AS within, true AS plain, true AS broken FROM pages")
def gunzip_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two members a body; a limit on what comes out; what is no gzip, and what breaks off."""
    raw = F.encode("html", "UTF-8")
    rows = pages(spark, sf_dir).select("page_id", raw.alias("raw"), _zip(raw).alias("z"))
    return rows.select("page_id", F.decode(U.gunzip(F.col("z")), "UTF-8").alias("whole"), U.gunzip(F.col("z"), 3000).isNotNull().alias("within"), U.gunzip(F.col("raw")).isNull().alias("plain"), U.gunzip(F.expr("substring(z, 1, octet_length(z) - 4)")).isNull().alias("broken"))


# ---- requests ----


@query("""SELECT page_id, sha256('s1' || 'POST' || split_part(url, '#', 1) || 'a=' || page_id) AS with_body, sha256('PUT' || split_part(url, '#', 1) || '{"a":' || page_id || '}') AS with_json,
sha256('GET' || split_part(url, '#', 1) || 'accept' || 'x' || 'zone' || page_id) AS with_headers, sha256('GET' || split_part(url, '#', 1) || 'k' || page_id) AS with_meta, sha256('GET' || url) AS with_fragment FROM pages""")
def fingerprint_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    p = pages(spark, sf_dir).select("page_id", "url")
    headers, meta = F.create_map(F.lit("zone"), n, F.lit("accept"), F.lit("x")), F.create_map(F.lit("k"), n)
    fp = lambda name, flags, **columns: frontier.requests(p, callback=n, **flags, **columns).select(F.col("callback").cast("long").alias("page_id"), F.col("fp").alias(name))
    out = fp("with_body", {}, method=F.lit("POST"), session_id=F.lit("s1"), body=F.concat(F.lit("a="), n))
    more = [
        fp("with_json", {}, method=F.lit("PUT"), body=F.lit("lost"), json_body=F.concat(F.lit('{"a":'), n, F.lit("}"))),
        fp("with_headers", {"include_headers": True}, headers=headers),
        fp("with_meta", {"include_meta": True}, meta=meta),
        fp("with_fragment", {"keep_fragment": True}),
    ]
    for m in more:
        out = out.join(m, "page_id")
    return out


@query("SELECT page_id, kind FROM pages, (VALUES ('unsupported_method'), ('session_not_found'), ('bad_url')) t(kind)")
def fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that fail before they reach a network have a kind of error each."""
    kinds = (("PATCH", "", "http://a.test/"), ("GET", "nope", "http://a.test/"), ("GET", "default", "not a url "))
    asked = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(s).alias("session_id"), F.lit(b).alias("base")) for m, s, b in kinds))
    rows = pages(spark, sf_dir).select("page_id", F.explode(asked).alias("a")).select(F.concat("a.base", F.col("page_id").cast("string")).alias("url"), "a.method", "a.session_id", F.col("page_id").alias("seq"))
    got = fetch_requests(rows, FetchConfig(retries=0), per_domain=8)
    return got.select(F.col("seq").alias("page_id"), F.col("error_kind").alias("kind"))


def _asked(spark: SparkSession, sf_dir: str, paths: Column) -> DataFrame:
    """A request for each page and struct (method, path, body) of paths, which get the page's number."""
    n = F.col("page_id").cast("string")
    rows = pages(spark, sf_dir).select("page_id", F.explode(paths).alias("a"))
    return rows.select(F.concat(F.lit(base(spark)), "a.path", n).alias("url"), "a.method", F.concat("a.body", n).alias("body"), F.col("page_id").alias("seq"))


def _paths(*rows: tuple[str, str, str | None]) -> Column:
    return F.array(*(F.struct(F.lit(m).alias("method"), F.lit(p).alias("path"), F.lit(b).alias("body")) for m, p, b in rows))


@query("SELECT page_id, m AS method, 200 AS status, m || ' /echo/' || page_id || CASE WHEN m IN ('POST', 'PUT') THEN ' b' || page_id ELSE '' END AS body FROM pages, (VALUES ('GET'), ('POST'), ('PUT'), ('DELETE')) t(m)")
def fetch_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir, _paths(("GET", "/echo/", None), ("POST", "/echo/", "b"), ("PUT", "/echo/", "b"), ("DELETE", "/echo/", None)))
    got = fetch_requests(asked, FetchConfig(retries=0), per_domain=8)
    return got.select(F.col("seq").alias("page_id"), F.regexp_extract("body", "^[A-Z]+", 0).alias("method"), "status", "body")


@query("""SELECT page_id, kind, status, error, '/' || path || '/' || page_id AS final FROM pages, (VALUES ('flaky', 200, NULL, 'flaky'), ('moved', 200, NULL, 'ok'), ('big', NULL, 'too_large', 'big'), ('status/503', 503, NULL, 'status/503'), ('echo', 200, NULL, 'echo')) t(kind, status, error, path)""")
def fetch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost connections are tried again, redirects followed, long bodies refused; a status of any kind is an answer."""
    asked = _asked(spark, sf_dir, _paths(*(("GET", f"/{k}/", None) for k in ("flaky", "moved", "big", "status/503", "echo"))))
    got = fetch_requests(asked, FetchConfig(retries=1, retry_delay=0.0, max_body_bytes=1000), per_domain=8)
    return got.select(F.col("seq").alias("page_id"), F.regexp_extract("request_url", r"^http://[^/]+/(.*)/\d+$", 1).alias("kind"), "status", F.col("error_kind").alias("error"), F.regexp_extract("url", "^http://[^/]+(/.*)$", 1).alias("final"))


@query("SELECT page_id, 'quiet' AS session, 'x-one=1|x-two=own|user-agent=weft/1|sec-fetch-mode=None' AS body, 302 AS moved FROM pages UNION ALL SELECT page_id, 'default', 'x-one=None|x-two=own|user-agent=weft/2|sec-fetch-mode=navigate', 200 FROM pages")
def fetch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named settings: headers, agent, what a browser sends, and redirects; a request's own headers go first."""
    sessions = {"quiet": FetchConfig(retries=0, headers=(("X-One", "1"), ("X-Two", "2")), user_agent="weft/1", stealth=False, follow_redirects=False), "default": FetchConfig(retries=0, user_agent="weft/2")}
    asked = _asked(spark, sf_dir, _paths(("GET", "/headers/", None), ("GET", "/moved/", None)))
    rows = asked.select("*", F.explode(F.array(F.lit("quiet"), F.lit("default"))).alias("session_id"), F.create_map(F.lit("X-Two"), F.lit("own")).alias("headers"))
    got = fetch_requests(rows.withColumn("fp", F.col("session_id")), sessions["default"], sessions, per_domain=8)
    told = F.col("request_url").contains("/headers/")
    return got.groupBy(F.col("seq").alias("page_id"), F.col("fp").alias("session")).agg(F.max(F.when(told, F.col("body"))).alias("body"), F.max(F.when(~told, F.col("status"))).alias("moved"))


@query("""WITH a AS (SELECT page_id, list_sum(list_transform(string_split(url, ''), lambda c: ord(c))) % 5 AS k FROM pages)
SELECT page_id, CASE WHEN k < 3 THEN list_value('"Windows"', '"macOS"', '"Linux"')[CAST(k AS INT) + 1] END AS platform, CASE WHEN k < 3 THEN '?0' END AS mobile, 'document' AS dest, 'weft' AS custom, CAST(CASE WHEN k < 3 THEN 12 ELSE 9 END AS BIGINT) AS n FROM a""")
def request_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    rows = pages(spark, sf_dir).select("page_id", U.request_headers(F.col("url"), FetchConfig(headers=(("X-Custom", "weft"),))).alias("h"))
    return rows.select("page_id", h["sec-ch-ua-platform"].alias("platform"), h["sec-ch-ua-mobile"].alias("mobile"), h["sec-fetch-dest"].alias("dest"), h["x-custom"].alias("custom"), F.size(h).cast("long").alias("n"))


# ---- responses ----

_ANSWERS = "[200, 202, 301, 403, 407, 429, 444, 500][CAST(page_id % 8 AS INT) + 1]"


def _answer() -> Column:
    return F.element_at(F.array(*map(F.lit, (200, 202, 301, 403, 407, 429, 444, 500))), (F.col("page_id") % 8 + 1).cast("int"))


@query(f"""WITH r AS (SELECT page_id, {_ANSWERS} AS status, page_id % 3 AS h, html LIKE '%the%' AS found, strlen(html) AS n FROM pages)
SELECT page_id, status BETWEEN 200 AND 299 AS success, status IN (401, 403, 407, 429, 444) AS blocked, h < 2 AND (status = 202 OR (status = 200 AND NOT found)) AS homepage, CAST(n AS BIGINT) AS content_length FROM r""")
def response_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.element_at(F.array(*map(F.lit, ("https://duckduckgo.com/html?q=x", "https://html.duckduckgo.com/html", "https://notduckduckgo.com/"))), (F.col("page_id") % 3 + 1).cast("int"))
    body = F.when(F.col("html").contains("the"), F.lit('<a class="result__a">')).otherwise("")
    return pages(spark, sf_dir).select("page_id", U.is_success(_answer()).alias("success"), U.is_blocked(_answer()).alias("blocked"), U.search_blocked(_answer(), where, body).alias("homepage"), X.byte_length(F.col("html")).cast("long").alias("content_length"))


@query("SELECT page_id, k, k IN (1, 2) AS robots FROM pages, (VALUES (0), (1), (2), (3), (4)) t(k)")
def robots_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = U.origin(F.col("url"))
    urls = F.array("url", F.concat(o, F.lit("/robots.txt?x=1#f")), F.concat(o, F.lit("/a/robots.txt")), F.concat(o, F.lit("/robots.txt/")), F.lit("robots.txt"))
    rows = pages(spark, sf_dir).select("page_id", F.posexplode(urls).alias("k", "u"))
    return rows.select("page_id", "k", U.is_robots(F.col("u")).alias("robots"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS element FROM events")
def element_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON that an element's own text holds, and that of a response's body."""
    html = F.concat(F.lit('<script type="application/ld+json">'), "props", F.lit("</script>"))
    n = E.nodes(table(spark, sf_dir, "events").select("event_id", "props", html.alias("html")), keep=["event_id", "props"]).where("tag = 'script'")
    got = n.select("event_id", F.variant_get(N.json_text(), "$.k", "long").alias("k"), F.variant_get(X.json_value(F.col("props")), "$.k", "long").alias("b"))
    return got.select("event_id", "k", F.col("k").eqNullSafe(F.col("b")).alias("element"))


# ---- elements ----


@query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment FROM customer)
SELECT c_custkey, '{"id":"' || c_name || '","data-k":"' || c_custkey || '","class":"a ' || c_mktsegment || '"}' AS json, 'id,data-k,class' AS keys, c_name || ',' || c_custkey || ',a ' || c_mktsegment AS vals, CAST(3 AS BIGINT) AS n, true AS has_id, false AS has_href, c_name AS id FROM c""")
def attribute_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    html = F.format_string('<p ID="%s" data-k=%s class="a %s" id="second">x', "c_name", F.col("c_custkey").cast("string"), "c_mktsegment")
    p = E.nodes(c.select("c_custkey", html.alias("html")), keep=["c_custkey"]).where("tag = 'p'")
    return p.select("c_custkey", N.attrs_json().alias("json"), F.array_join(N.attrs_keys(), ",").alias("keys"), F.array_join(N.attrs_values(), ",").alias("vals"), F.size("attrs").cast("long").alias("n"), N.has_attribute("id").alias("has_id"), N.has_attribute("href").alias("has_href"), N.attrs_map()["id"].alias("id"))


@query(f"""WITH l AS ({_LI}), t AS (SELECT page_id, pos, regexp_replace(value, '<[^>]*>', '', 'g') AS v FROM l)
SELECT page_id, count(*) FILTER (WHERE length(v) > 6) AS n_long, first(v ORDER BY pos) FILTER (WHERE length(v) > 6) AS first_long, last(v ORDER BY pos) AS last_any, CAST(count(*) AS BIGINT) AS n FROM t WHERE v NOT LIKE '%&%' GROUP BY page_id""")
def filter_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates over a selection: all that match, the first that does, the last of all."""
    items = pages(spark, sf_dir).select("page_id", E.value_array(F.col("html"), "nav li::text").alias("v")).withColumn("v", F.filter("v", lambda x: ~x.contains("&"))).where("size(v) > 0")
    long = F.filter("v", lambda x: F.length(x) > 6)
    return items.select("page_id", F.size(long).cast("long").alias("n_long"), F.get(long, F.lit(0)).alias("first_long"), F.element_at("v", -1).alias("last_any"), F.size("v").cast("long").alias("n"))


@query("""SELECT event_id, 5 AS first_exact, CASE WHEN event_type = 'click' THEN 11 ELSE 5 END AS last_exact, CAST(4 + CASE WHEN event_type = 'click' THEN 3 ELSE 0 END AS BIGINT) AS n_any_case,
CASE WHEN event_type IN ('purchase', 'click') THEN 9 END AS by_regex, 1 AS container, 'View ' || event_type AS last_text FROM events""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by text and pattern in a list of which one item differs; nodes are told by their place in document order."""
    h = F.col("html")
    html = F.format_string("<ul><li>click</li><li>%s</li><li>View <b>%s</b></li></ul>", "event_type", "event_type")
    rows = spread(table(spark, sf_dir, "events").select("event_id", "event_type"), _SHORT).select("event_id", html.alias("html"))
    asked = {"a": E.Search("click"), "b": E.Search("click", first=False), "c": E.Search("CLICK", many=True, partial=True, case_sensitive=False), "d": E.Search("^View(purchase|click)$", regex=True), "e": E.Search("(?i)CLICK", regex=True), "f": E.Search("^View", regex=True, first=False)}
    got = rows.select("event_id", E.searches(h, asked).alias("s")).select("event_id", "s.*")
    return got.select("event_id", F.col("a.node_id").alias("first_exact"), F.col("b.node_id").alias("last_exact"), F.size("c").cast("long").alias("n_any_case"), F.col("d.node_id").alias("by_regex"), F.col("e.node_id").alias("container"), F.replace(F.col("f.text"), F.lit("View"), F.lit("View ")).alias("last_text"))


@query("""WITH k AS (SELECT event_id, CAST(user_id % 40 + 1 AS INT) AS a, CAST(event_id % 40 + 1 AS INT) AS b, event_type = 'click' AS named FROM events),
s AS (SELECT event_id, named, 2.0::DOUBLE * least(a, b) / (a + b) AS r FROM k)
SELECT event_id, CASE WHEN named THEN floor((1.0::DOUBLE + r + 0.5 + 0.5 + 1.0 + 1.0 + 1.0 + 1.0) / 8 * 100 * 100 + 0.5) / 100 ELSE floor((1.0::DOUBLE + r + 1.0 + 1.0 + 1.0 + 1.0 + 1.0) / 7 * 100 * 100 + 0.5) / 100 END AS score FROM s""")
def similarity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items that differ in the length of their text, and in half of their class."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), _SHORT)
    named = F.when(F.col("event_type") == "click", F.lit(' class="{}"')).otherwise("")
    item = lambda n, name: F.concat(F.lit("<li"), F.replace(named, F.lit("{}"), F.lit(name)), F.lit(">"), F.repeat(F.lit("a"), (F.pmod(n, F.lit(40)) + 1).cast("int")), F.lit("</li>"))
    html = F.concat(F.lit("<ul>"), item(F.col("user_id"), "xxyy"), item(F.col("event_id"), "xxzz"), F.lit("</ul>"))
    return e.select("event_id", relocate.similarity_within(html, "li").alias("score"))


@query(f"""WITH l AS ({_LI}), c AS (SELECT page_id, pos, count(*) OVER (PARTITION BY page_id) AS n FROM l)
SELECT page_id, pos, 'html > body > nav > ul > li' AS path, 'ul' AS parent_name, CAST(n - 1 AS BIGINT) AS n_siblings, 'a' AS children, true AS no_text FROM c""")
def element_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("element")
    li = E.fingerprints(pages(spark, sf_dir), "nav li", keep=["page_id"])
    return li.select("page_id", F.col("pos").cast("long").alias("pos"), F.array_join(e["path"], " > ").alias("path"), e["parent_name"].alias("parent_name"), F.size(e["siblings"]).cast("long").alias("n_siblings"), F.array_join(e["children"], ",").alias("children"), e["text"].isNull().alias("no_text"))


_NAMES = "SELECT s_suppkey, s_name, s_suppkey % 3 AS k, s_name || CASE s_suppkey % 3 WHEN 1 THEN '''s' WHEN 2 THEN '''\"x' ELSE '' END AS id FROM supplier"


@query(f"""WITH n AS ({_NAMES})
SELECT s_suppkey, '[id="' || replace(id, '"', '\\"') || '"] > p' AS css_path, '//div[@id=' || CASE k WHEN 0 THEN '''' || id || '''' WHEN 1 THEN '"' || id || '"' ELSE 'concat(''' || s_name || ''', "''", ''"x'')' END || ']/p' AS xpath_path,
CASE k WHEN 0 THEN '''' || id || '''' WHEN 1 THEN '"' || id || '"' ELSE 'concat(''' || s_name || ''', "''", ''"x'')' END AS literal FROM n""")
def id_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from the nearest id, whose quotes have to be escaped in CSS and put together in XPath."""
    s = table(spark, sf_dir, "supplier")
    ident = F.concat("s_name", F.element_at(F.array(F.lit(""), F.lit("'s"), F.lit("'\"x")), (F.col("s_suppkey") % 3 + 1).cast("int")))
    rows = s.select("s_suppkey", X.xpath_literal(ident).alias("literal"), F.concat(F.lit('<div id="'), F.replace(ident, F.lit('"'), F.lit("&quot;")), F.lit('"><p>x</p></div>')).alias("html"))
    return E.paths(rows, "p", keep=["s_suppkey", "literal"]).select("s_suppkey", "css_path", "xpath_path", "literal")


# ---- values ----


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS segment, '_' AS none FROM pages")
def safe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", X.safe_segment(F.col("url")).alias("segment"), X.safe_segment(F.lit("")).alias("none"))


@query("""SELECT event_id, floor(value / 7 * 100 + 0.5) / 100 AS rounded, CASE WHEN event_type = 'click' THEN 0.0 ELSE least(greatest(value * 100 - 900, 0.0), 9000.0) END::DOUBLE AS bounded,
CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN NULL ELSE user_id::DOUBLE END AS wait FROM events""")
def numeric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    header = F.when(kind == "view", F.lit("Wed, 21 Oct 2026 07:28:00 GMT")).when(kind == "click", F.concat(F.lit("-1"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", X.round_away(v / 7).alias("rounded"), X.bounded(F.when(kind == "click", F.lit(float("nan"))).otherwise(v * 100 - 900), 0.0, 9000.0).alias("bounded"), X.retry_after(header).alias("wait"))


@query("""SELECT s_suppkey AS seq, '{' || chr(10) || '  "key": ' || s_suppkey || ',' || chr(10) || '  "the name": "' || s_name || ', \\"<&>\\""' || chr(10) || '}' AS text FROM supplier""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    items = s.select(F.col("s_suppkey").alias("seq"), F.to_json(F.struct(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(', "<&>"')).alias("the name"))).alias("item"))
    return export.json_texts(items, 2)


# ---- crawls ----


def _echo(requests: DataFrame) -> DataFrame:
    """A fetch function without a network: each answer tells what was asked."""
    body = F.concat(F.lit("<title>"), "method", F.lit(" "), F.coalesce("json_body", "body", F.lit("")), F.lit("</title>"))
    return requests.select("fp", "seq", F.col("url").alias("request_url"), "url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), body.alias("body"))


def _title(page, row) -> tuple[list[object], list[object]]:
    return [{"url": row["request_url"], "title": page.value("title::text")}], []


#: Of pages that differ in their fragment alone the least URL is crawled.
_ONCE = "p AS (SELECT min(url) AS url FROM pages GROUP BY split_part(url, '#', 1))"


@query(f"WITH {_ONCE} SELECT p.url, m.method, m.method || CASE WHEN m.sent <> '' THEN ' ' || m.sent ELSE '' END AS title FROM p, (VALUES ('GET', ''), ('POST', 'one'), ('POST', 'two'), ('PUT', '{{\"a\":1}}')) m(method, sent)")
def crawl_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several requests to each URL: every one has its own answer."""
    asked = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(b).alias("body"), F.lit(j).alias("json_body")) for m, b, j in (("GET", None, None), ("POST", "one", None), ("POST", "two", None), ("PUT", "lost", '{"a":1}'))))
    seeds = pages(spark, sf_dir).select("url", F.explode(asked).alias("a")).select("url", "a.*")
    done = C.crawl(spark, seeds, lambda page, row: ([{"url": row["request_url"], "method": row["method"], "title": page.value("title::text")}], []), new_path(spark, "crawl"), fetch=_echo)
    j = lambda k: F.get_json_object("item", f"$.{k}").alias(k)
    return done.items.select(j("url"), j("method"), j("title"))


@query("""WITH q AS (SELECT DISTINCT split_part(url, '#', 1) AS u, CAST(strlen(split_part(url, '#', 1)) % 5 AS INT) AS priority FROM pages), r AS (SELECT u, priority, row_number() OVER (ORDER BY priority DESC, sha256('GET' || u) DESC) - 1 AS place, count(*) OVER () AS n FROM q)
SELECT CAST(place // ((n + 2) // 3) AS INT) AS round, priority, u AS url, 'parsed' AS outcome FROM r""")
def crawl_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue taken by thirds, highest priority first; the crawl is paused after the first and resumed from its checkpoint."""
    p = pages(spark, sf_dir).select(F.regexp_replace("url", "#.*", "").alias("url")).distinct().withColumn("priority", F.octet_length("url") % 5)
    third, path = (p.count() + 2) // 3, new_path(spark, "crawl")
    first = C.crawl(spark, p, _title, path, C.CrawlConfig(max_rounds=1, round_requests=third), fetch=_echo)
    done = C.crawl(spark, p.where("false"), _title, path, C.CrawlConfig(round_requests=third), fetch=_echo) if first.paused else first
    return done.events.select("round", "priority", "url", "outcome")


def _marked(request: dict, row: dict) -> dict | None:
    """A rule's function: drops links with an umlaut, marks the others."""
    return None if "%C3" in request["url"] else request | {"callback": "item", "priority": request["priority"] + 1, "meta": {"from": row["request_url"][:4]}}


@query(f"WITH {_ONCE}, l AS ({_LINKS}) SELECT DISTINCT link AS url, 'item' AS callback, 4 AS priority FROM l SEMI JOIN p USING (url) WHERE link NOT LIKE '%\\%C3%' ESCAPE '\\'")
def crawl_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule's function makes of the links that it gets: callback, priority, or nothing."""
    p = pages(spark, sf_dir)
    cache = p.select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"))
    rules = [spiders.CrawlRule(LinkRules(process=lambda u: None if u.endswith("#") else u), 3, process=_marked)]
    done = C.crawl(spark, p.select("url"), spiders.crawl_spider(rules), new_path(spark, "crawl"), cache=cache)
    return done.events.where("round = 1").select("url", "callback", "priority")


@query(f"WITH {_ONCE} SELECT url, CAST(CASE WHEN strlen(url) % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS items, CAST(strlen(url) % 2 AS BIGINT) AS dropped FROM p")
def crawl_item_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function on every scraped item keeps it or drops it."""
    config = C.CrawlConfig(on_item=lambda i: i if i["n"] % 2 == 0 else None)
    done = C.crawl(spark, pages(spark, sf_dir).select("url"), lambda page, row: ([{"n": len(row["request_url"].encode())}], []), new_path(spark, "crawl"), config, fetch=_echo)
    return done.events.select("url", "items", "dropped")


@query(f"""WITH r(allow, n, pat) AS (VALUES {_RULE_ROWS}), t AS (SELECT split_part(url, '#', 1) AS url, regexp_extract(split_part(url, '#', 1), '^https?://[^/]+(/.*)$', 1) AS target FROM pages),
d AS (SELECT url, coalesce((max(n * 2 + CASE WHEN allow THEN 1 ELSE 0 END) FILTER (WHERE regexp_matches(target, pat))) % 2 = 1, true) AS allowed FROM t, r GROUP BY url) SELECT url, CASE WHEN allowed THEN 'parsed' ELSE 'robots' END AS outcome FROM d""")
def crawl_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots documents are fetched by the crawl, one an origin."""

    def answer(requests: DataFrame) -> DataFrame:
        return _echo(requests).withColumn("body", F.when(F.col("request_url").endswith("/robots.txt"), F.lit(ROBOTS)).otherwise(F.col("body")))

    done = C.crawl(spark, pages(spark, sf_dir).select("url"), _title, new_path(spark, "crawl"), C.CrawlConfig(robots_txt_obey=True, user_agent="weft"), fetch=answer)
    return done.events.select(F.regexp_replace("url", "#.*", "").alias("url"), "outcome")


@query("SELECT url, cached, true AS same FROM (SELECT DISTINCT split_part(url, '#', 1) AS url FROM pages), (VALUES (false), (true)) t(cached)")
def crawl_cache_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In development mode the first run writes the cache and the second one is replayed from it."""
    p = pages(spark, sf_dir).select(F.regexp_replace("url", "#.*", "").alias("url"))
    cache, config = ResponseCache(spark, new_path(spark, "cache")), C.CrawlConfig(development_mode=True)
    runs = [C.crawl(spark, p, _title, new_path(spark, "crawl"), config, cache=cache, fetch=_echo) for _ in range(2)]
    events = runs[0].events.unionByName(runs[1].events)
    return events.select("url", "cached", (F.col("bytes") == len("<title>GET </title>")).alias("same"))


@query("SELECT count(*) AS pending, false AS empty, (SELECT count(*) FROM (SELECT DISTINCT split_part(url, '#', 1) FROM pages)) AS seen FROM (SELECT DISTINCT split_part(url, '#', 1) FROM pages)")
def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frontier.first_wins(frontier.requests(pages(spark, sf_dir)))
    seen = frontier.restored(rows.select("fp"), rows)
    return frontier.counted(rows).crossJoin(F.broadcast(seen.agg(F.count("*").alias("seen"))))


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")


def _cache(rows: DataFrame) -> DataFrame:
    return rows.select("url", F.lit(200).alias("status"), F.lit("text/plain").alias("content_type"), "body")


def _listed(line: Column, head: str, foot: str) -> Column:
    return F.concat(F.lit(head), F.array_join(F.collect_list(line), ""), F.lit(foot)).alias("body")


@query("SELECT n_name AS title, 'http://s.test/n/' || n_nationkey AS url FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND n_nationkey <> 3")
def crawl_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt, an index, sitemaps of which one isn't followed, pages of which one matches no rule."""
    nation, region = _site(spark, sf_dir)
    base = "http://s.test"
    robots = spark.createDataFrame([(f"{base}/robots.txt", "Sitemap: /index.xml")], "url string, body string")
    index = region.groupBy(F.lit(f"{base}/index.xml").alias("url")).agg(_listed(F.concat(F.lit("<sitemap><loc>/m/"), "r_name", F.lit(".xml</loc></sitemap>")), "<sitemapindex>", "</sitemapindex>"))
    maps = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).groupBy(F.concat(F.lit(f"{base}/m/"), F.replace("r_name", F.lit(" "), F.lit("%20")), F.lit(".xml")).alias("url")).agg(_listed(F.concat(F.lit("<url><loc>/n/"), F.col("n_nationkey").cast("string"), F.lit("</loc></url>")), "<?xml version='1.0'?><urlset>", "</urlset>"))
    leaves = nation.select(F.concat(F.lit(f"{base}/n/"), F.col("n_nationkey").cast("string")).alias("url"), F.concat(F.lit("<title>"), "n_name", F.lit("</title>")).alias("body"))
    cache = _cache(robots.unionByName(index).unionByName(maps).unionByName(leaves))
    spider = spiders.sitemap_template([f"{base}/robots.txt"], [spiders.CrawlRule(LinkRules(deny=("/n/3$",), deny_extensions=frozenset()))], lambda p, r: _title(p, r)[0], LinkRules(deny=("ASIA",), deny_extensions=frozenset()))
    done = spider.run(spark, new_path(spark, "crawl"), cache=cache)
    j = lambda k: F.get_json_object("item", f"$.{k}").alias(k)
    return done.items.select(j("title"), j("url"))


@query("SELECT 'csv' AS feed, lower(n_name) AS name FROM nation UNION ALL SELECT 'xml', lower(n_name) FROM nation WHERE n_nationkey <> 7")
def crawl_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions on the rows of a CSV feed and on the nodes of an XML feed, which may make more items of one, or none."""
    nation, _ = _site(spark, sf_dir)
    csv = nation.groupBy(F.lit("http://f.test/a.csv").alias("url")).agg(_listed(F.concat(F.col("n_nationkey").cast("string"), F.lit(';"'), "n_name", F.lit('"\r\n')), "", ""))
    xml = nation.groupBy(F.lit("http://f.test/a.xml").alias("url")).agg(_listed(F.concat(F.lit("<nation><key>"), F.col("n_nationkey").cast("string"), F.lit("</key><name>"), "n_name", F.lit("</name></nation>")), "<all>", "</all>"))
    cache = _cache(csv.unionByName(xml))
    one = spiders.csv_feed_template(["http://f.test/a.csv"], ";", ["key", "name"], lambda f, row: [{"feed": "csv", "name": f["name"].lower()}])
    two = spiders.xml_feed_template(["http://f.test/a.xml"], "nation", lambda f, row: [{"feed": "xml", "name": f["name"].lower()}] if f["key"] != "7" else [])
    items = [s.run(spark, new_path(spark, "crawl"), cache=cache).items for s in (one, two)]
    j = lambda k: F.get_json_object("item", f"$.{k}").alias(k)
    return items[0].unionByName(items[1]).select(j("feed"), j("name"))


@query("SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS identifier, 'https://shop.test/collections/r' || n_regionkey || '/products/n' || n_nationkey AS url FROM nation")
def crawl_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's collections and products page by page until one is empty."""
    nation, region = _site(spark, sf_dir)
    top = "https://shop.test"
    page = lambda path, k: f"{top}/{path}.json?page={k}&limit=250"
    collection = F.to_json(F.struct(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("handle"), F.lit(3).alias("products_count")))
    first = region.groupBy(F.lit(page("collections", 1)).alias("url")).agg(F.concat(F.lit('{"collections": ['), F.array_join(F.collect_list(collection), ","), F.lit("]}")).alias("body"))
    variant = F.struct(F.col("n_nationkey").alias("id"), F.lit("Default Title").alias("title"))
    product = F.to_json(F.struct(F.col("n_name").alias("title"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("handle"), F.array(variant).alias("variants")))
    where = F.concat(F.lit(f"{top}/collections/r"), F.col("n_regionkey").cast("string"), F.lit("/products.json?page=1&limit=250"))
    products = nation.groupBy(where.alias("url")).agg(F.concat(F.lit('{"products": ['), F.array_join(F.collect_list(product), ","), F.lit("]}")).alias("body"))
    ends = region.select(F.concat(F.lit(f"{top}/collections/r"), F.col("r_regionkey").cast("string"), F.lit("/products.json?page=2&limit=250")).alias("url"), F.lit('{"products": []}').alias("body"))
    cache = _cache(first.unionByName(products).unionByName(ends))
    done = spiders.shop_template("shop.test").run(spark, new_path(spark, "crawl"), cache=cache)
    j = lambda k: F.get_json_object("item", f"$.{k}")
    return done.items.select(j("name").alias("name"), j("identifier").cast("long").alias("identifier"), j("url").alias("url"))
