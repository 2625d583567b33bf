"""Queries over pages: extraction, nodes, navigation, links and robots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..kernel.links import LinkRules
from ..operators import extract as E
from ..operators import navigate as N
from ..operators import robots as R
from .register import Registry, spread, table

query = Registry()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def numbered(p: DataFrame) -> DataFrame:
    """Pages with addresses of their own, as several pages may have one URL: keyed stores hold one entry an address."""
    return p.withColumn("url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))


def _decoded(x: str) -> str:
    for name, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _path(h: str) -> str:
    return f"replace(replace(url_encode({h}), '%2F', '/'), '%2C', ',')"


_ORIGIN = "regexp_extract(url, '^(https?://[^/]+)', 1)"
_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
_LINKS = f"SELECT page_id, url, unnest(list_distinct(list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda h: {_ORIGIN} || {_path('h')}))) AS link FROM pages"
_LI = "SELECT page_id, unnest(range(len(m))) AS pos, unnest(m) AS value FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS m FROM pages)"


@query(f"WITH l AS ({_LINKS}) SELECT page_id, link FROM l")
def links_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.links(pages(spark, sf_dir), keep=["page_id"]).select("page_id", "link")


@query(f"WITH l AS ({_LINKS}) SELECT {_HOST} AS host, count(*) AS n_links FROM l GROUP BY 1")
def links_count_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.links(pages(spark, sf_dir), keep=["url"])
    return found.groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n_links"))


@query(f"WITH l AS ({_LINKS}) SELECT page_id, link FROM l WHERE regexp_matches(link, '/[a-t][^/]*$') AND NOT regexp_matches(link, '%C3|s$')")
def links_allow_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.links(pages(spark, sf_dir), LinkRules(allow=("/[a-t][^/]*$",), deny=("%C3", "s$")), keep=["page_id"]).select("page_id", "link")


@query(f"""WITH l AS ({_LINKS}), h AS (SELECT *, {_HOST} AS host FROM l)
SELECT page_id, link FROM h WHERE (host = 'example.com' OR host LIKE '%.example.com' OR host LIKE '%.example.net') AND NOT (host LIKE 'blog.%' AND host LIKE '%.ththan.example.net')""")
def links_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = LinkRules(allow_domains=("example.com", "Example.net"), deny_domains=("blog.ththan.example.net",))
    return E.links(pages(spark, sf_dir), rules, keep=["page_id"]).select("page_id", "link")


@query(f"WITH u AS (SELECT page_id, url, lower(regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '([^/]*)$', 1)) AS last FROM pages) SELECT page_id, url FROM u WHERE NOT regexp_matches(last, '\\.html$')")
def links_deny_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "url").where(U.passes(F.col("url"), LinkRules(deny_extensions=frozenset({"html", "tar.gz"}))))


@query(f"WITH l AS ({_LINKS}) SELECT page_id, link FROM l")
def links_restrict_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.links(pages(spark, sf_dir), LinkRules(restrict_css=("nav", "ul > li")), keep=["page_id"]).select("page_id", "link")


@query(f"SELECT page_id, rtrim({_decoded('''regexp_extract(html, '<title>(.*?)</title>', 1)''')}) AS title FROM pages WHERE regexp_matches(html, '<title>.+?</title>')")
def title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extract(pages(spark, sf_dir), {"title": "title::text"}, keep=["page_id"]).where("title is not null")


@query(f"SELECT page_id, rtrim({_decoded('''regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')''')}) AS value FROM pages WHERE html LIKE '%<h1>%'")
def h1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.values(pages(spark, sf_dir), "article > h1::text", keep=["page_id"]).select("page_id", "value")


@query(f"SELECT page_id, rtrim({_decoded('''regexp_replace(regexp_extract(html, '(?s)<footer>(.*?)(</footer>|$)', 1), '<[^>]*>', '', 'g')''')}) AS value FROM pages WHERE html LIKE '%<footer>%'")
def footer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.values(pages(spark, sf_dir), "footer::text", keep=["page_id"]).select("page_id", "value")


@query(f"""WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<p>')[2:]) AS p FROM pages),
t AS (SELECT page_id, rtrim({_decoded("regexp_replace(p, '<[^>]*>', '', 'g')")}) AS value FROM p)
SELECT page_id, value, count(*) AS n FROM t WHERE value <> '' GROUP BY ALL""")
def paragraph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.values(pages(spark, sf_dir), "article p::text", keep=["page_id"]).groupBy("page_id", "value").agg(F.count("*").alias("n"))


@query(f"WITH l AS ({_LI}) SELECT page_id, pos, {_decoded('''regexp_replace(value, '<[^>]*>', '', 'g')''')} AS value FROM l")
def li_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.values(pages(spark, sf_dir), "nav li::text", keep=["page_id"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH l AS ({_LI}) SELECT page_id, pos, regexp_extract(value, 'href=\"([^\"]*)\"', 1) AS value FROM l")
def li_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.values(pages(spark, sf_dir), "li > a[href]::attr(href)", keep=["page_id"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH l AS ({_LI}) SELECT page_id, pos, {_decoded('''regexp_replace(value, '<[^>]*>', '', 'g')''')} AS value FROM l")
def chained_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chained(pages(spark, sf_dir), ["nav", "li", "a::text"], keep=["page_id"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH l AS ({_LI}) SELECT page_id, pos, {_decoded('''regexp_replace(value, '<[^>]*>', '', 'g')''')} AS label, regexp_extract(value, 'href=\"([^\"]*)\"', 1) AS href FROM l")
def extract_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extract(pages(spark, sf_dir), {"label": "a::text", "href": "a::attr(href)"}, each="nav li", keep=["page_id"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, 'charset="([^"]*)"', 1) AS charset,
rtrim({_decoded("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title, regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link,
CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links, regexp_extract(html, 'track\\((\\d+)\\)', 1) AS track FROM pages""")
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"lang": "html::attr(lang)", "charset": "meta::attr(charset)", "title": "title::text", "first_link": "a::attr(href)", "links": E.Field("a::attr(href)", many=True), "track": E.Field("script", regex=r"track\((\d+)\)")}
    got = E.extract(pages(spark, sf_dir), fields, keep=["page_id"])
    return got.select("page_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "charset", "title", "first_link", "track")), F.size("links").cast("long").alias("n_links"))


@query(f"SELECT page_id, rtrim({_decoded('''regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)''')}) AS value FROM pages WHERE html LIKE '%<div class=\"ad\">%</div>%'")
def ad_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.values(pages(spark, sf_dir), "div.ad::text", keep=["page_id"]).select("page_id", "value")


@query(f"""WITH a AS (SELECT page_id, unnest(string_split_regex(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*>')) AS part, generate_subscripts(string_split_regex(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*>'), 1) AS k FROM pages WHERE html LIKE '%<article>%'),
t AS (SELECT page_id, k, trim({_decoded('part')}) AS part FROM a)
SELECT page_id, coalesce(string_agg(part, ' ' ORDER BY k) FILTER (WHERE part <> ''), '') AS value FROM t GROUP BY page_id""")
def all_text_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", E.all_text(F.col("html"), "article", " ", True, ("script", "style")).alias("value")).where("value is not null")


@query(f"WITH l AS ({_LI}) SELECT page_id, pos, '<li>' || value || '</li>' AS value FROM l")
def outer_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.values(pages(spark, sf_dir), "ul > li", keep=["page_id"]).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH t AS (SELECT unnest(['li', 'a', 'h1', 'nav', 'ul', 'title', 'footer', 'div', 'article', 'script', 'style', 'meta']) AS tag)
SELECT tag, CAST(sum(len(regexp_extract_all(html, '<' || tag || '[ >]'))) AS BIGINT) AS n FROM pages, t GROUP BY tag""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = E.nodes(pages(spark, sf_dir), keep=[])
    return N.elements(n).where(F.col("tag").isin("li", "a", "h1", "nav", "ul", "title", "footer", "div", "article", "script", "style", "meta")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_children FROM pages WHERE html LIKE '%<ul>%'")
def children_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = E.nodes(pages(spark, sf_dir), keep=["page_id"])
    ul = n.where("tag = 'ul'").select("page_id", "node_id")
    return ul.join(N.child_counts(n), ["page_id", "node_id"], "left").select("page_id", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) * (len(regexp_extract_all(html, '<li>')) - 1) AS n_pairs FROM pages WHERE len(regexp_extract_all(html, '<li>')) > 1")
def sibling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = E.nodes(pages(spark, sf_dir), keep=["page_id"]).where("tag = 'li'")
    return N.siblings(li).groupBy("page_id").agg(F.count("*").alias("n_pairs"))


@query(f"""WITH l AS ({_LI}), t AS (SELECT page_id, pos, {_decoded("regexp_replace(value, '<[^>]*>', '', 'g')")} AS value FROM l)
SELECT page_id, pos, value, lag(value) OVER w AS previous, lead(value) OVER w AS next, CASE WHEN count(*) OVER (PARTITION BY page_id) > 1 THEN pos + 1 ELSE 0 END AS nth FROM t WINDOW w AS (PARTITION BY page_id ORDER BY pos)""")
def next_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One parse and one shuffle by page: each item takes its link's text along, and the windows carry it to its neighbours.
    n = E.nodes(pages(spark, sf_dir), keep=["page_id"]).where("tag in ('li', 'a')").repartition("page_id")
    mine, link = F.col("tag") == "li", F.col("tag") == "a"
    li = n.groupBy("page_id", F.when(mine, F.col("node_id")).otherwise(F.col("parent_id")).alias("node_id")).agg(*(F.max(F.when(mine, F.col(c))).alias(c) for c in ("parent_id", "sib_pos", "kind", "tag")), F.max(F.when(link, F.col("text"))).alias("value"))
    out = N.nth_of_type(N.neighbours(li.where("tag = 'li'"), carry=("value",)))
    return out.select("page_id", F.col("sib_pos").cast("long").alias("pos"), "value", F.col("previous_value").alias("previous"), F.col("next_value").alias("next"), F.col("nth").cast("long").alias("nth"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n FROM pages WHERE html LIKE '%<nav>%<li>%'")
def descendant_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = E.nodes(pages(spark, sf_dir), keep=["page_id"])
    return N.descendants(n.where("tag = 'nav'"), n.where("tag = 'li'")).groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"""WITH l AS ({_LI}), c AS (SELECT page_id, pos, count(*) OVER (PARTITION BY page_id) AS n FROM l)
SELECT page_id, pos, 'body > nav > ul > li' || CASE WHEN n > 1 THEN ':nth-of-type(' || (pos + 1) || ')' ELSE '' END AS css_path, '//body/nav/ul/li' || CASE WHEN n > 1 THEN '[' || (pos + 1) || ']' ELSE '' END AS xpath_path FROM c""")
def element_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.paths(pages(spark, sf_dir), "li", keep=["page_id"]).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<div class="ad">')) AS BIGINT) AS n FROM pages WHERE html LIKE '%<div class="ad">%'""")
def has_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nodes(pages(spark, sf_dir), keep=["page_id"]).where(N.has_class("ad")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("""SELECT page_id, 'href' AS name, CAST(len(regexp_extract_all(html, '<a href="[^"]*th[^"]*"')) AS BIGINT) AS n FROM pages WHERE regexp_matches(html, '<a href="[^"]*th[^"]*"')""")
def search_attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = E.nodes(pages(spark, sf_dir), keep=["page_id"]).where("tag = 'a'")
    return a.select("page_id", F.explode(N.search_values("th", partial=True)).alias("v")).groupBy("page_id", F.col("v.name").alias("name")).agg(F.count("*").alias("n"))


@query(None)
def find_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    got = pages(spark, sf_dir).select("page_id", E.find_by_text(h, "the", partial=True).alias("first"), E.find_by_text(h, "the", first=False, partial=True).alias("last"), E.find_by_regex(h, "(?i)the").alias("regex"), F.size(E.find_all_by_text(h, "THE", partial=True, case_sensitive=False)).alias("n_all"))
    return got.select("page_id", "n_all", *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("first", "last", "regex") for c in ("node_id", "tag")))


@query("SELECT page_id, regexp_extract(html, 'track\\((\\d+)\\)', 1) AS first, CAST(len(regexp_extract_all(html, '&[a-z]+;')) AS BIGINT) AS n_entities, CAST(len(regexp_extract_all(html, '(?i)TH(?:E|AN)')) AS BIGINT) AS n_ci FROM pages")
def regex_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return pages(spark, sf_dir).select("page_id", F.coalesce(X.re_first(h, r"track\((\d+)\)"), F.lit("")).alias("first"), F.size(X.re_all(h, "&[a-z]+;")).cast("long").alias("n_entities"), F.size(X.re_all(h, "th(?:e|an)", case_sensitive=False)).cast("long").alias("n_ci"))


@query(f"""WITH u AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages)
SELECT page_id, CASE WHEN u LIKE '%?%' THEN split_part(u, '?', 1) || '?' || array_to_string(list_sort(list_filter(string_split(split_part(u, '?', 2), '&'), lambda x: x <> '')), '&') ELSE u END AS canonical FROM u""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.canonicalize(F.col("url")).alias("canonical"))


@query("SELECT page_id, sha256('GET' || split_part(url, '#', 1)) AS fp, sha256(url) || '_' || strlen(url) AS storage_key, sha256(url) AS cache_key FROM pages")
def url_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.fingerprint(u).alias("fp"), U.storage_key(u).alias("storage_key"), U.cache_key(u).alias("cache_key"))


@query(f"SELECT page_id, regexp_extract(url, '^(https?):', 1) AS scheme, {_HOST} AS host, {_ORIGIN} AS origin, regexp_extract(split_part(url, '#', 1), '^https?://[^/]+(/.*)$', 1) AS target, nullif(split_part(url, '#', 2), '') AS fragment FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).withColumn("p", U.url_parts(F.col("url"))).select("page_id", "p.scheme", "p.host", "p.origin", "p.target", "p.fragment")


@query(f"SELECT page_id, {_ORIGIN} || '/next?q=1' AS absolute, regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^(.*/)[^/]*$', 1) || 'b' AS sibling, split_part(split_part(url, '#', 1), '?', 1) || '?x=2' AS same FROM pages")
def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.url_join(u, F.lit("/a/../next?q=1")).alias("absolute"), U.url_join(u, F.lit("./b")).alias("sibling"), U.url_join(u, F.lit("?x=2")).alias("same"))


@query("SELECT page_id, url AS target FROM pages")
def search_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    return pages(spark, sf_dir).select("page_id", U.search_target(href).alias("target"))


_AGENTS = ["Chrome/131.0.0.0 Safari/537.36"] * 3 + ["Firefox/133.0"] * 2


@query(f"WITH b AS (SELECT page_id, list_sum(list_transform(string_split(url, ''), lambda c: ord(c))) % 5 AS k, (row_number() OVER (ORDER BY page_id) - 1) % 3 AS r FROM pages) SELECT page_id, list_value({', '.join(repr(a) for a in _AGENTS)})[CAST(k AS INT) + 1] AS agent_end, list_value('p0', 'p1', 'p2')[CAST(r AS INT) + 1] AS proxy FROM b")
def agents_and_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.rank import row_index

    numbered = row_index(pages(spark, sf_dir).select("page_id", "url"), ["page_id"], "k")
    return numbered.select("page_id", F.regexp_extract(U.user_agent(F.col("url")), r"((?:Chrome|Firefox)/.*)$", 1).alias("agent_end"), U.proxy(F.col("k"), ["p0", "p1", "p2"]).alias("proxy"))


ROBOTS = """# a comment
User-agent: *
Disallow: /no
Crawl-delay: 2

User-agent: Weft
User-agent: other
Disallow: /
Allow: /en/
Allow: /de/*.html
Disallow: /en/*7.html$
Disallow: /*?utm_source
Allow: /es
Crawl-delay: 1.5
Sitemap: https://example.com/map.xml # main
"""
_RULES = [(False, "/", "^/"), (True, "/en/", "^/en/"), (True, "/de/*.html", "^/de/.*\\.html"), (False, "/en/*7.html$", "^/en/.*7\\.html$"), (False, "/*?utm_source", "^/.*\\?utm_source"), (True, "/es", "^/es")]
_RULE_ROWS = ", ".join(f"({str(a).lower()}, {len(p)}, '{r}')" for a, p, r in _RULES)


@query(f"""WITH r(allow, n, pat) AS (VALUES {_RULE_ROWS}),
t AS (SELECT page_id, regexp_extract(split_part(url, '#', 1), '^https?://[^/]+(/.*)$', 1) AS target FROM pages)
SELECT page_id, coalesce((max(n * 2 + CASE WHEN allow THEN 1 ELSE 0 END) FILTER (WHERE regexp_matches(target, pat))) % 2 = 1, true) AS allowed FROM t, r GROUP BY page_id""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", "url")
    docs = p.select(U.origin(F.col("url")).alias("origin")).distinct().withColumn("body", F.lit(ROBOTS))
    return R.allowed(p, R.rules(docs, "Weft/1.0 (+https://example.com)")).select("page_id", "allowed")


@query(f"WITH o AS (SELECT DISTINCT {_ORIGIN} AS origin FROM pages), r(pos, allow, pattern, specificity) AS (VALUES {', '.join(f"({i}, {str(a).lower()}, '{p}', {len(p)})" for i, (a, p, _) in enumerate(_RULES))}) SELECT origin, CAST(pos AS BIGINT) AS pos, allow, pattern, CAST(specificity AS BIGINT) AS specificity, 1.5::DOUBLE AS delay, 'https://example.com/map.xml' AS sitemap FROM o, r")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pages(spark, sf_dir).select(U.origin(F.col("url")).alias("origin")).distinct().withColumn("body", F.lit(ROBOTS))
    rows = R.rule_rows(docs, "weft").join(R.rules(docs, "weft").select("origin", "delay"), "origin").join(R.sitemaps(docs).select("origin", "sitemap"), "origin")
    return rows.select("origin", F.col("pos").cast("long").alias("pos"), "allow", "pattern", F.col("specificity").cast("long").alias("specificity"), "delay", "sitemap")


@query(f"SELECT page_id FROM pages WHERE {_HOST} IN ('thther.example.org', 'blog.tionsh.example.net')")
def allowed_domains_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("thther.example.org",), ("blog.tionsh.example.net",)], "host string")
    p = pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))
    return p.join(F.broadcast(allowed), "host", "left_semi").select("page_id")


@query("SELECT page_id, html AS text, 'utf-8' AS charset FROM pages")
def decode_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit('text/html; charset="utf-8"')
    return pages(spark, sf_dir).select("page_id", U.decode_body(F.encode("html", "UTF-8"), kind).alias("text"), U.charset(kind).alias("charset"))


@query(f"WITH l AS ({_LI}) SELECT page_id, pos, 100.0::DOUBLE AS score FROM l")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import relocate

    li = E.fingerprints(pages(spark, sf_dir), "li", keep=["page_id"])
    first = li.where("pos = 0").select("page_id", F.col("element").alias("original"))
    return li.join(first, "page_id").select("page_id", F.col("pos").cast("long").alias("pos"), relocate.similarity_score(F.col("original"), F.col("element")).alias("score"))


# Of tag, text, attributes, path, parent's name, parent's attributes and siblings these agree: 0, 1, 0, 1/2, 2/7, 1, 1; without siblings there are six checks.
@query("""SELECT page_id, 'heading' AS identifier, '<div class="t">' || replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&quot;', '"') || '</div>' AS html,
CASE WHEN regexp_matches(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<p>') THEN 54.08 ELSE 46.43 END::DOUBLE AS score FROM pages WHERE html LIKE '%<h1>%'""")
def adaptive_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import relocate

    p = numbered(pages(spark, sf_dir))
    saved = E.fingerprints(p, "h1", keep=["url"]).select("url", F.lit("heading").alias("identifier"), "element")
    # The redesign: headings become divs with a class, and articles sections.
    new = p.select("page_id", "url", F.replace(F.replace(F.replace("html", F.lit("<h1>"), F.lit('<div class="t">')), F.lit("</h1>"), F.lit("</div>")), F.lit("article>"), F.lit("section>")).alias("html"))
    return relocate.relocate(new, saved).select("page_id", "identifier", "html", "score")
