"""Operators on small tables: crawls, spiders, stores, exports, fetching, throttling, text columns."""

import http.server
import json
import threading
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import url as U
from weftline.kernel import throttle as KT
from weftline.kernel.fetching import FetchConfig
from weftline.kernel.links import LinkRules
from weftline.operators import crawl as C
from weftline.operators import extract as E
from weftline.operators import frontier, relocate, spiders, throttle
from weftline.sources import export, fetch
from weftline.sources.tables import Snapshots

SITE = {
    "http://site.test/": '<a href="/a">a</a><a href="/b?y=1&x=2">b</a><a href="http://other.test/">o</a><a href="/priv/x">p</a>',
    "http://site.test/a": '<title>A</title><a href="/">home</a><a href="/b?x=2&y=1#f">b</a><a href="/gone">g</a>',
    "http://site.test/b?x=2&y=1": "<title>B</title><a href='/a'>a</a>",
}


def site(spark, extra=()):
    rows = [(u, 200, "text/html", b) for u, b in SITE.items()] + list(extra)
    return spark.createDataFrame(rows, "url string, status int, content_type string, body string")


def titles(page, row):
    t = page.value("title::text")
    return [{"url": page.url, "title": t}] if t else []


def test_crawl_with_robots_offsite_and_cycles(spark, tmp_path):
    docs = spark.createDataFrame([("http://site.test", "User-agent: *\nDisallow: /priv")], "origin string, body string")
    config = C.CrawlConfig(allowed_domains=("site.test",), robots_txt_obey=True, on_item=lambda i: i if i["title"] != "B" else None)
    seeds = spark.createDataFrame([("http://site.test/",)], "url string")
    done = C.crawl(spark, seeds, spiders.crawl_spider([spiders.CrawlRule()], titles), f"file://{tmp_path}/c", config, cache=site(spark), robots_docs=docs)
    got = {r["url"]: r["outcome"] for r in done.events.collect()}
    assert got == {"http://site.test/": "parsed", "http://site.test/a": "parsed", "http://site.test/b?x=2&y=1": "parsed", "http://other.test/": "offsite", "http://site.test/priv/x": "robots", "http://site.test/gone": "failed"}
    assert [json.loads(r["item"])["title"] for r in done.items.collect()] == ["A"] and done.completed
    c = done.counters().first()
    assert (c["cache_hits"], c["robots_disallowed_count"], c["offsite_requests_count"], c["failed_requests_count"], c["items_scraped"], c["items_dropped"], c["requests_count"]) == (3, 1, 1, 1, 1, 1, 0)


def test_crawl_pauses_and_goes_on(spark, tmp_path):
    path, seeds = f"file://{tmp_path}/c", spark.createDataFrame([("http://site.test/",)], "url string")
    parser = spiders.crawl_spider([spiders.CrawlRule(LinkRules(allow_domains=("site.test",)))], titles)
    first = C.crawl(spark, seeds, parser, path, C.CrawlConfig(max_rounds=1), cache=site(spark))
    assert first.paused and first.events.count() == 1
    again = C.crawl(spark, seeds.where("false"), parser, path, C.CrawlConfig(), cache=site(spark))
    assert again.completed and again.events.count() == 5 and again.events.select("fp").distinct().count() == 5
    C.cleanup(spark, path)
    assert not (tmp_path / "c").exists()


def test_blocked_responses_are_tried_again(spark, tmp_path):
    seeds = spark.createDataFrame([("http://x.test/",), ("http://y.test/",)], "url string")

    def answer(requests):
        status = F.when(F.col("url").contains("x.test"), 403).otherwise(500)
        return requests.select(F.col("url").alias("request_url"), "url", status.alias("status"), F.lit("t").alias("content_type"), F.lit("<title>t</title>").alias("body"))

    done = C.crawl(spark, seeds, spiders.crawl_spider([], titles), f"file://{tmp_path}/c", C.CrawlConfig(max_blocked_retries=2), fetch=answer)
    got = sorted((r["url"], r["retry_count"], r["outcome"]) for r in done.events.collect())
    # A status of 500 isn't a block: the page is parsed.
    assert got == [("http://x.test/", 0, "blocked"), ("http://x.test/", 1, "blocked"), ("http://x.test/", 2, "blocked"), ("http://y.test/", 0, "parsed")]


def test_a_parser_error_is_an_outcome_of_its_row(spark, tmp_path):
    def parser(page, row):
        raise ValueError("no")

    done = C.crawl(spark, spark.createDataFrame([("http://site.test/",)], "url string"), parser, f"file://{tmp_path}/c", cache=site(spark))
    assert [r["error"] for r in done.events.collect()] == ["ValueError: no"]


def test_sitemap_and_feed_spiders(spark, tmp_path):
    pages = [
        ("http://s.test/robots.txt", 200, "text/plain", "Sitemap: /map.xml"),
        ("http://s.test/map.xml", 200, "x", "<sitemapindex><sitemap><loc>http://s.test/m1.xml</loc></sitemap><sitemap><loc>http://s.test/skip.xml</loc></sitemap></sitemapindex>"),
        ("http://s.test/m1.xml", 200, "x", "<urlset><url><loc>/art/1</loc></url><url><loc>/img/1</loc></url></urlset>"),
        ("http://s.test/art/1", 200, "x", "<title>One</title>"),
        ("http://s.test/feed.csv", 200, "x", "a,b\n1,2\n"),
    ]
    cache = site(spark, pages)
    parser = spiders.sitemap_spider([spiders.CrawlRule(LinkRules(allow=("/art/",)), priority=2)], titles, LinkRules(deny=("skip",), deny_extensions=frozenset()))
    done = C.crawl(spark, spark.createDataFrame([("http://s.test/robots.txt",)], "url string"), parser, f"file://{tmp_path}/s", cache=cache)
    assert [json.loads(r["item"])["title"] for r in done.items.collect()] == ["One"] and done.events.count() == 4
    done = C.crawl(spark, spark.createDataFrame([("http://s.test/feed.csv",)], "url string"), spiders.csv_feed_spider(), f"file://{tmp_path}/f", cache=cache)
    assert [r["item"] for r in done.items.collect()] == ['{"a":"1","b":"2"}']


def test_requests_frontier(spark):
    df = spark.createDataFrame([("http://a/#x", 1, None), ("http://a/#y", 5, None), ("http://b/", 1, True), ("http://b/", 1, True), (None, 9, None)], "url string, priority int, dont_filter boolean")
    rows = frontier.requests(df.withColumn("pos", F.col("priority")))
    kept = frontier.first_wins(rows)
    assert sorted(r["url"] for r in kept.collect()) == ["http://a/#x", "http://b/", "http://b/"]
    assert frontier.newly_seen(rows).count() == 1 and frontier.unseen(rows, rows.where("url like 'http://a%'").select("fp")).count() == 2
    assert [r["priority"] for r in frontier.dequeue(rows, 2).collect()] == [5, 1]
    fps = {r[0] for r in frontier.requests(df, keep_fragment=True).select("fp").collect()}
    assert len(fps) == 3


def test_throttle_fold_against_plain_loop(spark):
    rows = [("d", i, 0.1 * i, 0.3 * (i % 5), (200, 503, 404, 200)[i % 4], "2" if i % 3 else None, 0.1) for i in range(40)] + [("e", 1, 0.0, 1.0, 200, None, 0.0)]
    df = spark.createDataFrame(rows, "domain string, seq long, now_s double, latency_s double, status int, retry_after string, floor_s double")
    t, slot, want = KT.Throttle(0.5, 20.0, 1.5), None, []
    for d, seq, *event in rows[:-1]:
        slot, wait = throttle.step(t, slot, *event)
        want.append((d, seq, wait, slot.delay, slot.next_allowed))
    got = [tuple(r) for r in throttle.fold(df, t).where("domain = 'd'").orderBy("seq").collect()]
    assert got == want and throttle.fold(df.where("false"), t).count() == 0


def test_snapshots_and_adaptive_queries(spark, tmp_path):
    old = spark.createDataFrame([("http://s.test/p", '<div><article class="product" data-sku="1"><h2>Item</h2></article></div>')], "url string, html string")
    new = spark.createDataFrame([("http://S.test/p", '<main><section><article class="item product" data-sku="1"><h2>Item</h2></article></section></main>')], "url string, html string")
    store = Snapshots(spark, f"file://{tmp_path}/s")
    assert store.read().count() == 0
    first = relocate.css_adaptive(old, "div > article", store.read(), "card")
    store.save(first.where("pos = 0").withColumn("identifier", F.lit("card")))
    again = relocate.css_adaptive(new, "div > article", store.read(), "card").collect()
    assert [(r["relocated"], r["element"]["tag"]) for r in again] == [(True, "article")]
    store.save(relocate.css_adaptive(new, "main", store.read(), "card").withColumn("identifier", F.lit("card")))
    assert store.read().first()["element"]["tag"] == "main"
    assert store.retrieve(spark.createDataFrame([("HTTP://s.test/p", "card"), ("http://s.test/p", "none")], "url string, identifier string")).where("element is not null").count() == 1


def test_export_files(spark, tmp_path):
    from weftline.kernel import export as K

    values = [{"a": 'x,"', "n": None}, {"b": [1], "a": "l\nm"}, 5]
    items = spark.createDataFrame([(i, K.compact(v)) for i, v in enumerate(values)], "seq long, item string")
    for kind, want in (("csv", K.to_csv(values)), ("xml", K.to_xml(values)), ("jsonl", K.to_jsonl(values)), ("json", K.to_json(values))):
        path = str(tmp_path / kind)
        export.write_file(items, path, kind)
        assert open(path, encoding="utf-8", newline="").read() == want, kind
    export.write_file(items, str(tmp_path / "pretty"), "json", 2)
    assert json.load(open(tmp_path / "pretty")) == values
    export.write_file(items.where("false"), str(tmp_path / "none"), "csv")
    assert open(tmp_path / "none", newline="").read() == "\r\n"


class _Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/r":
            self.send_response(302)
            self.send_header("Location", "/ok")
            self.end_headers()
            return
        body = {"/ok": "<title>é</title>".encode("latin-1"), "/big": b"x" * 5000}.get(self.path, b"no")
        self.send_response(200 if self.path in ("/ok", "/big") else 404)
        self.send_header("Content-Type", "text/html; charset=latin-1")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch(spark, server):
    config = FetchConfig(retries=0, max_body_bytes=1000)
    asked = spark.createDataFrame([(f"{server}{p}", m, s) for p, m, s in (("/r", "GET", ""), ("/none", None, None), ("/big", "GET", ""), ("/ok", "PATCH", ""), ("/ok", "GET", "nope"))] + [("http://127.0.0.1:9/", "GET", "")], "url string, method string, session_id string")
    got = {(r["request_url"].rsplit("/", 1)[1], r["error_kind"]): (r["status"], r["body"]) for r in fetch.fetch_requests(asked, config).collect()}
    assert got[("r", None)] == (200, "<title>é</title>") and got[("none", None)] == (404, "no")
    assert {k[1] for k in got} == {None, "too_large", "unsupported_method", "session_not_found", "connect"}
    spark.dataSource.register(fetch.FetchSource)
    df = spark.read.format("weftline_fetch").option("urls", f"{server}/ok {server}/none").option("retries", "0").load()
    assert sorted(r["status"] for r in df.collect()) == [200, 404]
    robots = fetch.robots_documents(asked.select("url").limit(1), config)
    assert [r["body"] for r in robots.collect()] == [None]


def test_crawl_over_http(spark, server, tmp_path):
    config = C.CrawlConfig(autothrottle_enabled=True, autothrottle_start_delay=0.01, autothrottle_max_delay=0.05)
    seeds = spark.createDataFrame([(f"{server}/r",), (f"{server}/none",)], "url string")
    done = C.crawl(spark, seeds, spiders.crawl_spider([], titles), f"file://{tmp_path}/c", config, fetch=C.http(config, FetchConfig(retries=0)))
    assert sorted((r["outcome"], r["status"]) for r in done.events.collect()) == [("parsed", 200), ("parsed", 404)]
    # Items are told by the final address.
    assert [json.loads(r["item"]) for r in done.items.collect()] == [{"url": f"{server}/ok", "title": "é"}]
    assert done.counters().first()["requests_count"] == 2


def test_text_columns(spark):
    df = spark.createDataFrame([(" \xa0a\r\n\tb ",), ("",), (None,)], "t string")
    got = df.select(X.strip(F.col("t")), X.clean(F.col("t")), X.replace(F.col("t"), "", "-"), F.size(X.split(F.col("t"), "")), X.re_all(F.col("t"), "(x)?[ab]"), X.re_all(F.col("t"), "("), X.safe_segment(F.col("t"))).collect()
    assert got[0][0] == "a\r\n\tb" and got[0][1] == "a b" and got[1][2] == "-" and got[1][3] == 2 and got[0][4] == [] and got[0][5] == [] and got[1][6] == "_"
    assert got[2][0] is None and got[2][4] is None
    one = spark.createDataFrame([("http://a.test/x.tar.gz",), ("http://b.a.test/y",), ("ftp://a.test/",), ("no url",)], "u string")
    assert [r[0] for r in one.select(U.passes(F.col("u"), LinkRules(allow_domains=("a.test",)))).collect()] == [False, True, False, False]
    assert one.select(U.extension_chains(F.col("u"))).first()[0] == ["tar.gz", "gz"]


def test_extraction_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "http://a.test/", "<p>x")], "page_id int, url string, html string")
    got = {r["page_id"]: (r["t"], r["all"]) for r in E.extract(pages, {"t": "p::text", "all": E.Field("p", many=True, regex="x")}).collect()}
    assert got == {1: (None, []), 2: (None, []), 3: ("x", ["x"])}
    assert E.links(pages).count() == 0 and E.nodes(pages).where("page_id = 1").count() == 4
    assert E.extract(pages.where("false"), {"t": "p::text"}).count() == 0


def test_plain_urls_in_the_jvm_are_read_as_the_kernel_reads_them(spark):
    import random

    from weftline.kernel import url as K

    rng = random.Random(11)
    hosts = ["a.test", "A.test", "x-y.b.c", "1.2.3.4", "a.1", "a.0x1", "0x7f.1", "xn--a.b", "é.test", "a..b", "-a.b", "a.b.", "a_b.c", "[::1]", "u:p@a.test", "a.test:80", "a.test:8080", "", "localhost"]
    bits = ["/", "/a", "/b.c", "/.", "/..", "/.a", "/%2e", "/%2E%2e", "/é", "/a b", "\\\\", "/'", "/|", "/^", "/{", "/~!$&()*+,;=:@[]", "/`", '/"', "/%zz", "//"]
    queries = ["", "?", "?b=2&a=1", "?&&", "?q='", "?é", "?a b", "?x=`{}^|", "?a?b", "?b&a&", "?<", "?\\\\"]
    fragments = ["", "#", "#top", "#a#b", "#é", "#a b", "#`", "#<", "#{}?x"]
    urls = ["".join([rng.choice(["http://", "https://", "https://", "HTTP://", "ftp://", "file://", "//", "", "http:/", "mailto:"]), rng.choice(hosts), *rng.choices(bits, k=rng.randrange(4)), rng.choice(queries), rng.choice(fragments), rng.choice(["", "", "", "\n", " "])]) for _ in range(4000)]
    urls += ["".join([rng.choice(["http://", "https://"]), rng.choice(["a.test", "x-y.b.c", "localhost"]), *rng.choices(["/", "/a", "/b.c", "/'", "/~!$&()*+,;=:@[]", "/%zz", "/é", "/."], k=rng.randrange(1, 4)), rng.choice(queries), rng.choice(fragments)]) for _ in range(3000)]
    p = U.url_parts(F.col("u"))
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "u string")
    got = df.select("u", p.alias("p"), U.host(F.col("u")).alias("h"), U.origin(F.col("u")).alias("o"), U.normalize(F.col("u")).alias("n"), U.normalize(F.col("u"), True).alias("nf"), U.canonicalize(F.col("u")).alias("c"), U.canonicalize(F.col("u"), True).alias("cf"), F.col("u").rlike(U.PLAIN).alias("plain")).collect()
    for r in got[:-1]:
        u, k = r["u"], U._parts(r["u"])
        assert (r["p"].asDict() if r["p"] is not None else None) == k, u
        assert (r["h"], r["o"]) == (K.host(u), K.origin(u)), u
        assert (r["n"], r["nf"], r["c"], r["cf"]) == (K.without_fragment(u), K.without_fragment(u, True), K.canonicalize(u), K.canonicalize(u, True)), u
    assert 200 < sum(r["plain"] for r in got[:-1]) and got[-1]["p"] is None and got[-1]["n"] is None


def test_requests_to_one_domain_go_to_as_many_tasks_as_they_may(spark):
    from weftline.kernel.fetching import FetchConfig
    from weftline.sources.fetch import fetch_requests

    asked = spark.range(200).select(F.concat(F.lit("http://a.test/"), F.col("id").cast("string")).alias("url"), F.lit("PATCH").alias("method"), F.col("id").alias("seq"))
    for per_domain in (1, 8):
        got = fetch_requests(asked, FetchConfig(retries=0), per_domain=per_domain).select("seq", "error_kind", F.spark_partition_id().alias("task")).collect()
        assert sorted(r["seq"] for r in got) == list(range(200)) and {r["error_kind"] for r in got} == {"unsupported_method"}
        assert len({r["task"] for r in got}) == per_domain


def test_requests_of_the_same_settings_share_an_opener():
    from weftline.kernel import fetching as K

    assert K._opener(K.FetchConfig(), None) is K._opener(K.FetchConfig(), None)
    assert K._opener(K.FetchConfig(), None) is not K._opener(K.FetchConfig(verify_ssl=False), None)


def test_pages_of_one_url_are_cached_and_found_again_each_by_itself(spark, tmp_path):
    from weftline.plans import catalogue

    html = "<html><body><nav></nav><article><h1>{}</h1>\n<p>x</p></article></body></html>"
    rows = [(0, "http://a.test/x", html.format("one")), (1, "http://a.test/x", html.format("other")), (4, "http://a.test/x", html.format("three"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES["cache_lookup"](spark, str(tmp_path)).collect()
    # The status of page 4 is 403, which isn't kept.
    assert sorted(tuple(r) for r in got if r["hit"]) == [(k, True, len(h)) for k, _, h in rows[:2]] and [r["page_id"] for r in got if not r["hit"]] == [4]
    found = catalogue.QUERIES["adaptive_relocate"](spark, str(tmp_path)).select("page_id", "html").collect()
    assert sorted(map(tuple, found)) == [(k, f'<div class="t">{t}</div>') for k, t in ((0, "one"), (1, "other"), (4, "three"))]


class Counted(list):
    alive = most = 0

    def __init__(self, v):
        super().__init__(v)
        Counted.alive += 1
        Counted.most = max(Counted.most, Counted.alive)

    def __del__(self):
        Counted.alive -= 1


def counted(x):
    out = Counted([x])
    out.append(Counted.most)
    return out


def test_few_results_are_python_objects_at_a_time(spark):
    from weftline.functions.arrow import PIECE_ROWS, batched, streamed

    rows = spark.range(0, 8000, 1, 1).coalesce(1)
    for made in (batched(counted, "array<long>"), streamed(counted, "array<long>")):
        got = [r[0] for r in rows.select(made(F.col("id"))).collect()]
        assert [r[0] for r in got] == list(range(8000))
        assert max(r[1] for r in got) <= 2 * PIECE_ROWS


def test_equal_arguments_of_a_piece_are_worked_out_once(spark):
    from weftline.functions.arrow import batched

    rows = spark.range(0, 500, 1, 1).select((F.col("id") % 5).alias("k"))
    got = [r[0] for r in rows.select(batched(lambda k: [k], "array<long>", distinct=True)("k")).collect()]
    assert got == [[k % 5] for k in range(500)]


def test_short_rows_are_spread_by_their_size_and_several_searches_take_one_parse(spark, tmp_path, monkeypatch):
    from weftline.plans.register import spread

    path = f"{tmp_path}/t.parquet"
    spark.range(300_000).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert spread(rows, 0.05).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    asked = {"a": E.Search("x"), "b": E.Search("x", first=False), "c": E.Search("X", many=True, case_sensitive=False), "d": E.Search("^(?:x|y)$", regex=True)}
    html = F.lit("<p>x</p><p>y</p><p>x</p>")
    got = spark.range(3).select(E.searches(html, asked).alias("s"), E.find_by_text(html, "x").alias("a"), E.find_by_text(html, "x", first=False).alias("b"), E.find_all_by_text(html, "X", case_sensitive=False).alias("c"), E.find_by_regex(html, "^(?:x|y)$").alias("d")).collect()
    assert len(got) == 3 and all(r["s"][k] == r[k] for r in got for k in asked)


def test_similarity_within_a_page_is_that_of_its_fingerprints(spark):
    from weftline.kernel import similarity as K

    pages = spark.createDataFrame([(1, '<ul><li class="a">aaa</li><li class="b">aa</li></ul>'), (2, "<ul><li>x</ul>"), (3, "<p>")], "id long, html string")
    li = E.fingerprints(pages, "li", keep=["id"]).groupBy("id").agg(F.min_by("element", "pos").alias("a"), F.max_by("element", "pos").alias("b"))
    want = {r["id"]: r["s"] for r in li.select("id", relocate.similarity_score(F.col("a"), F.col("b")).alias("s")).collect()}
    assert {r["id"]: r["s"] for r in pages.select("id", relocate.similarity_within(F.col("html"), "li").alias("s")).collect()} == want | {3: None}
    for a, b in (("aab", "ab"), ("", ""), ("", "a"), (["a"], ["a"]), (["a"], ["b"]), ("ab" * 150, "ab" * 150), ("ab" * 150, "ba" * 150)):
        assert K.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
