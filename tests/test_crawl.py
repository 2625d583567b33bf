"""The crawl loop over a local server: one response a request, robots, cache, priority, pacing, hooks and pauses."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from weftline.kernel.fetching import FetchConfig
from weftline.operators import crawl as C
from weftline.operators import frontier, spiders
from weftline.sources import fetch
from weftline.sources.tables import ResponseCache

QUICK = FetchConfig(retries=0)


class _Site(http.server.BaseHTTPRequestHandler):
    log, busy, most, lock = [], 0, 0, threading.Lock()

    def _answer(self, body, status=200):
        cls = type(self)
        with cls.lock:
            cls.log.append((self.command, self.path))
            cls.busy += 1
            cls.most = max(cls.most, cls.busy)
        if self.path.startswith("/slow"):
            time.sleep(0.3)
        with cls.lock:
            cls.busy -= 1
        data = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", "text/html")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        if self.path == "/robots.txt":
            self._answer("User-agent: *\nDisallow: /private\n")
        elif self.path == "/blocked":
            self._answer("no", 403)
        else:
            self._answer(f"<title>get {self.path}</title><a href='/private/x'>p</a><a href='/open'>o</a>")

    def do_POST(self):
        data = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        self._answer(f"<title>echo {self.headers.get('Content-Type', '').split(';')[0]} {data}</title>")

    do_PUT = do_POST

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    handler = type("Site", (_Site,), {"log": [], "busy": 0, "most": 0})
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", handler
    s.shutdown()


def title(page, row):
    return [{"t": page.value("title::text")}], []


def test_each_request_of_one_url_has_its_own_response(spark, site, tmp_path):
    base, _ = site
    seeds = spark.createDataFrame(
        [(f"{base}/f", "POST", "one", None), (f"{base}/f", "POST", "two", None), (f"{base}/f", "GET", None, None), (f"{base}/f", "PUT", "lost", '{"a": 1}'), (f"{base}/f", "POST", "one", None)],
        "url string, method string, body string, json_body string",
    )
    done = C.crawl(spark, seeds, title, f"file://{tmp_path}/c", fetch=C.http(C.CrawlConfig(), QUICK))
    assert sorted(json.loads(r["item"])["t"] for r in done.items.collect()) == ["echo application/json {\"a\": 1}", "echo application/x-www-form-urlencoded one", "echo application/x-www-form-urlencoded two", "get /f"]
    assert done.events.select("fp").distinct().count() == 4 and done.events.count() == 4


def test_robots_are_fetched_once_an_origin(spark, site, tmp_path):
    base, handler = site
    config = C.CrawlConfig(robots_txt_obey=True)
    seeds = spark.createDataFrame([(f"{base}/a",), (f"{base}/private/0",)], "url string")
    done = C.crawl(spark, seeds, spiders.crawl_spider([spiders.CrawlRule()]), f"file://{tmp_path}/c", config, fetch=C.http(config, QUICK))
    got = {r["url"].removeprefix(base): r["outcome"] for r in done.events.collect()}
    assert got == {"/a": "parsed", "/private/0": "robots", "/private/x": "robots", "/open": "parsed"}
    assert handler.log.count(("GET", "/robots.txt")) == 1 and not [p for _, p in handler.log if p.startswith("/private")]
    with pytest.raises(ValueError):
        C.crawl(spark, seeds, title, f"file://{tmp_path}/d", config)
    # A cache may hold them; an origin whose document can't be had allows everything.
    cache = spark.createDataFrame([("http://a.test/robots.txt", 200, "User-agent: *\nDisallow: /"), ("http://a.test/x", 200, ""), ("http://b.test/x", 200, "")], "url string, status int, body string")
    done = C.crawl(spark, cache.where("url like '%/x'").select("url"), title, f"file://{tmp_path}/e", config, cache=cache)
    assert {(r["url"], r["outcome"]) for r in done.events.collect()} == {("http://a.test/x", "robots"), ("http://b.test/x", "parsed")}


def test_development_mode_writes_the_cache(spark, site, tmp_path):
    base, handler = site
    config, cache = C.CrawlConfig(development_mode=True, max_blocked_retries=0), ResponseCache(spark, f"file://{tmp_path}/cache")
    seeds = spark.createDataFrame([(f"{base}/a", "GET", None), (f"{base}/blocked", "GET", None), (f"{base}/p", "POST", "x")], "url string, method string, body string")
    run = lambda name: C.crawl(spark, seeds, title, f"file://{tmp_path}/{name}", config, cache=cache, fetch=C.http(config, QUICK))
    first = {r["url"].removeprefix(base): (r["cached"], r["outcome"]) for r in run("one").events.collect()}
    asked = len(handler.log)
    again = {r["url"].removeprefix(base): (r["cached"], r["outcome"]) for r in run("two").events.collect()}
    assert first == {"/a": (False, "parsed"), "/blocked": (False, "blocked"), "/p": (False, "parsed")}
    assert again == first | {"/a": (True, "parsed")} and len(handler.log) == asked + 2 == 5
    assert [r["url"] for r in cache.read().collect()] == [f"{base}/a"]
    with pytest.raises(ValueError):
        C.crawl(spark, seeds, title, f"file://{tmp_path}/x", config)


def test_priority_decides_what_a_round_takes(spark, tmp_path):
    cache = spark.createDataFrame([(f"http://s.test/{k}", 200, f"<title>{k}</title>") for k in range(6)], "url string, status int, body string")
    seeds = spark.createDataFrame([(f"http://s.test/{k}", (k * 2) % 6) for k in range(6)] + [("http://s.test/0", 9)], "url string, priority int")
    config = C.CrawlConfig(round_requests=2)
    done = C.crawl(spark, seeds, title, f"file://{tmp_path}/c", config, cache=cache)
    rows = sorted((r["round"], -r["priority"], r["fp"]) for r in done.events.collect())
    want = frontier.ordered(frontier.first_wins(frontier.requests(seeds))).collect()
    assert [r[0] for r in rows] == [0, 0, 1, 1, 2, 2] and [-r[1] for r in rows] == [r["priority"] for r in want]
    assert {(k // 2, r["fp"]) for k, r in enumerate(want)} == {(r[0], r[2]) for r in rows} and done.completed


def test_requests_of_a_domain_at_a_time(spark, site):
    base, handler = site
    asked = frontier.requests(spark.createDataFrame([(f"{base}/slow{k}", k) for k in range(6)], "url string, priority int")).withColumn("seq", F.xxhash64("fp"))
    got = C.http(C.CrawlConfig(concurrent_requests=8, concurrent_requests_per_domain=1), QUICK)(asked)
    assert got.count() == 6 and handler.most == 1
    # One at a time they go by priority.
    assert [p for _, p in handler.log] == [f"/slow{k}" for k in range(5, -1, -1)]
    assert C.http(C.CrawlConfig(concurrent_requests=8, concurrent_requests_per_domain=3), QUICK)(asked).count() == 6
    assert 1 < handler.most <= 3


def test_hooks_and_pause(spark, site, tmp_path):
    base, _ = site
    calls, path, errors = [], f"file://{tmp_path}/c", tmp_path / "errors"
    errors.mkdir()

    def on_error(row, error, folder=str(errors)):
        import hashlib

        with open(f"{folder}/{hashlib.sha256(row['request_url'].encode()).hexdigest()}", "w") as f:
            f.write(error)

    def parser(page, row):
        if page.url.endswith("/bad"):
            raise ValueError("bad")
        return [], [f"{base}/n{page.url.count('n') + 1}"] if "/n" not in page.url else [f"{page.url}n"]

    config = C.CrawlConfig(name="hooks", max_rounds=3, on_start=lambda c: (calls.append(c.name), C.request_pause(spark, path)), on_close=lambda r: calls.append(r.paused), on_error=on_error)
    seeds = spark.createDataFrame([(f"{base}/a",), (f"{base}/bad",), ("http://127.0.0.1:9/",)], "url string")
    done = C.crawl(spark, seeds, parser, path, config, fetch=C.http(config, QUICK))
    # A pause asked for before the first round is forgotten; max_rounds ends the run.
    assert calls == ["hooks", True] and done.paused and done.events.select("round").distinct().count() == 3
    assert sorted(p.read_text() for p in errors.iterdir()) == ["ValueError: bad", "connect"]

    def pausing(page, row):
        C_path = path.removeprefix("file://")
        open(f"{C_path}/pause", "w").close()
        return parser(page, row)

    again = C.crawl(spark, seeds, pausing, path, C.CrawlConfig(), fetch=C.http(config, QUICK))
    assert again.paused and again.events.select("round").distinct().count() == 4


def test_a_small_round_reads_few_buckets(spark, tmp_path):
    fps = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("fp"))
    fps.withColumn("bucket", frontier.bucket(F.col("fp"))).write.partitionBy("bucket").parquet(f"file://{tmp_path}/seen")
    seen = spark.read.parquet(f"file://{tmp_path}/seen")
    rows = frontier.requests(spark.createDataFrame([("http://a.test/1",), ("http://a.test/2",)], "url string"))
    some = frontier.touched(rows, F.col("fp"), seen)
    scan = [p for p in some._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in p]
    assert "bucket" in scan[0].split("PartitionFilters: [")[1].split("]")[0] and len(some.inputFiles()) <= len(seen.inputFiles())
    assert some.select("bucket").distinct().count() <= 2 and frontier.unseen(rows, some).count() == 2
    cache = ResponseCache(spark, f"file://{tmp_path}/cache")
    cache.put(spark.createDataFrame([("http://a.test/1", 200, "t", "x"), ("http://a.test/3", 200, "t", "y"), ("http://a.test/4", 429, "t", "z")], "url string, status int, content_type string, body string"))
    assert {r["url"]: r["hit"] for r in cache.get(rows.select("url")).collect()} == {"http://a.test/1": True, "http://a.test/2": False}
    assert cache.read(rows).count() >= 1 and cache.read().count() == 2


def test_queue_surface(spark):
    rows = frontier.requests(spark.createDataFrame([("http://a/", 1), ("http://b/", 2)], "url string, priority int")).withColumn("seq", F.xxhash64("fp"))
    top = frontier.dequeue(rows, 1)
    assert [r["url"] for r in frontier.without(rows, top).collect()] == ["http://a/"]
    assert tuple(frontier.counted(rows).first()) == (2, False) and tuple(frontier.counted(rows.where("false")).first()) == (0, True)
    assert frontier.restored(rows, rows).count() == 2


def test_retries_of_json_requests_keep_their_body(spark, site):
    base, _ = site
    asked = spark.createDataFrame([(f"{base}/j", "POST", '{"k": [1]}')], "url string, method string, json_body string")
    assert fetch.fetch_requests(asked, QUICK).first()["body"] == '<title>echo application/json {"k": [1]}</title>'
