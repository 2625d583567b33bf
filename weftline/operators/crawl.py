"""The crawl loop: rounds of frontier, filters, fetch or replay, parse, and new requests.

A round is one query, written to the crawl's folder before the next begins: the
tables there (seen, frontier, events, items) are at once the result, the
checkpoint, and what a later run goes on from.  Nothing is collected but whether
a round brought requests, and which buckets of the seen table and of the cache it
touches.  Stages run in this order, and a row's outcome is the first that applies:
robots, offsite, replay from the cache, fetch (failed), blocked, parsed; in
development mode what was fetched and isn't blocked is then written to the cache.
A response that isn't blocked is parsed whatever its status.  Each request has the
response to itself, also where several go to one URL.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import batched
from ..functions.url import url_parts
from ..kernel.dom import Page
from ..kernel.export import compact
from ..kernel.fetching import BLOCKED
from ..sources.tables import ResponseCache
from . import frontier, robots, stats

LOG = logging.getLogger("weftline.crawl")
_ASK = "struct<url: string, method: string, session_id: string, callback: string, priority: int, dont_filter: boolean, headers: map<string,string>, body: string, json_body: string, meta: map<string,string>>"
_PARSED = f"struct<items: array<string>, dropped: int, requests: array<{_ASK}>, error: string>"

#: A parser takes a page and its row (url, status, body, meta as a dict, ...) and returns items and requests (URLs or dicts).
Parser = Callable[[Page, dict], tuple[list[object], list[object]]]


@dataclass(frozen=True)
class CrawlConfig:
    """Settings of a crawl. Pacing (delays, concurrency) is for the fetch source; replays aren't paced.

    name: of the crawl's jobs and log lines.  concurrent_requests_per_domain: 0 is as many as
    concurrent_requests; with delays a domain is asked once at a time.  round_requests: how
    many requests a round takes, those of the highest priority first (ties: by fp,
    descending); by default all.  on_start gets the configuration and on_close the result, on
    the driver; on_error gets the row and the error of each request that failed or whose
    parser did, where the row is.
    """

    name: str = "crawl"
    allowed_domains: tuple[str, ...] = ()
    robots_txt_obey: bool = False
    user_agent: str = "*"
    concurrent_requests: int = 4
    concurrent_requests_per_domain: int = 0
    download_delay: float = 0.0
    autothrottle_enabled: bool = False
    autothrottle_start_delay: float = 5.0
    autothrottle_max_delay: float = 60.0
    autothrottle_target_concurrency: float = 1.0
    max_blocked_retries: int = 3
    fp_include_kwargs: bool = False
    fp_keep_fragments: bool = False
    fp_include_headers: bool = False
    development_mode: bool = False
    max_rounds: int | None = None
    round_requests: int | None = None
    on_start: Callable[[CrawlConfig], None] | None = field(default=None, compare=False)
    on_close: Callable[[CrawlResult], None] | None = field(default=None, compare=False)
    on_error: Callable[[dict, str], None] | None = field(default=None, compare=False)
    on_item: Callable[[object], object | None] | None = field(default=None, compare=False)
    is_blocked: Callable[[int], bool] | None = field(default=None, compare=False)


def http(config: CrawlConfig, settings: object = None, sessions: dict[str, object] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A fetch function for crawl() with the configuration's delays; at most so many domains at a time as it allows requests."""
    from ..kernel.fetching import FetchConfig
    from ..kernel.throttle import Throttle
    from ..sources.fetch import fetch_requests

    pace = Throttle(config.autothrottle_start_delay, config.autothrottle_max_delay, config.autothrottle_target_concurrency) if config.autothrottle_enabled else None

    def run(requests: DataFrame) -> DataFrame:
        return fetch_requests(requests, settings or FetchConfig(), sessions, config.download_delay, pace, lanes=max(1, config.concurrent_requests), per_domain=config.concurrent_requests_per_domain or max(1, config.concurrent_requests))

    return run


@dataclass
class CrawlResult:
    """Tables of a crawl; paused: requests are left."""

    spark: SparkSession
    path: str
    paused: bool

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def items(self) -> DataFrame:
        """round, parent_pos, pos, url, item (compact JSON)."""
        return self.table("items")

    @property
    def completed(self) -> bool:
        return not self.paused

    def counters(self) -> DataFrame:
        return stats.counters(self.events)


def _parse(parser: Parser, config: CrawlConfig):
    on_item, on_error = config.on_item, config.on_error

    def failed(row: dict, error: str, found: dict) -> dict:
        if on_error is not None:
            on_error(row, error)
        return found

    def run(body: str | None, url: str | None, info: str | None) -> dict:
        row = json.loads(info or "{}") | {"url": url, "body": body}
        none = {"items": [], "dropped": 0, "requests": [], "error": None}
        if body is None:
            return failed(row, row["error_kind"], none) if row.get("error_kind") else none
        try:
            items, asked = parser(Page(body, url or ""), row)
        except Exception as e:  # a parser's error is that row's outcome and not the crawl's end
            error = f"{type(e).__name__}: {e}"
            return failed(row, error, none | {"error": error})
        kept = [i if on_item is None else on_item(i) for i in items]
        dropped = sum(i is None for i in kept)
        return {"items": [compact(i) for i in kept if i is not None], "dropped": dropped, "requests": [{"url": a} if isinstance(a, str) else a for a in asked], "error": None}

    return batched(run, _PARSED)


def request_pause(spark: SparkSession, path: str) -> None:
    """Has a crawl stop after the round that it is in; what is left waits for the next call of crawl()."""
    _State(spark, path).touch("pause")


def crawl(spark: SparkSession, seeds: DataFrame, parser: Parser, path: str, config: CrawlConfig = CrawlConfig(), cache: DataFrame | ResponseCache | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None, robots_docs: DataFrame | None = None) -> CrawlResult:
    """Crawls from seeds (url and any request columns) into the folder path; if that holds a crawl, goes on with it and ignores the seeds.

    cache: (url, status, content_type, body), replayed for URLs that it has (requests of GET
    without a body), or a ResponseCache, to which development_mode also writes.  fetch:
    requests to the same columns, with request_url and error_kind, and with the fp and seq of
    each request (else requests are told apart by their URL alone); without it a URL that
    isn't in the cache has failed.  robots_docs: (origin, body); where the configuration obeys
    robots.txt and they aren't given, each new origin's is taken from the cache or fetched,
    and it is an error if there is neither.
    """
    if config.robots_txt_obey and robots_docs is None and fetch is None and cache is None:
        raise ValueError("robots.txt can't be obeyed without its documents, a cache or a fetch function")
    if config.development_mode and cache is None:
        raise ValueError("development mode needs a cache")
    flags = {"keep_fragment": config.fp_keep_fragments, "include_headers": config.fp_include_headers, "include_meta": config.fp_include_kwargs}
    state = _State(spark, path)
    if config.on_start is not None:
        config.on_start(config)
    at = state.last_round()
    state.forget("pause")
    if at < 0:
        state.write("frontier", 0, frontier.first_wins(frontier.requests(seeds, **flags)))
        state.commit(0)
        at = 0
    first, done = at, False
    while not done and (config.max_rounds is None or at - first < config.max_rounds) and not (at > first and state.there("pause")):
        queue = state.read("frontier", at)
        if queue.isEmpty():
            done = True
            break
        spark.sparkContext.setJobDescription(f"{config.name}: round {at}")
        LOG.info("%s: round %d begins", config.name, at)
        # A stable number for each request of the queue, by the order in which they came.
        queue = queue.withColumn("seq", F.xxhash64("fp", "retry_count", "round", "parent_pos", "pos"))
        waiting, later = queue, None
        if config.round_requests is not None:
            state.write("taken", at, frontier.dequeue(queue, max(1, config.round_requests)))
            waiting = state.read("taken", at)
            later = frontier.without(queue, waiting).drop("seq")
        rules = _rules(state, at, waiting, config, cache, fetch, robots_docs, flags) if config.robots_txt_obey else None
        state.write("events_raw", at, _round(waiting.withColumn("round", F.lit(at)), config, cache, fetch, rules, parser))
        events = state.read("events_raw", at)
        if config.development_mode and isinstance(cache, ResponseCache):
            fetched = events.where("outcome = 'parsed' and not cached and method = 'GET' and body is null and json_body is null")
            cache.put(fetched.select("url", "status", "content_type", F.col("r_body").alias("body")))
        state.write("items", at, events.select("round", F.col("seq").alias("parent_pos"), "url", F.posexplode("parsed.items").alias("pos", "item")))
        state.write("events", at, events.select("round", "seq", "fp", "url", "method", "domain", "session_id", "callback", "priority", "retry_count", "outcome", "status", "bytes", "cached", F.size("parsed.items").cast("long").alias("items"), F.col("parsed.dropped").cast("long").alias("dropped"), F.coalesce("error_kind", "parsed.error").alias("error"), F.col("latency_s"), F.unix_timestamp().cast("double").alias("at")))
        # What waits in the queue is seen as well: a second request for it doesn't come in.
        state.write("seen", at, frontier.newly_seen(queue if at == 0 else queue.where(F.col("round") == at)), buckets=True)
        asked = events.select("round", "seq", F.posexplode("parsed.requests").alias("pos", "r"))
        asked = frontier.requests(asked.select("r.*", (F.col("round") + 1).alias("round"), F.col("seq").alias("parent_pos"), "pos"), **flags)
        again = frontier.requests(frontier.retries(events.where("outcome = 'blocked'"), config.max_blocked_retries).withColumn("round", F.col("round") + 1).withColumn("parent_pos", F.col("seq")).withColumn("pos", F.lit(-1)), **flags)
        new = asked.unionByName(again)
        new = frontier.first_wins(frontier.unseen(new, frontier.touched(new, F.col("fp"), state.seen())))
        state.write("frontier", at + 1, new if later is None else new.unionByName(later))
        at += 1
        state.commit(at)
    paused = not done and not state.read("frontier", at).isEmpty()
    LOG.info("%s: %s after round %d", config.name, "paused" if paused else "completed", at)
    result = CrawlResult(spark, path, paused)
    if config.on_close is not None:
        config.on_close(result)
    return result


_REPLY = {"r_url": "string", "status": "int", "content_type": "string", "r_body": "string", "error_kind": "string", "latency_s": "double"}


def _replies(df: DataFrame, *keys: str) -> DataFrame:
    """Responses under the loop's names, with __url and the request's keys."""
    named = {c: c.removeprefix("r_") for c in _REPLY}
    return df.select(F.col("request_url").alias("__url"), *(F.col(k).alias(f"__{k}") for k in keys), *((F.col(n) if n in df.columns else F.lit(None)).cast(_REPLY[c]).alias(c) for c, n in named.items()))


def _cached(cache: DataFrame | ResponseCache, asked: DataFrame) -> DataFrame:
    """The cache's rows of the asked URLs: a small frontier is broadcast to the cache's scan, and of a ResponseCache only its buckets are read."""
    rows = cache.read(asked) if isinstance(cache, ResponseCache) else cache
    return rows.join(asked.select(F.col("url").alias("__asked")).distinct(), rows["url"] == F.col("__asked"), "left_semi")


def _rules(state: _State, at: int, waiting: DataFrame, config: CrawlConfig, cache: DataFrame | ResponseCache | None, fetch: Callable[[DataFrame], DataFrame] | None, docs: DataFrame | None, flags: dict[str, bool]) -> DataFrame:
    """The rules of robots.txt; documents that aren't given are had once for each origin, and kept: one that can't be had allows everything."""
    if docs is None:
        origins = waiting.select(url_parts(F.col("url"))["origin"].alias("origin")).where("origin is not null").distinct()
        if (known := state.all("robots")) is not None:
            origins = origins.join(known.select("origin"), "origin", "left_anti")
        asked = frontier.requests(origins.select("origin", F.concat("origin", F.lit("/robots.txt")).alias("url")).select("url"), **flags).withColumn("seq", F.xxhash64("fp"))
        good = lambda df: df.where("status between 200 and 299")
        found = good(_cached(cache, asked)).select("url", "body") if cache is not None else None
        if fetch is not None:
            missed = asked if found is None else asked.join(found.select("url").distinct(), "url", "left_anti")
            live = good(fetch(missed)).select(F.col("request_url").alias("url"), "body")
            found = live if found is None else found.unionByName(live)
        body = origins.join(found.groupBy(F.regexp_replace("url", r"/robots\.txt$", "").alias("origin")).agg(F.min("body").alias("body")), "origin", "left")
        state.write("robots", at, body)
        docs = state.all("robots")
    return robots.rules(docs.select("origin", "body"), config.user_agent)


def _round(waiting: DataFrame, config: CrawlConfig, cache: DataFrame | ResponseCache | None, fetch: Callable[[DataFrame], DataFrame] | None, rules: DataFrame | None, parser: Parser) -> DataFrame:
    rows = waiting.withColumn("__p", url_parts(F.col("url"))).withColumn("domain", F.coalesce("__p.host", F.lit(""))).drop("__p")
    rows = robots.allowed(rows, rules, name="__allowed") if rules is not None else rows.withColumn("__allowed", F.lit(True))
    inside = F.col("domain").isin(*config.allowed_domains) if config.allowed_domains else F.lit(True)
    rows = rows.withColumn("__wanted", F.when(~F.col("__allowed"), "robots").when(~inside, "offsite"))
    go = rows.where("__wanted is null")
    none = {c: F.lit(None).cast(k) for c, k in _REPLY.items()}
    parts, missed = [rows.where("__wanted is not null").withColumns(none).withColumn("cached", F.lit(False))], go
    if cache is not None:
        plain = (F.col("method") == "GET") & F.col("body").isNull() & F.col("json_body").isNull()
        hits = _cached(cache, go.where(plain))
        kept = _replies(hits.withColumn("request_url", F.col("url")).dropDuplicates(["request_url"]))
        if fetch is None:
            hit = go.withColumn("__ask", F.when(plain, F.col("url"))).join(kept, F.col("__ask") == F.col("__url"), "left").withColumn("cached", F.col("__url").isNotNull())
            parts.append(hit.withColumn("error_kind", F.when(F.col("cached"), F.col("error_kind")).otherwise("not_cached")).drop("__url", "__ask"))
            missed = None
        else:
            # Which requests have to be fetched takes the cache's URLs alone; bodies are read once.
            names = hits.select(F.col("url").alias("__hit")).distinct()
            missed = go.where(~plain).unionByName(go.where(plain).join(names, go["url"] == names["__hit"], "left_anti"))
            parts.append(go.where(plain).join(kept, go["url"] == kept["__url"]).withColumn("cached", F.lit(True)).drop("__url"))
    if missed is not None and fetch is not None:
        got = fetch(missed)
        if {"fp", "seq"} <= set(got.columns):
            got = _replies(got, "fp", "seq").dropDuplicates(["__fp", "__seq"])
            live = missed.join(got, (missed["fp"] == got["__fp"]) & (missed["seq"] == got["__seq"]), "left").drop("__url", "__fp", "__seq")
        else:
            got = _replies(got).dropDuplicates(["__url"])
            live = missed.join(got, missed["url"] == got["__url"], "left").drop("__url")
        parts.append(live.withColumn("error_kind", F.when(F.col("r_body").isNull(), F.coalesce("error_kind", F.lit("transport")))).withColumn("cached", F.lit(False)))
    elif missed is not None:
        parts.append(missed.withColumns(none | {"error_kind": F.lit("not_cached")}).withColumn("cached", F.lit(False)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    blocked = batched(lambda s: s is not None and config.is_blocked(s), "boolean")(F.col("status")) if config.is_blocked else F.col("status").isin(*BLOCKED)
    outcome = F.coalesce(F.col("__wanted"), F.when(F.col("error_kind").isNotNull(), "failed"), F.when(~F.col("cached") & F.coalesce(blocked, F.lit(False)), "blocked"), F.lit("parsed"))
    info = F.to_json(F.struct("status", "content_type", "callback", "method", "meta", "error_kind", F.col("url").alias("request_url")))
    every = every.withColumn("outcome", outcome)
    # Rows that aren't to be parsed have a null body, which the parser passes over.
    body = F.when(F.col("outcome") == "parsed", F.col("r_body"))
    keep = ["content_type", "r_body"] if config.development_mode and isinstance(cache, ResponseCache) else []
    return every.select(*frontier.REQUEST, "fp", "seq", "domain", "outcome", "status", F.octet_length("r_body").cast("long").alias("bytes"), "cached", "error_kind", "latency_s", *keep, _parse(parser, config)(body, F.coalesce("r_url", "url"), info).alias("parsed"))


class _State:
    """The tables of a crawl, a folder a round; a round counts once its marker is written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def last_round(self) -> int:
        fs, p = self._fs(f"{self.path}/rounds")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=-1) if fs.exists(p) else -1

    def commit(self, n: int) -> None:
        self.touch(f"rounds/{n}")

    def touch(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.create(p, True).close()

    def there(self, name: str) -> bool:
        fs, p = self._fs(f"{self.path}/{name}")
        return fs.exists(p)

    def forget(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def write(self, table: str, n: int, df: DataFrame, buckets: bool = False) -> None:
        path = f"{self.path}/{table}/n={n}"
        if buckets:
            df.withColumn("bucket", frontier.bucket(F.col("fp"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)

    def all(self, table: str) -> DataFrame | None:
        """The rounds' tables together; None if there is none."""
        return self.spark.read.parquet(f"{self.path}/{table}") if self.there(table) else None

    def read(self, table: str, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/n={n}")

    def seen(self) -> DataFrame:
        return self.spark.read.schema("fp string, bucket int, n int").parquet(f"{self.path}/seen")


def cleanup(spark: SparkSession, path: str) -> None:
    """Removes a completed crawl's folder."""
    fs, p = _State(spark, path)._fs(path)
    fs.delete(p, True)


def bfs(edges: DataFrame, start: DataFrame, depth: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, hops: what is reached from start (node) in at most depth steps over edges (src, dst), by the fewest.

    cut takes a table off its lineage, a checkpoint for one.
    """
    reached = cut(start.select("node").distinct().withColumn("hops", F.lit(0)))
    front = reached
    for k in range(1, depth + 1):
        new = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(new.join(reached, "node", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        reached = cut(reached.unionByName(front))
    return reached
