"""HTTP as a source: a data source for lists of URLs, and a function for tables of requests."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..kernel import throttle as K
from ..kernel import url as U
from ..kernel.fetching import FetchConfig, Proxies, Response, Sessions, fetch

RESPONSE = "request_url string, url string, status int, content_type string, body string, headers map<string,string>, latency_s double, error_kind string"
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.float64(), pa.string()]
_NAMES = [f.split()[0] for f in RESPONSE.split(", ")]


def _row(asked: str, r: Response) -> tuple:
    failed = r.error_kind is not None
    return (asked, r.url, None if failed else r.status, r.content_type, None if failed else r.body, list(r.headers.items()), r.latency_s, r.error_kind)


def _batch(rows: list[tuple], keyed: bool = False) -> pa.RecordBatch:
    kinds, names = (_KINDS + [pa.string(), pa.int64()], [*_NAMES, "fp", "seq"]) if keyed else (_KINDS, _NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def fetch_requests(requests: DataFrame, config: FetchConfig = FetchConfig(), sessions: dict[str, FetchConfig] | None = None, delay: float = 0.0, throttle: K.Throttle | None = None, lanes: int | None = None, batch: int = 32, per_domain: int = 1) -> DataFrame:
    """Responses of requests (url; method, session_id, headers, body, json_body, priority if there).

    json_body wins over body.  Columns fp and seq, if there, come back with each response,
    so that requests to one URL are told apart.  A domain's requests come to one task, by
    priority and then fp, both descending, one after the other: delay seconds apart, or by
    an adaptive delay that is never below it.  per_domain: without delays, tasks that may
    ask one domain at a time.  lanes: tasks that fetch at a time; by default as many as a
    shuffle has, and never less than per_domain.
    """
    known = {"url": "string", "method": "string", "session_id": "string", "headers": "map<string,string>", "body": "string", "json_body": "string", "fp": "string", "seq": "long", "priority": "int"}
    rows = requests.select(*((F.col(c) if c in requests.columns else F.lit(None)).cast(k).alias(c) for c, k in known.items()))
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotating, out = Proxies(list(config.rotating_proxies)), []
        pace = throttle or K.Throttle(0.0, delay)
        slots: dict[str, K.Slot] = {}
        named = Sessions({"default": config} | (sessions or {}))
        for b in batches:
            for url, method, session, headers, body, json_body, fp, seq, _, _ in zip(*(c.to_pylist() for c in b.columns)):
                now = time.monotonic()
                slot = slots.setdefault(U.host(url) or "", K.slot(pace, delay, now))
                time.sleep(K.reserve(pace, slot, delay, now))
                r = named.fetch(session, url, method=method or "GET", body=body, json_body=json_body, headers=dict(headers or []), proxies=rotating)
                if throttle is not None and r.error_kind is None:
                    K.record(pace, slot, r.latency_s, r.status, K.retry_after(r.headers.get("retry-after")), delay, time.monotonic())
                out.append((*_row(url, r), fp, seq))
                if len(out) == batch:
                    yield _batch(out, True)
                    out = []
        yield _batch(out, True)

    paced = throttle is not None or delay > 0
    lane = F.lit(0) if paced or per_domain <= 1 else F.pmod(F.xxhash64("url", "fp", "seq"), F.lit(per_domain))
    tasks = lanes or max(per_domain, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # By number, so that lanes of one domain never meet in a task, and requests of few bytes aren't taken together in one.
    rows = rows.withColumn("__host", F.concat_ws("|", host, lane.cast("string"))).withColumn("__task", F.pmod(F.xxhash64(host) + lane, F.lit(tasks)).cast("int"))
    spread = rows.repartitionById(tasks, F.col("__task")).drop("__task")
    got = spread.sortWithinPartitions("__host", F.desc("priority"), F.desc("fp")).mapInArrow(run, f"{RESPONSE}, fp string, seq long")
    return got.drop(*(c for c in ("fp", "seq") if c not in requests.columns))


class _Urls(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = options.get("urls", options.get("path", "")).split()
        self.config = FetchConfig(timeout=float(options.get("timeout", 30)), retries=int(options.get("retries", 3)), retry_delay=float(options.get("retry_delay", 1)), proxy=options.get("proxy"), user_agent=options.get("user_agent"), stealth=options.get("stealth", "true") == "true", follow_redirects=options.get("follow_redirects", "true") == "true", verify_ssl=options.get("verify_ssl", "true") == "true", max_body_bytes=int(options.get("max_body_bytes", 50 << 20)))

    def partitions(self) -> list[InputPartition]:
        """One for each domain, so that a site sees one client at a time."""
        by: dict[str, list[str]] = {}
        for u in self.urls:
            by.setdefault(U.host(u) or "", []).append(u)
        return [_Urls(v) for v in by.values()] or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[pa.RecordBatch]:
        for u in partition.urls:
            yield _batch([_row(u, fetch(self.config, u))])


class FetchSource(DataSource):
    """spark.read.format("weftline_fetch").option("urls", "...").load(), after spark.dataSource.register(FetchSource)."""

    @classmethod
    def name(cls) -> str:
        return "weftline_fetch"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def robots_documents(urls: DataFrame, config: FetchConfig = FetchConfig(timeout=10.0)) -> DataFrame:
    """origin, body of the robots.txt of each origin of urls (url); the body is null where it can't be had."""
    from ..functions.url import origin

    origins = urls.select(origin(F.col("url")).alias("origin")).where("origin is not null").distinct()
    got = fetch_requests(origins.select(F.concat("origin", F.lit("/robots.txt")).alias("url")), config)
    return got.select(F.regexp_replace("request_url", "/robots\\.txt$", "").alias("origin"), F.when(F.col("status").between(200, 299), F.col("body")).alias("body"))
