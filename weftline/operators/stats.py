"""Crawl statistics as aggregates over the event log (outcome, status, bytes, domain, session_id, items, dropped, cached, at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes of a request, in the order in which they are decided.
OUTCOMES = ["robots", "offsite", "failed", "blocked", "parsed"]


def session_name(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("default"))


def live() -> Column:
    """Whether a response came over the network: replays from the cache count neither requests nor bytes."""
    return F.col("outcome").isin("blocked", "parsed") & ~F.coalesce(F.col("cached"), F.lit(False))


def counters(events: DataFrame) -> DataFrame:
    """One row of all counters, in one pass."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    seconds = F.coalesce(F.max("at") - F.min("at"), F.lit(0.0))
    requests = F.count_if(live())
    return events.agg(
        requests.alias("requests_count"),
        is_("failed").alias("failed_requests_count"),
        is_("offsite").alias("offsite_requests_count"),
        is_("robots").alias("robots_disallowed_count"),
        is_("blocked").alias("blocked_requests_count"),
        F.count_if(F.col("cached")).alias("cache_hits"),
        F.count_if(~F.col("cached") & ~F.col("outcome").isin("robots", "offsite")).alias("cache_misses"),
        F.coalesce(F.sum(F.when(live(), F.col("bytes"))), F.lit(0)).cast("long").alias("response_bytes"),
        F.coalesce(F.sum("items"), F.lit(0)).cast("long").alias("items_scraped"),
        F.coalesce(F.sum("dropped"), F.lit(0)).cast("long").alias("items_dropped"),
        seconds.alias("elapsed_seconds"),
        F.coalesce(F.try_divide(requests, seconds), F.lit(0.0)).alias("requests_per_second"),
    )


def by_status(events: DataFrame) -> DataFrame:
    return events.where(live()).groupBy("status").agg(F.count("*").alias("n"))


def bytes_by_domain(events: DataFrame) -> DataFrame:
    return events.where(live() & (F.col("domain") != "")).groupBy("domain").agg(F.sum("bytes").alias("bytes"))


def by_session(events: DataFrame) -> DataFrame:
    return events.where(live()).groupBy(session_name(F.col("session_id")).alias("session_id")).agg(F.count("*").alias("n"))


def union_of_keys(items: DataFrame, item: str = "item", seq: str = "seq") -> DataFrame:
    """key, place (from 0): all keys of JSON objects, in the order in which they are first seen."""
    from pyspark.sql import Window

    keys = items.select(F.col(seq).alias("__seq"), F.posexplode(F.json_object_keys(item)).alias("__pos", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("__seq", "__pos")).alias("first"))
    # The distinct keys are few: one task may number them.
    return first.select("key", (F.row_number().over(Window.orderBy("first")) - 1).alias("place"))
