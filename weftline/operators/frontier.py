"""The crawl frontier: request rows, what was seen, and the order in which requests go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U

REQUEST = {
    "url": "string", "method": "string", "session_id": "string", "callback": "string", "priority": "int", "dont_filter": "boolean",
    "headers": "map<string,string>", "body": "string", "json_body": "string", "meta": "map<string,string>", "retry_count": "int", "round": "int", "parent_pos": "long", "pos": "int",
}
_DEFAULTS = {"method": "GET", "session_id": "", "priority": 0, "dont_filter": False, "retry_count": 0, "round": 0, "parent_pos": 0, "pos": 0}
SCHEMA = ", ".join(f"{k} {v}" for k, v in REQUEST.items())


def requests(df: DataFrame, keep_fragment: bool = False, include_headers: bool = False, include_meta: bool = False, **columns: Column) -> DataFrame:
    """Rows of all request columns with fp: columns that df lacks get their defaults; nulls too. json_body wins over body."""
    def of(name: str) -> Column:
        c = columns.get(name, F.col(name) if name in df.columns else F.lit(None))
        c = c.cast(REQUEST[name])
        return (F.coalesce(c, F.lit(_DEFAULTS[name]).cast(REQUEST[name])) if name in _DEFAULTS else c).alias(name)

    rows = df.select(*map(of, REQUEST)).where("url is not null")
    fp = U.fingerprint(F.col("url"), F.col("method"), F.col("session_id"), F.coalesce("json_body", "body"), F.col("headers") if include_headers else None, F.col("meta") if include_meta else None, keep_fragment)
    return rows.withColumn("fp", fp)


def first_wins(rows: DataFrame) -> DataFrame:
    """One row for each fp, that which came first; rows of dont_filter all stay."""
    w = Window.partitionBy("fp", F.when(F.col("dont_filter"), F.struct("round", "parent_pos", "pos", "retry_count"))).orderBy("round", "parent_pos", "pos", "url")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1 or dont_filter").drop("__n")


#: Folders over which fingerprints and cached pages are spread, so that a small round reads few of them.
BUCKETS = 64


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def touched(rows: DataFrame, key: Column, table: DataFrame) -> DataFrame:
    """The table (partitioned by bucket) narrowed to the buckets of the rows' keys: at most BUCKETS numbers come to the driver."""
    some = [r[0] for r in rows.select(bucket(key).alias("b")).distinct().collect()]
    return table.where(F.col("bucket").isin(some)) if len(some) < BUCKETS else table


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose fp isn't in seen (fp); rows of dont_filter pass."""
    s = seen.select(F.col("fp").alias("__fp")).distinct()
    kept = rows.where("not dont_filter").join(s, F.col("fp") == F.col("__fp"), "left_anti")
    return kept.unionByName(rows.where("dont_filter"))


def newly_seen(rows: DataFrame) -> DataFrame:
    """fp of the rows that are to be remembered: those of dont_filter aren't."""
    return rows.where("not dont_filter").select("fp").distinct()


def ordered(rows: DataFrame) -> DataFrame:
    """By priority and then fp, both descending."""
    return rows.orderBy(F.desc("priority"), F.desc("fp"))


def dequeue(rows: DataFrame, n: int) -> DataFrame:
    """The next n requests: a top-k, not a sort of the whole frontier."""
    return ordered(rows).limit(n)


def without(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """What stays in the queue when the taken rows (seq) leave it."""
    return rows.join(taken.select("seq"), "seq", "left_anti")


def counted(rows: DataFrame) -> DataFrame:
    """pending, empty: the queue's length, and whether there is none."""
    return rows.agg(F.count("*").alias("pending")).withColumn("empty", F.col("pending") == 0)


def restored(seen: DataFrame, more: DataFrame) -> DataFrame:
    """The seen table (fp) with further fingerprints, each once."""
    return seen.select("fp").unionByName(more.select("fp")).distinct()


def retries(blocked: DataFrame, most: int) -> DataFrame:
    """Blocked requests that are tried again, marked so that they pass the filter."""
    return blocked.where(F.col("retry_count") < most).withColumn("retry_count", F.col("retry_count") + 1).withColumn("dont_filter", F.lit(True))
