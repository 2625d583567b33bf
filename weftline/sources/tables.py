"""Keyed tables in folders: the response cache and element snapshots.  Rows are only added; the latest of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..functions.url import cache_key, storage_key
from ..kernel.fetching import BLOCKED
from ..operators.frontier import bucket, touched

_CACHE = "url string, status int, content_type string, body string, headers map<string,string>, saved_at timestamp"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


class ResponseCache:
    """Responses by the SHA-256 of their URL; blocked ones aren't kept."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, responses: DataFrame) -> None:
        kept = responses.where(~F.col("status").isin(*BLOCKED))
        names = [c.split()[0] for c in _CACHE.split(", ")[:-1]]
        rows = kept.select(*((F.col(c) if c in responses.columns else F.lit(None).cast("map<string,string>" if c == "headers" else "string")).alias(c) for c in names), F.current_timestamp().alias("saved_at"))
        rows.withColumn("bucket", bucket(F.col("url"))).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def read(self, asked: DataFrame | None = None) -> DataFrame:
        """The latest response of each URL; asked (url): of the buckets alone in which these are."""
        rows = _read(self.spark, self.path)
        rows = rows if rows is not None else self.spark.createDataFrame([], f"{_CACHE}, bucket int")
        if asked is not None:
            rows = touched(asked, F.col("url"), rows)
        rows = rows.drop("bucket")
        w = Window.partitionBy(cache_key(F.col("url"))).orderBy(F.desc("saved_at"), F.xxhash64("body"))
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def get(self, requests: DataFrame) -> DataFrame:
        """requests with hit, and the cached response's columns."""
        kept = self.read().select(F.col("url").alias("__url"), "status", "content_type", "body", "headers")
        return requests.join(kept, requests["url"] == kept["__url"], "left").withColumn("hit", F.col("__url").isNotNull()).drop("__url")


class Snapshots:
    """Element fingerprints by (lower-case url, identifier)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, rows: DataFrame) -> None:
        """rows: url, identifier, element."""
        kept = rows.select(F.lower("url").alias("url"), storage_key(F.col("identifier")).alias("identifier_hash"), "identifier", "element", F.current_timestamp().alias("saved_at"))
        kept.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        from ..operators.extract import ELEMENT

        rows = _read(self.spark, self.path)
        if rows is None:
            rows = self.spark.createDataFrame([], f"url string, identifier_hash string, identifier string, element {ELEMENT}, saved_at timestamp")
        w = Window.partitionBy("url", "identifier_hash").orderBy(F.desc("saved_at"), F.xxhash64("element"))
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def retrieve(self, keys: DataFrame) -> DataFrame:
        """keys (url, identifier) with element, null where there is none."""
        s = self.read().select(F.col("url").alias("__url"), F.col("identifier_hash").alias("__hash"), "element")
        return keys.join(s, (F.lower(keys["url"]) == s["__url"]) & (storage_key(keys["identifier"]) == s["__hash"]), "left").drop("__url", "__hash")
