"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dups

    return near_dups(_read(spark, sf_dir, "documents"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import round_trip

    return round_trip(_read(spark, sf_dir, "documents"))


def op3_consistent_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weighted_minhash import fingerprint

    return fingerprint(_read(spark, sf_dir, "documents"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.shared import cut, new_path
    from .token_rollup import Rollup, inserts, revised

    counted = cut(inserts(_read(spark, sf_dir, "documents")))
    rollup = Rollup(spark, new_path(spark, "rollup"))
    # A first estimate of four characters a token, then the counts; another version that is taken back.
    estimate = counted.withColumn("tokens", F.floor(F.col("chars") / 4))
    rollup.apply("estimates", estimate)
    rollup.apply("counts", revised(counted, F.floor(F.col("chars") / 4), F.col("chars")))
    other = estimate.withColumn("tokenizer_version", F.lit("estimate"))
    rollup.apply("trial", other)
    rollup.apply("trial-withdrawn", other.withColumn("op", F.lit("delete")))
    for again, batch in (("estimates", estimate), ("trial-withdrawn", other.withColumn("op", F.lit("delete")))):
        rollup.apply(again, batch)  # a repeated delivery: committed already, nothing is counted twice
    rollup.compact()
    return rollup.totals()


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, train

    docs = _read(spark, sf_dir, "documents")
    return classify(docs, train(docs, _read(spark, sf_dir, "labels")))


def op6_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import reassemble, write_records

    whole = reassemble(write_records(_read(spark, sf_dir, "pages")))
    page = F.regexp_extract("record_id", r"-(\d+)>$", 1).cast("long")
    return whole.select(page.alias("page_id"), F.col("uri").alias("url"), F.col("n_segments").cast("long").alias("n_segments"), "total_length", "status", F.decode("body", "UTF-8").alias("html"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_passages

    return repeated_passages(_read(spark, sf_dir, "documents"))


def op8_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import severity, train

    docs = _read(spark, sf_dir, "documents")
    return severity(docs, train(docs, _read(spark, sf_dir, "labels")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminations

    return contaminations(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import surrogates

    return surrogates(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_sentencepiece_codec": op2_sentencepiece_codec,
    "op3_consistent_weighted_sampling": op3_consistent_weighted_sampling,
    "op4_token_rollup": op4_token_rollup,
    "op5_quality_gam": op5_quality_gam,
    "op6_warc_reassembly": op6_warc_reassembly,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity_ordinal": op8_toxicity_ordinal,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_pii_surrogates": op10_pii_surrogates,
}

ORACLE_SQL: dict[str, str] = {
    # Chunks of 4096 bytes, segments of 2048; 87 bytes of HTTP head.
    "op6_warc_reassembly": """
WITH b AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages WHERE page_id IS NOT NULL),
t AS (SELECT *, n // 4096 AS whole, n % 4096 AS rest FROM b),
l AS (SELECT *, CAST(87 + n + whole * 8 + CASE WHEN rest > 0 THEN 4 + length(printf('%x', rest)) ELSE 0 END + 5 AS BIGINT) AS total_length FROM t)
SELECT page_id, url, CAST(greatest(1, (total_length + 2047) // 2048) AS BIGINT) AS n_segments, total_length, 'ok' AS status, html FROM l
""",
    "op7_substring_dedup": """
WITH w AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, unnest(range(len(ws) - 49)) AS pos, ws FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, pos, array_to_string(ws[pos + 1 : pos + 50], ' ') AS win FROM p),
r AS (SELECT win FROM g GROUP BY win HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT DISTINCT doc_id, pos FROM g SEMI JOIN r USING (win)),
n AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + 50 AS BIGINT) AS end_word, CAST(max(pos) - min(pos) + 50 AS BIGINT) AS n_words FROM n GROUP BY doc_id, run
""",
}
