"""The corpus pipeline: documents pass a quality classifier, near-dedup, decontamination, PII surrogates and the SentencePiece codec.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents,
and works on every row that the stage before it kept.  The last stage returns
the ids of each text and the text that they decode to; the others return the
columns of documents.

Rows with a null text or doc_id pass the dedup and decontamination stages as
they are; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontam, pii, quality, sentencepiece_codec, simhash
from weftline.sources.shared import new_path, remove
from weftline.plans.ship import ship

ROOT = str(Path(__file__).resolve().parent)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model of labels.quality doesn't reject."""
    ship(spark, ROOT)
    return quality.reject(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    ship(spark, ROOT)
    return simhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no copy of a benchmark item."""
    ship(spark, ROOT)
    return decontam.remove(docs, _read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data."""
    ship(spark, ROOT)
    return pii.replace_all(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the decoded text of all documents."""
    ship(spark, ROOT)
    return sentencepiece_codec.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII surrogates", replace_personal_data),
    ("SentencePiece codec", encode_and_decode),
]

#: Models, fingerprints, alignments and permutations have no SQL; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder and read again, and the stage before is removed: what the last one reads stays with its result."""
    docs, last = _read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    return docs
