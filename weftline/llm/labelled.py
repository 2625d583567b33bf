"""Bounded samples of labelled rows for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import id_type, rows as texts_of


def sample(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(label_id, y): at most rows labelled ids, the same for the same table: those whose hash is below a threshold.

    Of more ids than rows as many fewer are aimed at as six times the deviation of their
    number (half of rows at most), so that no sort or limit is needed.  Rows with a null id or label are left
    out; of repeated ids the largest label counts.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(column).cast("int").alias("y")).where("label_id is not null and y is not null").groupBy("label_id").agg(F.max("y").alias("y"))
    total = known.count()
    if total <= rows:
        return known
    return known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 40)) < F.lit(int(max(rows / 2, rows - 6 * rows**0.5) / total * (1 << 40))))


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of the sample's documents; the sample is broadcast, as rows bounds it. Label ids that can't be of the documents' type match none."""
    kind = id_type(docs)
    some = sample(labels, column, rows).select(F.col("label_id").try_cast(kind).alias("label_id"), "y").where("label_id is not null")
    return texts_of(docs).join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")
