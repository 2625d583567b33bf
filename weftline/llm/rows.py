"""Documents as the operators read them: a doc_id of its own type, and a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_type(docs: DataFrame) -> str:
    """The type of doc_id, as results carry it: numbers, strings or any other that can be compared."""
    return docs.schema["doc_id"].dataType.simpleString()


def rows(docs: DataFrame) -> DataFrame:
    """doc_id, text."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))
