"""A registry of queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(q: Query) -> Query:
            self.queries[q.__name__] = q
            if sql is not None:
                self.sql[q.__name__] = sql
            return q

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, mb: float | None = None) -> DataFrame:
    """A table of fewer row groups than half the cores in as many partitions as there are cores; a larger one as it is, without a shuffle.

    mb: for short rows that take long, tasks of about so many MB each, as Spark estimates
    the table, and no fewer than there are cores. Splits of a file tell nothing of its
    rows, as those of a row group come to one of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if mb is not None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.repartition(max(cores, math.ceil(size / (mb * 1e6))))
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
