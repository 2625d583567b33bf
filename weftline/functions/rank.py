"""Global row numbers without bringing a table to one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..sources.shared import cut


def row_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's number from 0 in this order: a range-partitioned sort, kept in a checkpoint, whose partition sizes are counted first.

    The checkpoint holds the partitions in place: a sort that is run twice may put its bounds elsewhere.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    before, total = {}, 0
    for r in sorted(counts):
        before[r["p"]], total = total, total + r["count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = before.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, name])
            at += b.num_rows

    return rows.mapInArrow(run, StructType([*df.schema.fields]).add(name, LongType()))
