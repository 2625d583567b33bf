"""Structured Streaming: requests seen once, adaptive delays by domain, and statistics of fetch events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.url import fingerprint
from ..kernel import throttle as K
from ..operators import throttle as fold


def unseen(requests: DataFrame, within: str | None = None, at: str = "at") -> DataFrame:
    """Requests with fp, each fp once.  Without within the state holds every fp for good; with it, those of that event time."""
    rows = requests.withColumn("fp", fingerprint(F.col("url")))
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(["fp"]) if within else rows.dropDuplicates(["fp"])


def domain_stats(events: DataFrame) -> DataFrame:
    """domain, n, bytes: running totals (output mode complete or update)."""
    return events.groupBy("domain").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


class Throttler(StatefulProcessor):
    """The slot of each domain, kept in the state store; a batch's events of a domain are folded in order of seq."""

    def __init__(self, t: K.Throttle = K.Throttle()) -> None:
        self.t = t

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("slot", "delay double, next_allowed double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        held = self.slot.get()
        slot = K.Slot(*held) if held is not None else None
        out = []
        for e in events.itertuples():
            after = e.retry_after if isinstance(e.retry_after, str) else None
            slot, wait = fold.step(self.t, slot, e.now_s, e.latency_s, int(e.status), after, e.floor_s)
            out.append((key[0], int(e.seq), wait, slot.delay, slot.next_allowed))
        self.slot.update((slot.delay, slot.next_allowed))
        yield pd.DataFrame(out, columns=["domain", "seq", "wait_s", "delay_s", "next_allowed_s"])

    def close(self) -> None:
        pass


def throttled(events: DataFrame, t: K.Throttle = K.Throttle()) -> DataFrame:
    """The stream of operators.throttle.fold; needs the RocksDB state store."""
    return events.groupBy("domain").transformWithStateInPandas(statefulProcessor=Throttler(t), outputStructType=fold.SCHEMA, outputMode="Append", timeMode="None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table in path; a later call with the same checkpoint goes on from it."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        # A mode that isn't append writes each batch's table whole.
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
