"""Adaptive delays over a table of request events: an ordered fold for each domain."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernel import throttle as K

SCHEMA = "domain string, seq long, wait_s double, delay_s double, next_allowed_s double"
COLUMNS = ["domain", "seq", "now_s", "latency_s", "status", "retry_after", "floor_s"]


def step(t: K.Throttle, slot: K.Slot | None, now: float, latency: float | None, status: int | None, after: str | None, floor: float | None) -> tuple[K.Slot, float]:
    """Reserves, and records the response if there is one; returns the slot and the wait."""
    floor = floor or 0.0
    slot = slot or K.slot(t, floor, now)
    wait = K.reserve(t, slot, floor, now)
    if status is not None:
        K.record(t, slot, latency or 0.0, status, K.retry_after(after), floor, now)
    return slot, wait


def fold(events: DataFrame, t: K.Throttle = K.Throttle()) -> DataFrame:
    """domain, seq, wait_s, delay_s, next_allowed_s after each event (domain, seq, now_s, latency_s, status, retry_after, floor_s).

    A domain's rows come sorted to one task and are folded as they pass: a large domain takes time, not memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domain, slot = None, None
        for b in batches:
            out = []
            for d, seq, *event in zip(*(c.to_pylist() for c in b.columns)):
                if slot is None or d != domain:
                    domain, slot = d, None
                slot, wait = step(t, slot, *event)
                out.append((d, seq, wait, slot.delay, slot.next_allowed))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["domain", "seq", "wait_s", "delay_s", "next_allowed_s"])

    casts = {"domain": "string", "seq": "long", "now_s": "double", "latency_s": "double", "status": "int", "retry_after": "string", "floor_s": "double"}
    rows = events.select(*(F.col(c).cast(casts[c]).alias(c) for c in COLUMNS))
    return rows.repartition("domain").sortWithinPartitions("domain", "seq").mapInArrow(run, SCHEMA)


def constant(events: DataFrame, delay: float) -> DataFrame:
    """events with ready_s: when each may go if a domain's requests are spaced by a constant delay; a window, no fold."""
    w = Window.partitionBy("domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("ready_s", F.coalesce(F.sum(F.lit(float(delay))).over(w), F.lit(0.0)))
