"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Nodes that a task's forest holds before it passes them on (some 200 MB).
HELD = 2_000_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x < y:
                up[y] = x
                up.setdefault(x, x)
            elif y < x:
                up[x] = y
                up.setdefault(y, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of all members but the roots."""
        a = [x for x, y in self.up.items() if x != y]
        return np.array(a, np.int64), np.array([self.root(x) for x in a], np.int64)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars; at most so many at a time are held."""
    forest = Forest()

    def stars() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest.edges()], names=["a", "b"])

    for b in batches:
        forest.unite(b.column(0).to_numpy(), b.column(1).to_numpy())
        if len(forest.up) > HELD:
            yield stars()
            forest = Forest()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node that isn't the smallest of its component; edges: (a, b) of longs.

    Each partition's edges become stars; then alternating large-star and small-star
    rounds, each cut by a checkpoint, until no edge changes.
    """
    edges = cut(edges.toDF("a", "b").where("a is not null and b is not null and a <> b").mapInArrow(_local, "a long, b long").distinct())
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)
