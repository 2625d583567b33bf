"""SimHash near-dedup over vantage-point shards.

Each text gets a 256-bit SimHash of its distinct words (letters and digits,
lower case) and its count of distinct words.  Two texts are near copies when
the fingerprints differ in at most ``radius`` bits and the smaller count is at
least ``size_ratio`` of the larger.  Both are radii in a metric (Hamming distance,
and the difference of log counts), so a vantage-point tree may split on either and
the triangle inequality tells which shards a point's neighbours can be in.  No pair
within both radii is lost.

Results that are defined for odd input: a text without words (null, empty,
punctuation only) has no fingerprint and is alone in its group; a null doc_id
is left out of groups and is kept by ``deduplicate``; repeated rows are copies
of each other; of equal candidates the smallest doc_id is kept; a doc_id may be of
any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import text as T
from .graph import Forest, components
from .rows import id_type, rows as texts_of
from ..sources.shared import cut

WORDS64 = 4
FP = [f"f{i}" for i in range(WORDS64)]
_SEEDS = [np.uint64(0xA0761D6478BD642F * (2 * i + 1) % (1 << 64)) for i in range(WORDS64)]


@dataclass(frozen=True)
class Near:
    radius: int = 48
    size_ratio: float = 0.8

    @property
    def size_margin(self) -> float:
        return -math.log(self.size_ratio) + 1e-9


def fingerprint_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) uint64 fingerprints and the counts of distinct words (0: no fingerprint)."""
    n = len(texts)
    prints, sizes = np.zeros((n, WORDS64), np.uint64), np.zeros(n, np.int64)
    for i, _, data, off in T.chunks(texts):
        low = T.lower(data)
        starts, ends, woff = T.split(low, off, T.ALNUM)
        doc, term, _ = T.terms(T.word_hashes(low, starts, ends), woff)
        at = np.searchsorted(doc, np.arange(len(off)))
        packed = np.stack([T.mix(term ^ s) for s in _SEEDS], axis=1).view(np.uint8)
        for d in range(len(off) - 1):
            a, b = at[d], at[d + 1]
            if a == b:
                continue
            votes = np.zeros(64 * WORDS64, np.int64)
            for c in range(a, b, 4096):
                votes += np.unpackbits(packed[c : min(b, c + 4096)], axis=1).sum(axis=0, dtype=np.int32)
            prints[i + d] = np.packbits(votes * 2 > b - a).view(np.uint64)
            sizes[i + d] = b - a
    return prints, sizes


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints, sizes = fingerprint_batch(b.column(1))
        keep = np.flatnonzero(sizes)
        signed = prints.view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(sizes[keep]), *(pa.array(signed[keep, k]) for k in range(WORDS64))], names=["doc_id", "size", *FP])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, size, f0..f3 of each row that has words and a doc_id."""
    return texts_of(docs).where("doc_id is not null").mapInArrow(_fingerprints, f"doc_id {id_type(docs)}, size long, {', '.join(f'{c} long' for c in FP)}")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of (n, 4) fingerprints to others, or to one."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


# ---- the tree that routes points to shards ----


@dataclass
class Node:
    """A split at distance mu from the vantage point; shard: the number of a leaf's first task, blocks: into how many blocks its points are cut, each pair of them a task."""

    kind: str = ""
    vantage: tuple[int, ...] = ()
    mu: float = 0.0
    inner: Node | None = None
    outer: Node | None = None
    shard: int = -1
    blocks: int = 1

    def distance(self, prints: np.ndarray, size: np.ndarray) -> np.ndarray:
        return size if self.kind == "size" else hamming(prints, np.array(self.vantage, np.uint64))

    def margin(self, near: Near) -> float:
        return near.size_margin if self.kind == "size" else near.radius


def build(prints: np.ndarray, size: np.ndarray, near: Near, scale: float, leaf: int, block: int) -> Node:
    """A tree over a sample; scale: points that each of the sample stands for.  size holds logarithms: distances from the vantage count of one word."""
    tasks = 0
    rng = np.random.default_rng(7)

    def grow(rows: np.ndarray) -> Node:
        nonlocal tasks
        points = len(rows) * scale
        if points > leaf and len(rows) >= 16:
            best, f, s = None, prints[rows], size[rows]
            for kind, vantage in [("size", ()), *(("bits", tuple(map(int, x))) for x in f[rng.integers(0, len(f), 6)])]:
                node = Node(kind, vantage)
                d, margin = node.distance(f, s), node.margin(near)
                node.mu = float(np.median(d))
                low, high = d <= node.mu + margin, d > node.mu - margin
                home = d <= node.mu
                work = (low.mean() * home.mean()) + (high.mean() * (1 - home.mean()))
                if 0 < home.sum() < len(rows) and (best is None or work < best[0]):
                    best = (work, node, home)
            if best and best[0] < 0.85:
                _, node, home = best
                node.inner, node.outer = grow(rows[home]), grow(rows[~home])
                return node
        leaf_ = Node(shard=tasks, blocks=max(1, math.ceil(points / block)))
        tasks += leaf_.blocks * (leaf_.blocks + 1) // 2
        return leaf_

    return grow(np.arange(len(prints)))


def visits(root: Node, prints: np.ndarray, size: np.ndarray, near: Near) -> Iterator[tuple[Node, np.ndarray, np.ndarray]]:
    """(leaf, points at home there, points that may have a neighbour there and whose home is an earlier leaf)."""
    stack = [(root, np.arange(len(prints)), np.ones(len(prints), bool))]
    seen = np.zeros(len(prints), bool)
    while stack:
        node, rows, home = stack.pop()
        if node.shard >= 0:
            yield node, rows[home], rows[~home & seen[rows]]
            seen[rows[home]] = True
            continue
        d, margin = node.distance(prints[rows], size[rows]), node.margin(near)
        inside = d <= node.mu
        low, high = d <= node.mu + margin, d > node.mu - margin
        stack.append((node.outer, rows[high], (home & ~inside)[high]))
        stack.append((node.inner, rows[low], (home & inside)[low]))


#: What a point is to a task: met with the others of its kind and with guests, with guests alone, or a guest.
HOME, LEFT, GUEST = 0, 1, 2


def _prints(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy().view(np.uint64) for c in FP], axis=1)


def _route(root: Node, near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = _prints(b)
            size = np.log(b.column("size").to_numpy())
            tasks, sides, rows = [], [], []

            def put(task: int, side: int, at: np.ndarray) -> None:
                tasks.append(np.full(len(at), task, np.int64))
                sides.append(np.full(len(at), side, np.int8))
                rows.append(at)

            spread = T.mix(prints[:, 0].copy())
            for leaf, own, guests in visits(root, prints, size, near):
                of = (spread[own] % np.uint64(leaf.blocks)).astype(np.int64)
                task = leaf.shard
                for i in range(leaf.blocks):
                    # A block meets itself and the guests in one task, and each later block in another.
                    put(task, HOME, own[of == i])
                    put(task, GUEST, guests)
                    for j in range(i + 1, leaf.blocks):
                        put(task + j - i, LEFT, own[of == i])
                        put(task + j - i, GUEST, own[of == j])
                    task += leaf.blocks - i
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tasks)), pa.array(np.concatenate(sides)), *(b.column(c).take(at) for c in ["rep", "size", *FP])], names=["task", "side", "rep", "size", *FP])

    return run


# ---- exact pairs within a shard ----


def near_pairs(p: np.ndarray, p_size: np.ndarray, q: np.ndarray | None, q_size: np.ndarray | None, near: Near, leaf: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All near pairs as index arrays: within p if q is None, else of p and q.  p, q: (n, 4) fingerprints; sizes are logarithms."""
    within = q is None
    if within:
        q, q_size = p, p_size
    rng = np.random.default_rng(11)

    def search(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """a: rows of p, b: rows of q."""
        if min(len(a), len(b)) > leaf:
            best = None
            sample_a, sample_b = p[rng.choice(a, 256)], q[rng.choice(b, 256)]
            for v in p[rng.choice(a, 4)]:
                da, db = hamming(sample_a, v), hamming(sample_b, v)
                mu = int(np.median(da))
                work = (da <= mu).mean() * (db <= mu + near.radius).mean() + (da > mu).mean() * (db > mu - near.radius).mean()
                if best is None or work < best[0]:
                    best = (work, v, mu)
            work, v, mu = best
            if work < 0.8:
                da, db = hamming(p[a], v), hamming(q[b], v)
                inner, outer = da <= mu, da > mu
                if inner.any() and outer.any():
                    yield from search(a[inner], b[db <= mu + near.radius])
                    yield from search(a[outer], b[db > mu - near.radius])
                    return
        a, b = a[np.argsort(p_size[a], kind="stable")], b[np.argsort(q_size[b], kind="stable")]
        fa, sa, fb, sb = np.ascontiguousarray(p[a].T), p_size[a], np.ascontiguousarray(q[b].T), q_size[b]
        tile, wide = 32, 2048
        xor, count, more, hit = np.empty((tile, wide), np.uint64), np.empty((tile, wide), np.uint8), np.empty((tile, wide), np.uint8), np.empty((tile, wide), bool)
        for i in range(0, len(a), tile):
            rows = min(tile, len(a) - i)
            low, high = np.searchsorted(sb, [sa[i] - near.size_margin, sa[i + rows - 1] + near.size_margin], side="left")
            for j in range(low, high, wide):
                cols = min(wide, high - j)
                x, c, m, h = xor[:rows, :cols], count[:rows, :cols], more[:rows, :cols], hit[:rows, :cols]
                # The first three words can't differ in more bits than all four; of what they let through nearly all is near.
                for word in range(WORDS64 - 1):
                    np.bitwise_xor(fa[word, i : i + rows, None], fb[word, j : j + cols], out=x)
                    np.bitwise_count(x, out=m if word else c)
                    if word:
                        np.add(c, m, out=c)
                np.less_equal(c, near.radius, out=h)
                at = np.flatnonzero(h)
                if not len(at):
                    continue
                u, w = np.divmod(at, cols)
                u, w = a[i + u], b[j + w]
                good = np.abs(p_size[u] - q_size[w]) <= near.size_margin
                if within:
                    good &= u < w
                u, w = u[good], w[good]
                if len(u):
                    good = hamming(p[u], q[w]) <= near.radius
                    if good.any():
                        yield u[good], w[good]

    # Within p each pair is met in both orders; u < w keeps one of them.
    yield from search(np.arange(len(p)), np.arange(len(q)))


def _columns(t: pa.Table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t.column("rep").to_numpy()[at], _prints(t)[at], np.log(t.column("size").to_numpy()[at])


def _shard(near: Near):
    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids, p, size = _columns(t, np.flatnonzero(side != GUEST))
        guests, q, q_size = _columns(t, np.flatnonzero(side == GUEST))
        forest = Forest()
        if (side == HOME).any():
            for u, w in near_pairs(p, size, None, None, near):
                forest.unite(ids[u], ids[w])
        if len(guests) and len(ids):
            for u, w in near_pairs(p, size, q, q_size, near):
                forest.unite(ids[u], guests[w])
        a, b = forest.edges()
        return pa.table({"a": a, "b": b})

    return run


def near_edges(points: DataFrame, near: Near = Near(), leaf: int = 16_384, block: int = 16_384, sample: int = 4096) -> DataFrame:
    """a, b: edges that connect what the near pairs of points (rep, size, f0..f3; distinct) connect.

    The sample places the vantage points alone; pairs are exact wherever they stand.
    """
    total = points.count()
    some = points.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, total))) + 1)).select("size", *FP).toArrow()
    root = build(_prints(some), np.log(np.maximum(some.column("size").to_numpy(), 1)), near, total / max(1, some.num_rows), leaf, block)
    tasks, stack = 0, [root]
    while stack:
        node = stack.pop()
        if node.shard >= 0:
            tasks += node.blocks * (node.blocks + 1) // 2
        else:
            stack += [node.inner, node.outer]
    routed = points.select("rep", "size", *FP).mapInArrow(_route(root, near), f"task long, side tinyint, rep long, size long, {', '.join(f'{c} long' for c in FP)}")
    return routed.repartition(tasks, "task").groupBy("task").applyInArrow(_shard(near), "a long, b long")


def near_groups(docs: DataFrame, near: Near = Near(), **plan: int) -> DataFrame:
    """doc_id, f0..f3, size, group_id, keep, root for each row with words and a doc_id.

    group_id is the smallest doc_id of the row's group, and root the group itself: where a
    doc_id repeats with different texts, several groups may have the same smallest one.
    keep marks the rows of one text of each group, under that doc_id.
    """
    prints = cut(fingerprints(docs))
    # The checkpoint fixes the numbers by which distinct fingerprints go.
    points = cut(prints.groupBy("size", *FP).agg(F.min("doc_id").alias("doc")).withColumn("rep", F.monotonically_increasing_id()))
    edges = components(near_edges(points, near, **plan))
    members = edges.select(F.col("node").alias("rep"), "root").union(edges.select("root", "root").distinct())
    members = cut(members.join(points.select("rep", "doc"), "rep"))
    first = F.min(F.struct("doc", "rep"))
    groups = members.groupBy("root").agg(first.alias("first"))
    told = members.join(groups, "root").select("rep", "root", F.col("first.doc").alias("group_id"), (F.col("rep") == F.col("first.rep")).alias("first"))
    named = points.join(told, "rep", "left").select("size", *FP, F.coalesce("root", "rep").alias("root"), F.coalesce("group_id", "doc").alias("group_id"), F.coalesce("first", F.lit(True)).alias("first"))
    out = prints.join(named, ["size", *FP])
    return out.select("doc_id", "size", *FP, "group_id", (F.col("first") & (F.col("doc_id") == F.col("group_id"))).alias("keep"), "root")


def near_dups(docs: DataFrame, near: Near = Near(), **plan: int) -> DataFrame:
    """doc_id, group_id, group_size, keep of all rows that have a near copy."""
    g = near_groups(docs, near, **plan)
    sizes = g.groupBy("root").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return g.join(sizes, "root").select("doc_id", "group_id", "group_size", "keep")


def _with_prints(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sizes = fingerprint_batch(b.column(at))
            more = [pa.array(sizes), *(pa.array(prints[:, k].copy().view(np.int64)) for k in range(WORDS64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "__size", *(f"__{c}" for c in FP)])

    return run


def _by_row(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs to keep, by doc_id and fingerprint: one for each kept text of an id, and those without words."""
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    inner = inner.withColumn("__id", F.col(f"c{docs.columns.index('doc_id')}")).withColumn("__text", F.col(f"c{docs.columns.index('text')}").cast("string"))
    schema = StructType([*inner.schema.fields, *(StructField(f"__{c}", LongType()) for c in ["size", *FP])])
    rows = inner.mapInArrow(_with_prints(len(inner.columns) - 1), schema).withColumn("__print", F.when(F.col("__size") > 0, F.xxhash64("__size", *(f"__{c}" for c in FP))))
    kept = groups.where("keep").select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), F.lit(True).alias("__keep")).distinct()
    nth = F.row_number().over(Window.partitionBy("__id", "__print").orderBy(F.xxhash64("__text"), "__text"))
    rows = rows.join(kept, ["__id", "__print"], "left").withColumn("__nth", nth).where("__print is null or (__keep and __nth = 1)")
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def deduplicate(docs: DataFrame, near: Near = Near(), **plan: int) -> DataFrame:
    """docs with one row of each group of near copies; rows without words or doc_id stay as they are."""
    groups = cut(near_groups(docs, near, **plan).select("doc_id", "keep", F.xxhash64("size", *FP).alias("print")))
    # Where an id has rows of several texts, or two rows of one, each row is judged; elsewhere the id tells it.
    several = cut(groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__several_id")))
    drop = groups.where("not keep").select(F.col("doc_id").alias("__drop_id")).distinct()
    if several.isEmpty():
        return docs.join(drop, docs["doc_id"] == drop["__drop_id"], "left_anti")
    once = docs.join(several, docs["doc_id"] == several["__several_id"], "left_anti")
    once = once.join(drop, once["doc_id"] == drop["__drop_id"], "left_anti")
    more = docs.join(several, docs["doc_id"] == several["__several_id"], "left_semi")
    return once.unionByName(_by_row(more, groups))
