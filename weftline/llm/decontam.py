"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are letters and digits in lower case.  A first pass over the documents
counts, for each n-gram of the benchmark, the documents that hold it.  Each item
then keeps the rarest four fifths of its own n-grams as seeds (a rank within the item,
so a leak into many documents can't use its seeds up), and of the rest the rarest of
every SEED_RUN words, so that each run of so many words taken over verbatim holds one.  A second pass finds the
seeds in every text and aligns the passage around the hits with the item, word
by word; the score is that of the best local alignment as a share of the item's
score with itself.  A passage of a lower share counts too if it holds so many of the
item's words verbatim, one after another (13): every such run holds a seed, so none
is missed, and its row gives the run's own share and place.  The texts are never shuffled; the benchmark's n-grams are
sent to the tasks in slices of at most ``slice_items`` items, one after another,
so that what is broadcast doesn't grow with the benchmark.

Results for odd input: null and empty texts hold nothing; an item of fewer than
n words has its whole self as the only seed, and one without words is left out;
repeated items and rows give repeated results; rows without doc_id are left out
of contaminations and kept by ``remove``; an item that a text holds several times
has a row for each; of overlapping passages the one of the best score counts, of
equal ones the first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as arrow

from . import text as T
from .rows import id_type, rows

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score from which a passage counts as a copy.
THRESHOLD = 0.5
#: Words in a row, taken over verbatim, that count as a copy of an item however long it is.
LEAST_RUN = 13
#: Words in a row of which at least one n-gram is a seed.
SEED_RUN = 6
RARE_SHARE = 0.8
LEAST_SEEDS = 8
SLICE_ITEMS = 20_000


@dataclass
class Items:
    """Benchmark items as word hashes; grams: sorted distinct seeds; entries of seed s: item and place at first[s]:first[s + 1]."""

    ids: pa.Array
    words: list[np.ndarray]
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: int = GRAM

    @classmethod
    def of(cls, ids: pa.Array, texts: list[str | None], size: int = GRAM) -> Items:
        found = [_words(*_single(t or ""))[0] for t in texts]
        there = [k for k, w in enumerate(found) if len(w)]
        return cls(ids.take(pa.array(there, pa.int64())), [found[k] for k in there], size=size)._indexed(None)

    def _indexed(self, keep: list[np.ndarray] | None) -> Items:
        """Over all n-grams, or those places of each item that keep names."""
        gram, item, place = [], [], []
        for k, w in enumerate(self.words):
            g = seeds(w, self.size)
            at = np.arange(len(g)) if keep is None else keep[k]
            gram.append(g[at])
            item.append(np.full(len(at), k))
            place.append(at)
        if not gram:
            return Items(self.ids, self.words, size=self.size)
        gram, item, place = map(np.concatenate, (gram, item, place))
        order = np.lexsort((place, item, gram))
        gram, item, place = gram[order], item[order], place[order]
        grams, first = np.unique(gram, return_index=True)
        return Items(self.ids, self.words, grams, np.append(first, len(gram)), item, place, self.size)

    def rarest(self, count: dict[int, int], share: float = RARE_SHARE, least: int = LEAST_SEEDS) -> Items:
        """With each item's rarest n-grams alone, by count of documents (ties: by hash), and the rarest of every run of SEED_RUN words."""
        keep = []
        for w in self.words:
            g = seeds(w, self.size)
            n = np.array([count.get(int(x), 0) for x in g.view(np.int64)])
            order = np.lexsort((g, n))
            keep.append(order[: max(least, int(np.ceil(len(g) * share)))])
            span = max(1, SEED_RUN - self.size + 1)
            if 0 < span <= len(g):
                rank = np.empty(len(g), np.int64)
                rank[order] = np.arange(len(g))
                keep[-1] = np.union1d(keep[-1], order[np.lib.stride_tricks.sliding_window_view(rank, span).min(axis=1)])
            keep[-1] = np.sort(keep[-1])
        return self._indexed(keep)

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in grams that hold seeds, and which seeds."""
        if not len(self.grams) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A 16-bit table passes over nearly all that isn't a seed.
        maybe = np.flatnonzero(self._table()[(grams >> np.uint64(44)).astype(np.int64)])
        s = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        good = self.grams[s] == grams[maybe]
        return maybe[good], s[good]

    def _table(self) -> np.ndarray:
        if not hasattr(self, "_bits"):
            self._bits = np.zeros(1 << 20, bool)
            self._bits[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        return self._bits


def _single(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return data, np.array([0, len(data)])


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = T.lower(data)
    starts, ends, woff = T.split(low, off, T.ALNUM)
    return (T.word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)), woff


def seeds(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the n-grams of an item; of the whole item if it is shorter."""
    return T.windows(words, min(size, len(words)))


def _grams(words: np.ndarray, woff: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """n-gram hashes of a chunk at all places; those over a text's end are 0."""
    sizes = {items.size} | {len(w) for w in items.words if len(w) < items.size}
    for size in sorted(sizes):
        g = T.windows(words, size)
        if len(g):
            last = np.repeat(woff[1:], np.diff(woff))[: len(g)]
            g[np.arange(len(g)) + size > last] = 0
        yield g


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.grams), np.int64)
        for b in batches:
            for _, _, data, off in T.chunks(b.column(0)):
                words, woff = _words(data, off)
                for g in _grams(words, woff, items):
                    at, s = items.lookup(g)
                    doc = np.searchsorted(woff, at, "right") - 1
                    total += np.bincount(np.unique(doc * len(items.grams) + s) % max(1, len(items.grams)), minlength=len(items.grams))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.grams[at].view(np.int64)), pa.array(total[at])], names=["gram", "n_docs"])

    return run


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word lists, and the end of the first best one in b (exclusive)."""
    n, rows, cols = len(a), max(map(len, a)), max(map(len, b))
    left, right = np.zeros((n, rows), np.uint64), np.ones((n, cols), np.uint64)
    for k in range(n):
        left[k, : len(a[k])] = a[k]
        right[k, : len(b[k])] = b[k]
    slope = (np.arange(cols + 1) * -GAP).astype(np.int32)
    prev, best, end = np.zeros((n, cols + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(rows):
        h = np.zeros((n, cols + 1), np.int32)
        np.maximum(prev[:, :-1] + np.where(right == left[:, i : i + 1], MATCH, MISMATCH).astype(np.int32), prev[:, 1:] + GAP, out=h[:, 1:])
        np.maximum(h, 0, out=h)
        h = np.maximum.accumulate(h + slope, axis=1) - slope
        top = h.max(axis=1)
        more = top > best
        if more.any():
            end[more] = h[more].argmax(axis=1)
            best[more] = top[more]
        prev = h
    return best, end


def verbatim(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest run of words that a and b share, and the end of the first such in b (exclusive)."""
    prev, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for w in a:
        h = np.zeros(len(b) + 1, np.int64)
        h[1:] = np.where(b == w, prev[:-1] + 1, 0)
        top = int(h.max())
        if top > best or (top == best and top and int(h.argmax()) < end):
            best, end = top, int(h.argmax())
        prev = h
    return best, end


def passages(at: np.ndarray, start: np.ndarray, length: int, words: int) -> list[tuple[int, int, np.ndarray]]:
    """(from, to, places of hits) of the stretches of a text that hold the hits of one item; start: where the item would begin."""
    order = np.argsort(start, kind="stable")
    at, start = at[order], start[order]
    cuts = np.flatnonzero(np.diff(start) > length) + 1
    pad = length // 2 + 2
    out = []
    for a, s in zip(np.split(at, cuts), np.split(start, cuts)):
        low, high, a = max(0, int(s[0]) - pad), min(words, int(s[-1]) + length + pad), np.sort(a)
        # A long stretch goes in windows of which one holds each copy whole, so that many copies take time in proportion.
        step = 2 * (length + pad)
        for x in range(low, max(low + 1, high - step), step):
            y = min(high, x + 2 * step)
            hits = a[np.searchsorted(a, x) : np.searchsorted(a, y)]
            if len(hits):
                out.append((x, y, hits))
    return out


def _find(items: Items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, _, data, off in T.chunks(b.column(1)):
                words, woff = _words(data, off)
                places, found = [], []
                for g in _grams(words, woff, items):
                    at, s = items.lookup(g)
                    places.append(at)
                    found.append(s)
                at, s = np.concatenate(places), np.concatenate(found)
                if not len(at):
                    continue
                n = items.first[s + 1] - items.first[s]
                entry = np.repeat(items.first[s] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                at, item = np.repeat(at, n), items.item[entry]
                doc = np.searchsorted(woff, at, "right") - 1
                start = at - items.place[entry] - woff[doc]
                order = np.lexsort((start, item, doc))
                at, item, doc, start = at[order], item[order], doc[order], start[order]
                cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
                jobs = []
                for rows in np.split(np.arange(len(at)), cuts):
                    d, k = int(doc[rows[0]]), int(item[rows[0]])
                    text = words[woff[d] : woff[d + 1]]
                    jobs += [(d, k, x, text[x:y], hits) for x, y, hits in passages(at[rows] - woff[d], start[rows], len(items.words[k]), len(text))]
                yield _aligned(items, jobs, ids, i, threshold)

    return run


def _aligned(items: Items, jobs: list[tuple[int, int, int, np.ndarray, np.ndarray]], ids: pa.Array, first: int, threshold: float) -> pa.RecordBatch:
    found: dict[tuple[int, int], list[tuple]] = {}
    while jobs:
        jobs.sort(key=lambda j: (len(j[3]), len(items.words[j[1]])))
        left = []
        r = 0
        while r < len(jobs):
            # Batches of like size, of some million cells at most.
            step = max(1, min(512, 200_000 // max(1, len(jobs[r][3]))))
            part = jobs[r : r + step]
            a, b = [items.words[j[1]] for j in part], [j[3] for j in part]
            score, end = align(a, b)
            own = np.array([MATCH * len(x) for x in a])
            rows = []
            good = np.flatnonzero(score >= threshold * own)
            if len(good):
                _, back = align([a[k][::-1] for k in good], [b[k][: end[k]][::-1] for k in good])
                # Read backwards, the first best end is the alignment's beginning.
                rows += [(k, float(score[k]), int(end[k]) - length, int(end[k])) for k, length in zip(good.tolist(), back.tolist())]
            for k in np.flatnonzero((score < threshold * own) & (score >= MATCH * LEAST_RUN)).tolist():
                run, stop = verbatim(a[k], b[k])
                if run >= LEAST_RUN:
                    rows.append((k, float(MATCH * run), stop - run, stop))
            for k, points, start, stop in rows:
                d, item, x, text, hits = part[k]
                found.setdefault((d, item), []).append((-points / float(own[k]), x + start, x + stop, len(hits)))
                # What lies before and after it may be a copy too.
                for u, v in ((0, start), (stop, len(text))):
                    rest = hits[(hits >= x + u) & (hits < x + v)]
                    if len(rest):
                        left.append((d, item, x + u, text[u:v], rest))
            r += step
        jobs = left
    keys, rows = [], []
    for key in sorted(found):
        taken: list[tuple] = []
        for row in sorted(found[key]):
            at = bisect_left(taken, row[1], key=lambda t: t[1])
            if (at == 0 or taken[at - 1][2] <= row[1]) and (at == len(taken) or taken[at][1] >= row[2]):
                taken.insert(at, row)
        keys += [key] * len(taken)
        rows += taken
    columns = [[-x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], [x[3] for x in rows]]
    kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    named = [ids.take(pa.array([first + d for d, _ in keys], pa.int64())), items.ids.take(pa.array([k for _, k in keys], pa.int64()))]
    return pa.RecordBatch.from_arrays([*named, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"])


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = GRAM, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """doc_id, item_id, score (up to 1), start_word, end_word, n_seeds of every passage that copies a benchmark item; score below the threshold: a verbatim run of LEAST_RUN words or more."""
    texts = rows(docs).where("doc_id is not null")
    tests = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    slices = max(1, -(-tests.count() // slice_items))
    out = None
    for k in range(slices):
        part = tests if slices == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        got = part.orderBy("item_id", "text").toArrow().combine_chunks()
        items = Items.of(pc.cast(got.column("item_id").combine_chunks(), arrow(benchmark.schema["item_id"].dataType)), got.column("text").to_pylist(), size)
        counts = texts.select("text").mapInArrow(_count(items), "gram long, n_docs long").groupBy("gram").agg(F.sum("n_docs").alias("n")).collect()
        found = texts.mapInArrow(_find(items.rarest({r["gram"]: r["n"] for r in counts}), threshold), f"doc_id {id_type(docs)}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, score double, start_word long, end_word long, n_seeds long")
        out = found if out is None else out.unionByName(found)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, **settings: float) -> DataFrame:
    """docs without the documents that copy a benchmark item."""
    leaks = contaminations(docs, benchmark, **settings).select(F.col("doc_id").alias("__leak_id")).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks["__leak_id"], "left_anti")
