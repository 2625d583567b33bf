"""Substring dedup: passages of many words that stand in two or more documents.

Every run of ``window`` words (ended by ASCII white space) is a window.  The
anchor of a window is the least hash of the grams of about half its length in
it; equal windows have equal anchors, so the number of documents with an anchor
is never less than the number with the window.  A first pass counts documents
by anchor in a count-min sketch: each partition makes a sparse saturating one,
and they are merged block by block.  A second pass takes only the windows whose
anchors are estimated in two or more documents, and groups them exactly by a
128-bit hash.  An estimate can be too high (more to group) and never too low, so
no repeated window is lost.  The sketch's width is fixed, and so is the largest
thing broadcast (a bit per cell); with far more text than cells it filters less
and the exact grouping takes more, in proportion to the text.

Results for odd input: null, empty and shorter texts have no windows; rows
without doc_id are left out; a doc_id may be of any type; rows that share one are
one document, so copies within it aren't repeats; positions count words of the row's own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .rows import id_type, rows

WINDOW = 50
#: The sketch has two rows of 2**WIDTH_BITS cells.
WIDTH_BITS = 29
BLOCK_BITS = 22


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, woff = T.split(data, off, T.NON_SPACE)
    return (T.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), woff


def _starts(woff: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and text numbers of all windows that lie within a text."""
    n = np.maximum(np.diff(woff) - window + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    return np.repeat(woff[:-1] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0), doc


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window at each place (places near a text's end hold words of the next one)."""
    gram = window // 2 + 1
    g = T.windows(hashes, gram)
    width = window - gram + 1
    done = 1
    while done < width and len(g):
        step = min(done, width - done)
        g = np.minimum(g[: len(g) - step], g[step:])
        done += step
    return T.mix(g) if len(g) else g


def cells(anchor: np.ndarray, bits: int) -> np.ndarray:
    """The cells, one of each row, of some anchors: shape (2, n)."""
    low = np.uint64((1 << bits) - 1)
    return np.stack([anchor & low, ((anchor >> np.uint64(32)) & low) + np.uint64(1 << bits)]).astype(np.uint32)


def _sketch(window: int, bits: int, block_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for b in batches:
            # Within the batch a document is the number of its id.
            ids = b.column(0).dictionary_encode().indices.to_numpy()
            for i, _, data, off in T.chunks(b.column(1)):
                hashes, woff = _words(data, off)
                at, doc = _starts(woff, window)
                if not len(at):
                    continue
                a = anchors(hashes, window)[at]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                # Anchors are counted once a document, as far as rows of a chunk tell.
                pair = _once(ids[i + doc[new]], a[new])
                kept.append(cells(pair, bits).ravel())
        if not kept:
            return
        cell, count = np.unique(np.concatenate(kept), return_counts=True)
        block = (cell >> np.uint32(block_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(block)) + 1
        rows = [(int(block[s[0]]), cell[s].tobytes(), cell[s[count[s] > 1]].tobytes()) for s in np.split(np.arange(len(cell)), cuts)]
        for r in range(0, len(rows), 64):
            blocks, once, twice = zip(*rows[r : r + 64])
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])

    return run


def _once(ids: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    order = np.lexsort((anchor, ids))
    ids, anchor = ids[order], anchor[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (anchor[1:] != anchor[:-1])
    return anchor[new]


def _merge(block_bits: int):
    """Merges the partitions' sketches of each block as they pass, sorted by block: two bits a cell, however many partitions there are."""
    size, low = 1 << block_bits, np.uint32((1 << block_bits) - 1)

    def flagged(block: int, again: np.ndarray) -> tuple[int, bool, bytes]:
        found = np.flatnonzero(again)
        if len(found) * 32 > size:
            return block, True, np.packbits(again, bitorder="little").tobytes()
        return block, False, (found.astype(np.uint32) + np.uint32(block << block_bits)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, again = None, np.zeros(size, bool), np.zeros(size, bool)
        for b in batches:
            out = []
            for block, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                if block != now:
                    if now is not None:
                        out.append(flagged(now, again))
                        seen[:] = again[:] = False
                    now = block
                cell = np.frombuffer(once, np.uint32) & low
                again[cell[seen[cell]]] = True
                again[np.frombuffer(twice, np.uint32) & low] = True
                seen[cell] = True
            yield _flag_rows(out)
        yield _flag_rows([flagged(now, again)] if now is not None else [])

    return run


def _flag_rows(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    blocks, dense, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(dense, pa.bool_()), pa.array(payload, pa.binary())], names=["block", "dense", "payload"])


@dataclass
class Flags:
    """Cells with an estimate of two or more: sorted ones, and blocks as bits."""

    sparse: np.ndarray
    dense: dict[int, np.ndarray]
    bits: int = WIDTH_BITS
    block_bits: int = BLOCK_BITS

    def has(self, cell: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), bool)
        if len(self.sparse):
            out = self.sparse[np.minimum(np.searchsorted(self.sparse, cell), len(self.sparse) - 1)] == cell
        for block, packed in self.dense.items():
            mine = np.flatnonzero((cell >> np.uint32(self.block_bits)) == block)
            at = cell[mine] & np.uint32((1 << self.block_bits) - 1)
            out[mine] = (packed[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1
        return out

    def repeated(self, anchor: np.ndarray) -> np.ndarray:
        a, b = cells(anchor, self.bits)
        return self.has(a) & self.has(b)


def flags(docs: DataFrame, window: int = WINDOW, bits: int = WIDTH_BITS, block_bits: int = BLOCK_BITS) -> Flags:
    """The merged sketch's repeated cells; at most a bit a cell comes to the driver. docs: (doc_id, text)."""
    block_bits = min(block_bits, bits + 1)
    parts = docs.mapInArrow(_sketch(window, bits, block_bits), "block long, once binary, twice binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge(block_bits), "block long, dense boolean, payload binary")
    rows = merged.collect()
    sparse = sorted((r["block"], r["payload"]) for r in rows if not r["dense"])
    return Flags(np.frombuffer(b"".join(bytes(p) for _, p in sparse), np.uint32), {r["block"]: np.frombuffer(bytes(r["payload"]), np.uint8) for r in rows if r["dense"]}, bits, block_bits)


def _flagged(window: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: Flags = shared.value
        for b in batches:
            ids = b.column(0)
            for i, _, data, off in T.chunks(b.column(1)):
                hashes, woff = _words(data, off)
                at, doc = _starts(woff, window)
                if not len(at):
                    continue
                a = anchors(hashes, window)[at]
                new = np.ones(len(a), bool)
                new[1:] = a[1:] != a[:-1]
                take = sketch.repeated(a[new])[np.cumsum(new) - 1]
                at, doc = at[take], doc[take]
                if len(at):
                    h1, h2 = T.windows(hashes, window)[at].view(np.int64), T.windows(hashes, window, 0x6A09E667F3BCC909)[at].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), ids.take(pa.array(i + doc)), pa.array((at - woff[doc]).astype(np.int32))], names=["h1", "h2", "doc_id", "pos"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and pos of the windows of two or more documents, of rows sorted by window and document.

    Rows are judged as they pass: only those of a window's first document are held
    until a second one comes, so a passage that any number of documents share takes no memory.
    """
    held = None
    known = None  # the window at the last batch's end, if it is a repeated one
    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        h1, h2, doc, pos = columns if held is None else (np.concatenate(x) for x in zip(held, columns))
        if not len(h1):
            continue
        first = np.ones(len(h1), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(h1))
        good = doc[begin] != doc[end - 1]
        if known == (h1[0], h2[0]):
            good[0] = True
        known = (h1[-1], h2[-1]) if good[-1] else None
        last = begin[-1] if not good[-1] else len(h1)
        held = [x[last:] for x in (h1, h2, doc, pos)]
        take = np.repeat(good, end - begin)
        yield pa.RecordBatch.from_arrays([pa.array(doc[take], b.column(2).type), pa.array(pos[take].astype(np.int32))], names=["doc_id", "pos"])


def _runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            pos = lists.flatten().to_numpy().astype(np.int64)
            order = np.lexsort((pos, doc))
            doc, pos = doc[order], pos[order]
            first = np.ones(len(pos), bool)
            # Windows that overlap or meet make one passage.
            first[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
            begin = np.flatnonzero(first)
            end = np.append(begin[1:], len(pos)) - 1
            start, stop = pos[begin], pos[end] + window
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[begin])), pa.array(start), pa.array(stop), pa.array(stop - start)], names=["doc_id", "start_word", "end_word", "n_words"])

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, bits: int = WIDTH_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words: the longest runs of windows at neighbouring places that each stand in two or more documents."""
    kind, texts = id_type(docs), rows(docs).where("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(flags(texts, window, bits, block_bits))
    found = texts.mapInArrow(_flagged(window, shared), f"h1 long, h2 long, doc_id {kind}, pos int")
    windows = found.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id")
    places = windows.mapInArrow(_repeated, f"doc_id {kind}, pos int").groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))
    return places.mapInArrow(_runs(window), f"doc_id {kind}, start_word long, end_word long, n_words long")
