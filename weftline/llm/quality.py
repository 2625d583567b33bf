"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and lengths taken from the bytes and words of a text.  Each
is cut into quantile bins; boosting goes round the features in turn, and each
step fits a tree of depth two to the gradients of one feature's bins and adds
its leaf values to that feature's lookup table.  The strongest pairs by what a
two-way cut would still gain are boosted the same way as two-dimensional tables.
A score is the sum of looked-up values, over whole columns at a time.

Results for odd input: a null or empty text has all features 0 and is scored as
such; without labels of both classes the model is constant and keeps everything;
extra columns pass through; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .labelled import labelled
from .rows import id_type, rows

FEATURES = ["log_words", "word_bytes", "upper", "symbols", "digits", "spaces", "line_words", "repeats", "distinct", "lone_symbols", "ends", "top_share"]
#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 20_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_SYMBOL[[ord(c) for c in ".,'\"-"]] = False
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def features(texts: pa.Array) -> np.ndarray:
    """(n, features) float64."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, j, data, off in T.chunks(texts):
        starts, ends, woff = T.split(data, off, T.NON_SPACE)
        if not len(starts):
            continue
        size = np.maximum(np.diff(off), 1)
        words = np.diff(woff)
        per = np.maximum(words, 1)

        def share(mask: np.ndarray) -> np.ndarray:
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(mask, out=total[1:])
            return total[off[1:]] - total[off[:-1]]

        def by_word(mask: np.ndarray) -> np.ndarray:
            total = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(mask, out=total[1:])
            return total[woff[1:]] - total[woff[:-1]]

        upper = (data >= 65) & (data <= 90)
        letters = share(T.LETTERS[data])
        hashes = T.word_hashes(data, starts, ends)
        same = np.zeros(len(starts), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        doc, _, count = T.terms(hashes, woff)
        at = np.searchsorted(doc, np.arange(len(off)))
        most = np.zeros(len(off) - 1)
        filled = np.flatnonzero(np.diff(at))
        if len(filled):
            most[filled] = np.maximum.reduceat(count, at[filled])
        out[i:j] = np.stack(
            [
                np.log1p(words),
                by_word(ends - starts) / per,
                share(upper) / np.maximum(letters, 1),
                share(_SYMBOL[data]) / size,
                share((data >= 48) & (data <= 57)) / size,
                share(T.SPACE[data]) / size,
                words / (1 + share(data == 10)),
                by_word(same) / per,
                np.diff(at) / per,
                by_word((ends - starts == 1) & _SYMBOL[data[starts]]) / per,
                by_word(_END[data[ends - 1]]) / per,
                most / per,
            ],
            axis=1,
        )
    return out


@dataclass
class Model:
    """cuts: inner bin edges of each feature; tables: values by bin; pairs: (f, g, coarse edges of both, table)."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality."""
        s = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            s += table[np.searchsorted(cut, x[:, f], "right")]
        for f, g, cf, cg, table in self.pairs:
            s += table[np.searchsorted(cf, x[:, f], "right"), np.searchsorted(cg, x[:, g], "right")]
        return s


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values, by bin, of a tree of depth two over ordered bins."""
    out = np.zeros(len(g))
    _, k = _best_cut(g, h, ridge)
    for a, b in ((0, k), (k, len(g))):
        gain, m = _best_cut(g[a:b], h[a:b], ridge)
        for c, d in ((a, a + m), (a + m, b)) if gain > 1e-9 else ((a, b),):
            if d > c:
                out[c:d] = g[c:d].sum() / (h[c:d].sum() + ridge)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts a two-way table once by each feature."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        _, k = _best_cut(gg.sum(1), hh.sum(1), ridge)
        out, total = np.zeros_like(gg), 0.0
        for rows in (slice(0, k), slice(k, None)):
            _, m = _best_cut(gg[rows].sum(0), hh[rows].sum(0), ridge)
            for cols in (slice(0, m), slice(m, None)):
                a, b = gg[rows, cols].sum(), hh[rows, cols].sum()
                out[rows, cols] = a / (b + ridge)
                total += a * a / (b + ridge)
        if total > best[0]:
            best = (total, out.T if turn else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, bins: int = 32, pairs: int = 6, rate: float = 0.15, ridge: float = 1.0) -> Model:
    """y: 1 for good. Constant (keeping all) unless both classes are there."""
    y = (y > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(base=4.0)
    p = y.mean()
    model = Model(base=float(np.log(p / (1 - p))))
    score = np.full(len(y), model.base)
    model.cuts = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-score))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for f, b in enumerate(binned):
            g, h = gradient()
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), ridge)
            model.tables[f] += step
            score += step[b]
    coarse = [_edges(x[:, f], 8) for f in range(x.shape[1])]
    cell = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]
    g, h = gradient()
    found = []
    for f in range(x.shape[1]):
        for k in range(f):
            shape = (len(coarse[k]) + 1, len(coarse[f]) + 1)
            at = cell[k] * shape[1] + cell[f]
            gain, _ = _tree2(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape), ridge)
            found.append((gain, k, f, shape, at))
    chosen = sorted(found, key=lambda z: -z[0])[:pairs]
    tables = [np.zeros(shape) for _, _, _, shape, _ in chosen]
    for _ in range(rounds // 2):
        for table, (_, _, _, shape, at) in zip(tables, chosen):
            g, h = gradient()
            _, step = _tree2(np.bincount(at, g, table.size).reshape(shape), np.bincount(at, h, table.size).reshape(shape), ridge)
            table += rate * step
            score += rate * step.ravel()[at]
    model.pairs = [(k, f, coarse[k], coarse[f], t) for t, (_, k, f, _, _) in zip(tables, chosen)]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x[:, f]) for f in range(x.shape[1]))], names=["doc_id", "y", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, **settings: float) -> Model:
    """A model of labels.quality fitted on at most train_rows labelled documents; their features alone come to the driver."""
    got = labelled(docs, labels, "quality", train_rows).mapInArrow(_features, f"doc_id {id_type(docs)}, y int, {', '.join(f'{c} double' for c in FEATURES)}").toPandas()
    got = got.sort_values(["doc_id", *FEATURES], kind="stable")
    return fit(got[FEATURES].to_numpy(float), got["y"].to_numpy(), **settings)


def _score(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(b.column(at).cast(pa.string())))
            p = 1 / (1 + np.exp(-s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "quality_score", "keep"])

    return run


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, quality_score (probability of good), keep, of every row."""
    return rows(docs).mapInArrow(_score(model, 1), f"doc_id {id_type(docs)}, quality_score double, keep boolean")


def _filter(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column(at).cast(pa.string()))) >= 0))

    return run


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without the rows that the model rejects; no shuffle."""
    return docs.mapInArrow(_filter(model, docs.columns.index("text")), docs.schema)
