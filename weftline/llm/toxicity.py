"""Toxicity: cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words (letters, lower case) and the first 4
to 8 bytes of each, hashed, and each of them at several levels: from one, two or
four occurrences on, and from shares of half a per cent, one, two or four of the
text's words on, so that a word that long harmless texts hold by chance weighs
little.  All thresholds share one weight vector: P(grade >= k) =
sigmoid(w.x - threshold_k), thresholds in order, and the result is the expected
grade, sum over k of P(grade >= k).

Labels may hold grades themselves.  Labels of 0 and 1 alone tell no degrees, so
positives are then graded 1 to 3 by how much of the text the evidence fills.  What
counts as evidence is found on the other half of the labelled texts, by a fit with
one threshold, so that no text's grade rests on its own label; positives with
evidence are cut at the terciles of their share of it, and those without have
grade 1.

Results for odd input: a null or empty text has no features and gets the grade of
the thresholds alone, which is lowest; without labels of two grades every
severity is 0; labels without a document are left out; repeated rows get equal
results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .labelled import labelled
from .rows import id_type, rows
from ..sources.shared import cut

BITS = 20
#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 20_000
PREFIXES = (4, 5, 6, 7, 8)
#: Twice the logarithm of the likelihood ratio from which a feature counts as evidence.
EVIDENCE = 20.0
#: Levels of a feature: occurrences, then shares of the words.
COUNTS, SHARES = np.array([1, 2, 4]), np.array([0.005, 0.01, 0.02, 0.04])
LEVELS = len(COUNTS) + len(SHARES)


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, 1 + prefixes) feature numbers of a chunk's words, and each text's range among the words."""
    low = T.lower(data)
    starts, ends, woff = T.split(low, off, T.LETTERS)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), woff
    sums = T.prefix_sums(low)
    hashes = [T.spans_hash(sums, starts, ends)]
    for k, n in enumerate(PREFIXES, 1):
        # A word's beginning is another feature than a whole word of the same letters.
        hashes.append(T.mix(T.spans_hash(sums, starts, np.minimum(starts + n, ends)) + np.uint64(k)))
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in hashes], axis=1), woff


def levels(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(n, LEVELS) of which levels a feature reaches that stands count times among so many words."""
    return np.concatenate([count[:, None] >= COUNTS, count[:, None] >= SHARES * words[:, None]], axis=1)


@dataclass
class Model:
    """weights: (features, LEVELS) of the feature numbers ids, in order; thresholds in increasing order (empty: constant)."""

    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def linear(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.ids):
            return out
        place = np.full(1 << BITS, -1, np.int32)
        place[self.ids] = np.arange(len(self.ids))
        for i, j, data, off in T.chunks(texts):
            f, woff = word_features(data, off)
            if not len(f):
                continue
            at = place[f.ravel()]
            used = np.flatnonzero(at >= 0)
            doc = T.doc_of(woff)[used // f.shape[1]]
            key, count = np.unique(doc * len(self.ids) + at[used], return_counts=True)
            doc, at = np.divmod(key, len(self.ids))
            value = (self.weights[at] * levels(count, np.diff(woff)[doc])).sum(axis=1)
            out[i:j] = np.bincount(doc, value, len(off) - 1)
        return out

    def at_least(self, linear: np.ndarray) -> np.ndarray:
        """(n, grades) probabilities of each grade or more."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - linear[:, None], -50, 50)))


def _dot(flat: np.ndarray, off: np.ndarray, w: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(w[flat])])
    return sums[off[1:]] - sums[off[:-1]]


def fit_ordinal(flat: np.ndarray, off: np.ndarray, grade: np.ndarray, n_features: int, l1: float = 0.02, l2: float = 0.02, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds; row i has the features flat[off[i]:off[i+1]].

    Accelerated proximal steps on the sum over thresholds of the logistic losses of
    "grade >= k": the cumulative-link model's binary decomposition with shared weights.
    """
    ks = np.arange(1, int(grade.max()) + 1)
    y = (grade[:, None] >= ks[None, :]).astype(float)
    share = np.clip(y.mean(axis=0), 1e-4, 1 - 1e-4)
    b = np.log((1 - share) / share)
    w, width = np.zeros(n_features), np.diff(off)
    # A diagonal bound on the curvature: each row's loss is shared among its features by their number.
    bound = 0.25 * len(ks) * np.bincount(flat, np.repeat(width + 1, width), n_features)
    rate = 1 / (bound + l2)
    b_rate = 1 / (0.25 * float((width + 1).sum()))
    v, vb, t = w.copy(), b.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(vb[None, :] - _dot(flat, off, v)[:, None], -50, 50)))
        r = p - y
        g = np.bincount(flat, np.repeat(r.sum(axis=1), width), n_features) + l2 * v
        new = v - rate * g
        new = np.maximum(new - rate * l1, 0)
        new_b = np.maximum.accumulate(vb + b_rate * r.sum(axis=0))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if np.dot(v - new, new - w) > 0:
            t, t_next = 1.0, (1 + np.sqrt(5)) / 2
        v, vb = new + (t - 1) / t_next * (new - w), np.maximum.accumulate(new_b + (t - 1) / t_next * (new_b - b))
        w, b, t = new, new_b, t_next
    return w, b


@dataclass
class Evidence:
    """What of labelled texts a fit needs: label, each text's chosen features (number * LEVELS + level), which half it is of, and the share of its words that some chosen numbers fill."""

    label: np.ndarray
    chosen: np.ndarray
    small: np.ndarray
    off: np.ndarray
    share: Callable[[np.ndarray], np.ndarray]
    half: np.ndarray


def _rows(flat: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept rows of lists given by offsets."""
    length = np.diff(off)
    return flat[np.repeat(keep, length)], np.concatenate([[0], np.cumsum(length[keep])])


def fit(e: Evidence, grades: int = 3) -> Model:
    """Labels are grades, or 0 and 1."""
    label, chosen = np.maximum(e.label, 0), e.chosen
    if len(label) == 0 or label.min() == label.max():
        return Model(np.zeros(0, np.int64), np.zeros((0, LEVELS)), np.zeros(0))
    grade = label
    if label.max() == 1 and len(chosen):
        share, positive = np.zeros(len(label)), label > 0
        for side in (0, 1):
            mine, other = e.half == side, e.half != side
            if mine.any() and label[other].any():
                w, _ = fit_ordinal(*_rows(e.small, e.off, other), label[other], len(chosen))
                share[mine] = e.share(np.unique(chosen[w > 0.1] // LEVELS))[mine]
        known = positive & (share > 0)
        cuts = np.quantile(share[known], [i / grades for i in range(1, grades)]) if known.any() else np.ones(grades - 1)
        grade = np.where(positive, 1 + np.searchsorted(cuts, share, "right"), 0)
    w, b = fit_ordinal(e.small, e.off, grade, max(1, len(chosen)))
    ids, inverse = np.unique(chosen // LEVELS, return_inverse=True)
    weights = np.zeros((len(ids), LEVELS))
    if len(chosen):
        weights[inverse, chosen % LEVELS] = w
    some = weights.any(axis=1)
    return Model(ids[some], weights[some], b)


def _texts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of texts: its range, and text, number and count of each distinct feature; the words of each text."""
    for i, j, data, off in T.chunks(texts):
        f, woff = word_features(data, off)
        doc = np.repeat(T.doc_of(woff), f.shape[1])
        key, count = np.unique((doc << BITS) | f.ravel(), return_counts=True)
        yield i, j, key >> BITS, key & ((1 << BITS) - 1), count, np.diff(woff)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature and level stands, and in how many positive ones; number -1: all texts."""
    total, found = np.zeros((LEVELS << BITS, 2), np.int32), np.zeros(2, np.int64)
    for b in batches:
        positive = b.column(2).to_numpy() > 0
        found += [b.num_rows, positive.sum()]
        for i, j, doc, number, count, words in _texts(b.column(1)):
            at, level = np.nonzero(levels(count, words[doc]))
            feature, yes = number[at] * LEVELS + level, positive[i:j][doc[at]]
            np.add.at(total[:, 0], feature, 1)
            np.add.at(total[:, 1], feature[yes], 1)
    # A feature of no positive text can't be evidence.
    at = np.flatnonzero(total[:, 1])
    for c in range(0, len(at), 1 << 16):
        part = at[c : c + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part, 0].astype(np.int64)), pa.array(total[part, 1].astype(np.int64))], names=["feature", "n", "n1"])
    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([int(found[0])]), pa.array([int(found[1])])], names=["feature", "n", "n1"])


def choose(tally: DataFrame, evidence: float = EVIDENCE) -> np.ndarray:
    """Features in whose texts the share of positive ones is above that of all, by a likelihood ratio (twice its logarithm) of evidence.

    A ratio, and no z score, so that rare features don't pass by chance: of features that stand
    in positive texts alone it takes some five texts where every seventh is positive.

    Weights are evidence for toxicity and not below 0, so that a long text can't outweigh it with harmless words.
    """
    sums = tally.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    whole = sums.where("feature = -1").first()
    n, n1 = (whole["n"], whole["n1"]) if whole else (0, 0)
    if not 0 < n1 < n:
        return np.zeros(0, np.int64)
    k, m, p = F.col("n1"), F.col("n") - F.col("n1"), n1 / n
    ratio = 2 * (k * F.log(k / (F.col("n") * p)) + F.when(m > 0, m * F.log(m / (F.col("n") * (1 - p)))).otherwise(0.0))
    rows = sums.where((F.col("feature") >= 0) & (k > F.col("n") * p)).where(ratio >= evidence)
    return np.array(sorted(r["feature"] for r in rows.select("feature").collect()), np.int64)


def _chosen(chosen: np.ndarray):
    ids = np.unique(chosen // LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, doc, number, count, words in _texts(b.column(1)):
                k = np.minimum(np.searchsorted(ids, number), max(0, len(ids) - 1))
                mine = np.flatnonzero(ids[k] == number) if len(ids) else np.zeros(0, np.int64)
                doc_, k, count = doc[mine], k[mine], count[mine]
                at, level = np.nonzero(levels(count, words[doc_]))
                feature = ids[k[at]] * LEVELS + level
                c = np.minimum(np.searchsorted(chosen, feature), max(0, len(chosen) - 1))
                good = np.flatnonzero(chosen[c] == feature) if len(chosen) else np.zeros(0, np.int64)
                ends = lambda d: pa.array(np.searchsorted(d, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends(d), pa.array(v.astype(np.int32))) for d, v in ((doc_[at][good], c[good]), (doc_, k), (doc_, count))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(words), *lists], names=["doc_id", "y", "words", "small", "number", "count"])

    return run


def gather(rows: pa.Table, chosen: np.ndarray) -> Evidence:
    ids = np.unique(chosen // LEVELS)

    def column(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = rows.column(name).combine_chunks()
        length = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0)
        flat = lists.flatten().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0)
        return flat.astype(np.int64), np.concatenate([[0], np.cumsum(length)]).astype(np.int64)

    small, off = column("small")
    number, at = column("number")
    count, _ = column("count")
    words = np.maximum(rows.column("words").to_numpy(), 1)

    def share(evidence: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(np.where(np.isin(ids[number] if len(ids) else number, evidence), count, 0))])
        return (sums[at[1:]] - sums[at[:-1]]) / words

    half = T.mix(np.arange(len(words), dtype=np.uint64) + np.uint64(1)) & np.uint64(1)
    return Evidence(rows.column("y").to_numpy(), chosen, small, off, share, half)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of labels.toxic fitted on at most train_rows labelled documents.

    Features are counted and chosen over the cluster; of each text only its chosen ones come to the driver.
    """
    some = cut(labelled(docs, labels, "toxic", train_rows))
    chosen = choose(some.mapInArrow(_tally, "feature long, n long, n1 long"))
    found = some.mapInArrow(_chosen(chosen), f"doc_id {id_type(docs)}, y int, words long, small array<int>, number array<int>, count array<int>").toArrow()
    return fit(gather(found.sort_by("doc_id"), chosen))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.at_least(model.linear(b.column(1)))
            any_ = p[:, 0] if p.shape[1] else np.zeros(len(p))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(any_ >= 0.5)], names=["doc_id", "severity", "grade", "toxic"])

    return run


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (thresholds passed with a probability of a half or more), toxic (grade of 1 or more)."""
    return rows(docs).mapInArrow(_score(model), f"doc_id {id_type(docs)}, severity double, grade int, toxic boolean")
