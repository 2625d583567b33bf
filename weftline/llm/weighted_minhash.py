"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its words (letters and digits, lower case), each
weighted by its count.  Sample k of a text draws r, c ~ Gamma(2, 1) and
b ~ U(0, 1) for each term from the term's hash alone, quantises the logarithm of
the weight to t = floor(ln w / r + b), and takes the term with the least
ln a = ln c - r (t - b) - r.  Two texts agree in sample k, in term and t, with a
probability that is their generalised Jaccard similarity
sum(min(w)) / sum(max(w)).

A text without words (null, empty) has an empty signature; ties go to the term
of the least hash; repeated rows give equal signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .rows import id_type, rows

SAMPLES = 64
_BLOCK = 8192
_G = np.uint64(0x9E3779B97F4A7C15)


def draws(term: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b, each of shape (terms, samples)."""
    base = T.mix(term.copy())[:, None] + (np.arange(1, samples + 1, dtype=np.uint64) * _G)[None, :]
    low = np.uint64(0xFFFFFFFF)
    uniform = lambda x: ((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32), lambda x: ((x & low).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
    x = T.mix(base)
    r = -np.log(uniform[0](x) * uniform[1](x))
    x = T.mix(x + _G)
    ln_c = np.log(-np.log(uniform[0](x) * uniform[1](x) * np.float32(1 - 1e-7)))
    b = uniform[0](T.mix(x + _G)) * np.float32(1 - 1e-7)
    return np.maximum(r, np.float32(1e-7)), ln_c, b


def signatures(texts: pa.Array, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """(n, samples) int64 values and the count of distinct terms of each text."""
    out, sizes = np.zeros((len(texts), samples), np.int64), np.zeros(len(texts), np.int64)
    for i, _, data, off in T.chunks(texts):
        low = T.lower(data)
        starts, ends, woff = T.split(low, off, T.ALNUM)
        if not len(starts):
            continue
        doc, term, count = T.terms(T.word_hashes(low, starts, ends), woff)
        # Equal (term, count) pairs are sampled once a chunk.
        pairs, back = _pairs(term, count)
        ln_a, t = np.empty((len(pairs), samples), np.float32), np.empty((len(pairs), samples), np.int32)
        for p in range(0, len(pairs), _BLOCK):
            r, ln_c, b = draws(pairs[p : p + _BLOCK, 0].copy(), samples)
            ln_w = np.log(pairs[p : p + _BLOCK, 1].astype(np.float32))[:, None]
            step = np.floor(ln_w / r + b)
            ln_a[p : p + _BLOCK] = ln_c - r * (step - b) - r
            t[p : p + _BLOCK] = np.clip(step, 0, 2**30)
        at = np.searchsorted(doc, np.arange(len(off)))
        for d in range(len(off) - 1):
            if at[d] < at[d + 1]:
                rows = back[at[d] : at[d + 1]]
                best = rows[np.argmin(ln_a[rows], axis=0)]
                value = pairs[best, 0] ^ T.mix(t[best, np.arange(samples)].astype(np.uint64) + _G)
                out[i + d] = T.mix(value).view(np.int64)
        sizes[i : i + len(off) - 1] = np.diff(at)
    return out, sizes


def _pairs(term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((count, term))
    t, c = term[order], count[order].astype(np.uint64)
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    back = np.empty(len(t), np.int64)
    back[order] = np.cumsum(new) - 1
    return np.stack([t[new], c[new]], axis=1), back


def _run(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, sizes = signatures(b.column(1), samples)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, samples, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[sizes > 0].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), lists], names=["doc_id", "n_terms", "signature"])

    return run


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_terms, signature (samples longs, or none) of every row."""
    return rows(docs).mapInArrow(_run(samples), f"doc_id {id_type(docs)}, n_terms long, signature array<long>")


def similarity(a: Column, b: Column) -> Column:
    """The share of samples in which two signatures agree: an estimate of the generalised Jaccard similarity; null if either is empty."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), agree / F.size(a))
