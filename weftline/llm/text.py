"""Vectorised word kernel over Arrow string buffers.

Texts are handled as UTF-8 bytes: words are byte runs between separators and
are hashed with a positional polynomial (one cumulative sum per chunk), so no
Python string is made per word.  A null text counts as an empty one.  Lower case
is Unicode's simple one where it takes as many bytes (all of Latin-1, Greek and
Cyrillic), and words of letters end at what is no letter, mark or number in
Unicode; what lies beyond the first two planes counts as a letter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that belong to a word when words end at ASCII white space.
NON_SPACE = ~SPACE
#: Bytes that belong to a word when words are letters and digits; beyond ASCII the character decides.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LETTERS = ALNUM.copy()
LETTERS[48:58] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (changes x itself)."""
    x ^= x >> _S33
    x *= _C1
    x ^= x >> _S33
    x *= _C2
    x ^= x >> _S33
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of the characters of the first two planes: which belong to words, and their lower case."""
    word, low = np.zeros(1 << 17, bool), np.arange(1 << 17, dtype=np.uint32)
    size = lambda c: (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    for c in range(128, 1 << 17):
        x = chr(c)
        word[c] = unicodedata.category(x)[0] in "LMN"
        y = x.lower()
        if len(y) == 1 and size(ord(y)) == size(c):
            low[c] = ord(y)
    return word, low


def _beyond_ascii(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths in bytes and codes of the characters beyond ASCII."""
    at = np.flatnonzero(data >= 0xC0)
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32) if len(at) else data
    lead = data[at]
    size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    if not len(at):
        return at, size, np.zeros(0, np.uint32)
    tail = [b[at + k] & 0x3F for k in (1, 2, 3)]
    two, three = (b[at] & 0x1F) << 6 | tail[0], (b[at] & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (b[at] & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    return at, size, np.where(size == 2, two, np.where(size == 3, three, four))


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of UTF-8 bytes; the length stays."""
    out = _LOWER[data]
    at, size, code = _beyond_ascii(data)
    if len(at):
        _, table = _characters()
        low = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], code)
        changed = np.flatnonzero(low != code)
        at, size, low = at[changed], size[changed], low[changed]
        for n, first in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
            mine = size == n
            p, c = at[mine], low[mine]
            out[p] = first | c >> (6 * (n - 1))
            for k in range(1, n):
                out[p + k] = 0x80 | (c >> (6 * (n - 1 - k)) & 0x3F)
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about limit bytes; a longer text is a run of its own."""
    data, off = buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def split(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's range among them; inside: which bytes are of words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = inside[data]
    if not inside[33]:
        # Words of letters: characters beyond ASCII that are none end them.
        at, size, code = _beyond_ascii(data)
        if len(at):
            table, _ = _characters()
            no = np.flatnonzero((code < len(table)) & ~table[np.minimum(code, len(table) - 1)])
            for k in range(4):
                word[at[no][size[no] > k] + k] = False
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    end[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    power, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * power, out=sums[1:])
    return sums


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; they depend on the bytes alone."""
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + np.uint64(0x5851F42D4C957F2D))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(prefix_sums(data), starts, ends)


def windows(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of width consecutive values: len(hashes) - width + 1 of them, those across texts too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(hashes) + 1)
    values = mix(hashes ^ np.uint64(salt)) if salt else hashes
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * inverse[:n] + np.uint64(salt ^ 0x2545F4914F6CDD1D))


def doc_of(woff: np.ndarray) -> np.ndarray:
    """The text's number of each word."""
    return np.repeat(np.arange(len(woff) - 1), np.diff(woff))


def terms(hashes: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: text number, 44-bit word value, count; ordered by text."""
    key = (doc_of(woff).astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), count
