"""SentencePiece encoding and decoding by a forward pass shared along a trie.

Text is cut before every run of spaces; with spaces marked, each cut is a marked
word, and no piece of the vocabulary reaches over such a cut.  The distinct
marked words of a batch are sorted, which is the depth-first order of their
trie, and the forward table of a prefix is kept for all words that share it.

The public model is of the BPE kind: its pieces are the result of merges and not
the best-scoring path.  So the forward table holds, for each prefix, the one
last piece of that prefix's own segmentation in place of the best score: a piece
may follow another if merging would leave just these two apart.  That is a
forward pass of Viterbi's form with a yes/no score, and gives the library's ids
exactly.  The pieces that end at a prefix are read off an automaton (Aho and
Corasick's), so that the work of a character doesn't depend on the longest piece.
For models of the unigram kind the table holds the best sum of scores.

A run of spaces before a word takes no place in the trie: where pieces of marks alone
are merged last and from the left, as in the public model, the run is cut into the
longest such pieces and a rest that is looked up, whatever its length.

Results for odd input: null and empty texts give no ids; characters outside the
vocabulary become byte pieces (the unknown piece if the model has none);
decoding ids gives back the text, with U+2581 read as a space.
"""

from __future__ import annotations

import ctypes
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .rows import id_type, rows

MARK = "▁"
#: Bytes of text whose distinct words share one trie.
TRIE_BYTES = 8 << 20
#: Rows whose texts are encoded at a time, if they are shorter than TRIE_BYTES.
ROWS = 1500
#: Words that are Python strings at a time.
WORDS = 50_000
#: Characters up to which prefixes are shared and their ids kept whole; beyond, a word is followed back from its end.
PREFIX = 32
#: Ids decoded at a time, and remembered pairs of pieces, and steps of the automaton: bounds on memory alone.
DECODE_IDS = 200_000
MAX_PAIRS = 200_000
#: Values copied at a time: their places take several times the room of the values.
GATHER = 100_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Pieces with scores; kind: "bpe" or "unigram"; bytes_from: the id of byte piece 0, or None."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, bytes_from: int | None, unknown: int = 0, special: Iterable[int] = ()) -> None:
        self.pieces, self.kind, self.bytes_from, self.unknown = pieces, kind, bytes_from, unknown
        apart = {unknown, *special, *(range(bytes_from, bytes_from + 256) if bytes_from is not None else ())}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in apart}
        self.scores = scores
        self.longest, self.length = max(map(len, self.ids), default=1), list(map(len, pieces))
        self.raw = [bytes([i - bytes_from]) if bytes_from is not None and bytes_from <= i < bytes_from + 256 else b"" if i in special else b" \xe2\x81\x87 " if i == unknown else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        # Decoding needs none of what merging and the automaton know, so that waits for the first word.
        self.go: list[dict[str, int]] = []
        self.runs = self._runs() if kind == "bpe" else None

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = [i for i in range(n) if m.is_control(i)]
        first = next((i for i in range(n) if m.is_byte(i)), None)
        # BPE scores are whole numbers (negative ranks), unigram scores logarithms.
        kind = "bpe" if all(float(m.get_score(i)).is_integer() for i in range(n)) else "unigram"
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], kind, first, m.unk_id(), special)

    def merge(self, word: str, without: int = -1) -> list[int]:
        """The ids by merging, best score first and leftmost among equals; -1 - code for a character without a piece. without: a piece left out."""
        ids, scores, n = self.ids, self.scores, len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []  # (-score, start, end) of pairs of neighbours that make a piece

        def pair(k: int) -> tuple[float, int, int] | None:
            if k < 0 or after[k] >= n:
                return None
            stop = end[after[k]]
            i = ids.get(word[k:stop])
            return None if i is None or i == without else (-scores[i], k, stop)

        heap = [p for p in map(pair, range(n)) if p]
        heapify(heap)
        while heap:
            _, k, stop = heappop(heap)
            # A pair whose parts were merged otherwise since then is gone.
            if end[k] < 0 or (right := after[k]) >= n or end[right] != stop:
                continue
            end[k], after[k], end[right] = stop, after[right], -1
            if after[k] < n:
                before[after[k]] = k
            for p in (pair(before[k]), pair(k)):
                if p:
                    heappush(heap, p)
        out, k = [], 0
        while k < n:
            out.append(ids.get(word[k : end[k]], -1 - ord(word[k])))
            k = after[k]
        return out

    def _runs(self) -> list[list[int]] | None:
        """The ids of 0, 1, ... marks up to the longest piece of marks, whose own ids are one; None if runs of marks aren't merged last, and from the left."""
        marks = {len(p): i for p, i in self.ids.items() if set(p) == {MARK}}
        longest = max(marks, default=0)
        if not longest or any(p[:2] == MARK * 2 and len(p) not in marks for p in self.ids):
            return None
        long = [self.scores[i] for n, i in marks.items() if n > 1]
        others = min((self.scores[i] for p, i in self.ids.items() if len(p) > 1 and p[:2] != MARK * 2), default=0.0)
        if long and (min(long) != max(long) or max(long) >= others) or self.merge(MARK * longest) != [marks[longest]]:
            return None
        return [self.merge(MARK * n) for n in range(longest + 1)]

    def _after_marks(self, word: str) -> list[int]:
        """The ids of a word that begins with two marks or more."""
        if self.runs is None:
            return [i for x in self.merge(word) for i in ([x] if x >= 0 else self._bytes(chr(-1 - x)))]
        base = word.lstrip(MARK)
        ids, n, longest = list(self._bpe([MARK + base])[0]) if base else [], len(word) - len(base), len(self.runs) - 1
        # The last mark is part of the word's first piece, or stands alone and then belongs to the run.
        if ids and ids[0] == self.ids.get(MARK):
            ids = ids[1:]
        elif ids:
            n -= 1
        return self.runs[longest] * (n // longest) + self.runs[n % longest] + ids

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b apart when they stand together."""
        rank, parts, made = self.rank, self.parts, self.made
        limit = 1 << 60
        while True:
            whole = made.get((a, b))
            if whole is not None and rank[whole] < limit:
                return False
            ra, rb = rank[a], rank[b]
            first = ra > rb
            for left in (first, not first):
                if left and a in parts:
                    limit, a = ra, parts[a][1]
                    break
                if not left and b in parts:
                    limit, b = rb + 1, parts[b][0]
                    break
            else:
                return True

    def encode_sorted(self, words: Iterable[str]) -> tuple[array, array]:
        """Ids of distinct marked words in sorted order, one after the other, and how many each has."""
        return self._bpe(words) if self.kind == "bpe" else self._unigram(words)

    def _bytes(self, char: str) -> list[int]:
        return [self.unknown] if self.bytes_from is None else [self.bytes_from + b for b in char.encode("utf-8", "surrogatepass")]

    def _merges(self) -> None:
        """Ranks by order of merging, single characters first; the two parts of each piece that merging makes, and the piece of two parts."""
        pieces, scores = self.pieces, self.scores
        order = sorted(self.ids.values(), key=lambda i: (len(pieces[i]) > 1, -scores[i], i))
        self.rank = {i: k for k, i in enumerate(order)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for i in order:
            if len(p := pieces[i]) > 1 and set(p) != {MARK} and len(last := self.merge(p, i)) == 2:
                self.parts[i] = (last[0], last[1])
                self.made[last[0], last[1]] = i

    def _automaton(self) -> None:
        """The states of Aho and Corasick over the pieces that merging makes: a state is the longest suffix of the text that begins a piece.

        go: the next state by character; ends: the pieces that are suffixes of the text, longest
        first, each with minus its length and the pieces known to be left apart before it, or not.
        """
        self.go = [{}]
        own: list[tuple[int, int, dict[int, bool]] | None] = [None]
        for p, i in self.ids.items():
            if len(p) == 1 or i in self.parts:
                s = 0
                for c in p:
                    if (t := self.go[s].get(c)) is None:
                        t = self.go[s][c] = len(self.go)
                        self.go.append({})
                        own.append(None)
                    s = t
                own[s] = (i, -len(p), {-1: True})
        self.fail = [0] * len(self.go)
        self.ends: list[tuple[tuple[int, int, dict[int, bool]], ...]] = [()] * len(self.go)
        level = [0]
        while level:
            below = [(s, c, t) for s in level for c, t in self.go[s].items()]
            for s, c, t in below:
                f = self.fail[s]
                while f and c not in self.go[f]:
                    f = self.fail[f]
                self.fail[t] = self.go[f].get(c, 0) if s else 0
                self.ends[t] = (own[t], *self.ends[self.fail[t]]) if own[t] else self.ends[self.fail[t]]
            level = [t for _, _, t in below]
        self.known = {x[0]: x[2] for x in own if x}
        #: What was learned: pairs of pieces (the later one first), and steps that leave the trie (state, character), as two numbers in one; both are forgotten at MAX_PAIRS.
        self.pairs, self.steps = array("q"), array("q")

    def _step(self, state: int, char: str) -> int:
        """The state after a character that doesn't continue the state's text in the trie."""
        if len(self.steps) >= MAX_PAIRS:
            for x in self.steps:
                del self.go[x >> 32][chr(x & 0xFFFFFFFF)]
            del self.steps[:]
        f = state
        while f and char not in self.go[f]:
            f = self.fail[f]
        self.go[state][char] = to = self.go[f].get(char, 0)
        self.steps.append(state << 32 | ord(char))
        return to

    def _follows(self, a: int, b: int) -> bool:
        """apart(a, b), kept in known."""
        if len(self.pairs) >= MAX_PAIRS:
            for x in self.pairs:
                del self.known[x >> 32][x & 0xFFFFFFFF]
            del self.pairs[:]
        ok = self.known[b][a] = self.apart(a, b)
        self.pairs.append(b << 32 | a)
        return ok

    def _bpe(self, words: Iterable[str]) -> tuple[array, array]:
        if not self.go:
            self._merges()
            self._automaton()
        go, ends, length = self.go, self.ends, self.length
        # Of each prefix: its last piece, or -1 for a character without one (and for no text); its state; its ids, up to PREFIX characters.
        last, states, paths = [-1], [0], [()]
        out, sizes = array("i"), array("i")
        for w, k in (x for some in batched(words, WORDS) for x in zip(some, shared(some))):
            if w[:2] == MARK * 2:
                back = self._after_marks(w)
                out.extend(back)
                sizes.append(len(back))
                del last[1:], states[1:], paths[1:]
                continue
            if len(last) <= k:  # after a run of marks
                k = 0
            del last[k + 1 :], states[k + 1 :], paths[k + 1 :]
            s = states[k]
            for c in w[k:]:
                t = go[s].get(c)
                s = self._step(s, c) if t is None else t
                states.append(s)
                for i, start, known in ends[s]:
                    ok = known.get(last[start])
                    if ok is None:
                        ok = self._follows(last[start], i)
                    if ok:
                        if len(last) <= PREFIX:
                            paths.append(paths[start] + (i,))
                        last.append(i)
                        break
                else:
                    if (end := len(last)) <= PREFIX:
                        paths.append((*paths[-1], *self._bytes(w[end - 1])))
                    last.append(-1)
            if len(w) <= PREFIX:
                out.extend(paths[-1])
                sizes.append(len(paths[-1]))
                continue
            back, end = [], len(w)
            while end > PREFIX:
                i = last[end]
                if i < 0:
                    back += reversed(self._bytes(w[end - 1]))
                    end -= 1
                else:
                    back.append(i)
                    end -= length[i]
            back += reversed(paths[end])
            back.reverse()
            out.fromlist(back)
            sizes.append(len(back))
        return out, sizes

    def _unigram(self, words: Iterable[str]) -> tuple[array, array]:
        """Best sums of scores; of equal sums the one whose last piece is longest."""
        ids, scores, longest = self.ids, self.scores, self.longest
        unknown = min(scores, default=0.0) - 10
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        before, out, sizes = "", array("i"), array("i")
        for w in words:
            n, k = min(len(w), len(before)), 0
            while k < n and w[k] == before[k]:
                k += 1
            del best[k + 1 :]
            before = w
            for end in range(k + 1, len(w) + 1):
                top = None
                for start in range(max(0, end - longest), end):
                    i = ids.get(w[start:end])
                    if i is not None and (top is None or best[start][0] + scores[i] > top[0]):
                        top = (best[start][0] + scores[i], start, i)
                if w[end - 1] not in ids and (top is None or best[end - 1][0] + unknown > top[0]):
                    top = (best[end - 1][0] + unknown, end - 1, -1)
                best.append(top)
            back, end = [], len(w)
            while end:
                _, start, i = best[end]
                back += [i] if i >= 0 else reversed(self._bytes(w[start:end]))
                end = start
            back.reverse()
            out.extend(back)
            sizes.append(len(back))
        return out, sizes

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """n + 1 offsets, and the ids of all texts."""
        counts, parts = [np.zeros(1, np.int64)], []
        for _, _, data, off in T.chunks(texts, TRIE_BYTES):
            if MARK.encode() in memoryview(data).tobytes():
                whole = [bytes(data[a:b]).decode("utf-8", "replace").replace(MARK, " ") for a, b in zip(off[:-1], off[1:])]
                data, off = T.buffers(pa.array(whole, pa.large_string()))
                data, off = data[off[0] : off[-1]], off - off[0]
            there = np.flatnonzero(np.diff(off))
            data = np.insert(data, off[there], 32)
            off = off + np.searchsorted(there, np.arange(len(off)), "left")
            space = data == 32
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            cut[off[there]] = True
            starts = np.flatnonzero(cut)
            if not len(starts):
                counts.append(np.zeros(len(off) - 1, np.int64))
                continue
            bounds = np.append(starts, len(data))
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
            coded = words.dictionary_encode()
            distinct = coded.dictionary
            order = pc.sort_indices(distinct).to_numpy()
            # Words that have one space at their start go first: joined, they are split at it.
            runs = pc.starts_with(distinct, "  ").to_numpy(zero_copy_only=False)[order]
            order = np.concatenate([order[~runs], order[runs]])
            ids, sizes = self.encode_sorted(w for k in range(0, len(order), WORDS) for w in marked(distinct.take(pa.array(order[k : k + WORDS]))))
            flat, size = np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32), np.frombuffer(sizes, np.int32).astype(np.int64)
            length, begin = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            length[order], begin[order] = size, np.cumsum(size) - size
            index = coded.indices.to_numpy()
            parts.append(gather(flat, begin[index], length[index]))
            ends = np.concatenate([[0], np.cumsum(length[index])])
            counts.append(np.diff(ends[np.searchsorted(starts, off)]))
        return np.cumsum(np.concatenate(counts)), np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode_batch(self, off: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of n lists of ids given by n + 1 offsets; bytes that aren't UTF-8 become U+FFFD."""
        table = b"".join(self.raw)
        length = np.array([len(r) for r in self.raw], np.int64)
        data = gather(np.frombuffer(table, np.uint8), (np.cumsum(length) - length)[ids], length[ids])
        ends = np.concatenate([[0], np.cumsum(length[ids])])[off]
        starts = ends[:-1].copy()
        filled = np.flatnonzero(ends[1:] > starts)
        keep = np.ones(len(data), bool)
        keep[starts[filled][data[starts[filled]] == 32]] = False
        size = np.concatenate([[0], np.cumsum(keep)])
        data, ends = data[keep], size[ends]
        try:
            memoryview(data).tobytes().decode()
            out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(ends), pa.py_buffer(data))
            return out.cast(pa.string())
        except UnicodeDecodeError:
            return pa.array([bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())


def shared(words: Sequence[str]) -> list[int]:
    """The characters, up to PREFIX, that each word begins with as the one before it does."""
    if len(words) < 2:
        return [0] * len(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer(("".join(words) + "\0" * PREFIX).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.lib.stride_tricks.sliding_window_view(points, PREFIX)[np.cumsum(size) - size]
    other = first[1:] != first[:-1]
    same = np.where(other.any(1), other.argmax(1), PREFIX)
    return [0, *np.minimum(same, np.minimum(size[1:], size[:-1])).tolist()]


def marked(words: pa.Array) -> list[str]:
    """Words that begin with spaces, with marks in their place; those of one space before those of more."""
    one = len(words) - pc.sum(pc.starts_with(words, "  ")).as_py()
    data, off = T.buffers(words)
    text = bytes(data[off[0] : off[one]]).decode()
    return text.replace(" ", " " + MARK).split(" ")[1:] + [w.replace(" ", MARK) for w in words.slice(one).to_pylist()]


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[begin : begin + length] of all rows, one after the other."""
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    i = 0
    while i < len(ends):
        at = int(ends[i] - length[i])
        j = max(i + 1, int(np.searchsorted(ends, at + GATHER, "right")))
        size, end = length[i:j], int(ends[j - 1])
        out[at:end] = flat[np.repeat(begin[i:j] - (ends[i:j] - size), size) + np.arange(at, end)]
        i = j
    return out


def give_back() -> None:
    """Unused memory of Arrow, and of the C library where it is glibc, goes back to the system: idle workers count too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec.load(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Memory that an earlier stage, batch or task left unused goes back.
        give_back()
        c = codec(path)
        for b in batches:
            pa.default_memory_pool().release_unused()
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                off, ids = c.encode_batch(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(off), pa.int64())], names=["doc_id", "ids", "n_tokens"])
                del part, off, ids, lists
        give_back()

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens of every row."""
    return rows(docs).mapInArrow(_encode(model or default_model()), f"doc_id {id_type(docs)}, ids array<int>, n_tokens long")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            lists = b.column(1)
            off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + DECODE_IDS, "right")) - 1)
                part = b.slice(i, j - i)
                texts = c.decode_batch(off[i : j + 1] - off[i], ids[off[i] : off[j]])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "ids", "n_tokens", "text"])
                i = j

    return run


def decode(coded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, text of every row of encode()'s kind."""
    return coded.select("doc_id", "ids", "n_tokens").mapInArrow(_decode(model or default_model()), f"doc_id {id_type(coded)}, ids array<int>, n_tokens long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """decode(encode(docs)) in one pass: the ids of a batch are decoded where they were made, and leave Python once."""
    encoded, decoded = _encode(path := model or default_model()), _decode(path)
    return rows(docs).mapInArrow(lambda batches: decoded(encoded(batches)), f"doc_id {id_type(docs)}, ids array<int>, n_tokens long, text string")
