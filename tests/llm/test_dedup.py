"""Near copies, fingerprints and repeated passages against brute force."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import assert_same, connect
from weftline.llm import graph, queries, simhash, substring, text as T, weighted_minhash

DOC = "doc_id long, text string"


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


MASK = (1 << 64) - 1


def plain_mix(x):
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * c) & MASK
    return x ^ x >> 33


def plain_words(text):
    return "".join(c.lower() if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) else c for c in (text or "")).translate({ord(c): " " for c in set(text or "") if unicodedata.category(c)[0] not in "LMN"}).split()


def plain_hash(word):
    base = 0x9E3779B97F4A7C15 | 1
    total = sum(plain_mix((b + 1) * 0xD6E8FEB86659FD93 & MASK) * pow(base, k, 1 << 64) for k, b in enumerate(word.encode()))
    return plain_mix((total + 0x5851F42D4C957F2D) & MASK)


def plain_fingerprint(text):
    """(bits, count of distinct words), word by word."""
    terms = {plain_hash(w) >> 20 for w in set(plain_words(text))}
    votes = [0] * 256
    for t in terms:
        bits = [plain_mix(t ^ (0xA0761D6478BD642F * (2 * i + 1) & MASK)) for i in range(4)]
        for i in range(4):
            for k in range(64):
                votes[64 * i + k] += bits[i] >> k & 1
    return sum(1 << k for k, v in enumerate(votes) if 2 * v > len(terms)), len(terms)


def brute_groups(rows, near=simhash.Near(), fingerprint=plain_fingerprint):
    """doc_id to the smallest doc_id of its group, by all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (p, n) in enumerate(prints):
        for j, (q, m) in enumerate(prints[:i]):
            if n and m and (p ^ q).bit_count() <= near.radius and min(n, m) >= near.size_ratio * max(n, m) * (1 - 1e-9):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                up[b] = a
    return {d: root(d) for d, _ in rows}


def planted(seed=3, groups=30, singles=60):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        w = words(rng, 120)
        for _ in range(rng.randrange(2, 6)):
            copy = list(w)
            for k in rng.sample(range(len(copy)), 4):
                copy[k] = "changed"
            rows.append(" ".join(copy))
    rows += [" ".join(words(rng, rng.randrange(20, 300))) for _ in range(singles)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("plan", [{}, {"leaf": 20, "block": 30, "sample": 4096}])
def test_groups_are_those_of_all_pairs(spark, plan):
    """With small leaves and blocks too, so that shards, guests and blocks are all used."""
    rows = planted()
    want = brute_groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(spark.createDataFrame(rows, DOC).repartition(3), **plan).collect()}
    assert got == want and len(set(want.values())) < len(want) - 30


def test_groups_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute_groups([tuple(r) for r in docs.collect()])
    members = {d for d, g in want.items() if sum(x == g for x in want.values()) > 1}
    got = {r["doc_id"]: r["group_id"] for r in queries.op1_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {d: want[d] for d in members}


def test_odd_rows_of_near_dedup(spark):
    long = " ".join(f"x{i % 977}" for i in range(200_000))
    rows = [(1, "same text of some words here"), (1, "same text of some words here"), (5, "Same TEXT, of some words here!"), (2, None), (3, ""), (4, " .,! "), (None, "same text of some words here"), (9, long), (8, long), (7, "alone among the others")]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], f"{DOC}, __nth string, group_id int")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, 7, 8, None]
    assert simhash.deduplicate(docs.where("false")).count() == 0 and simhash.near_dups(docs.where("false")).count() == 0


def test_repeated_ids_of_different_texts_lose_no_text(spark):
    """Each group leaves one row, wherever its ids stand in other groups too."""
    rng = random.Random(12)
    a, b, c, x, y = (" ".join(words(rng, 40)) for _ in range(5))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (7, x), (7, y), (8, y), (7, ""), (11, c), (11, c), (None, a)], DOC)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicate(docs).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (7, x), (7, y), (7, ""), (11, c), (None, a)], key=str)
    dups = sorted(tuple(r) for r in simhash.near_dups(docs).collect())
    assert dups == sorted([(3, 3, 2, True), (5, 3, 2, False), (5, 5, 2, True), (9, 5, 2, False), (7, 7, 2, True), (8, 7, 2, False), (11, 11, 2, True), (11, 11, 2, True)])


def test_components_are_those_of_a_forest(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(edges, "a long, b long")
    f = graph.Forest()
    f.unite(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = dict(zip(*(x.tolist() for x in f.edges())))
    for held in (graph.HELD, 3):
        monkeypatch.setattr(graph, "HELD", held)
        got = graph.components(df.repartition(3)).collect()
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert graph.components(df.where("false")).count() == 0


def test_no_pair_within_the_radius_is_lost():
    """All of the difference in one word of the fingerprint, or spread; trees of tiny leaves."""
    rng = np.random.default_rng(4)
    p = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    q = p.copy()
    for i in range(300):
        for bit in rng.choice(64, 48, False) if i % 2 else rng.choice(256, 48, False):
            q[i, bit // 64] ^= np.uint64(1 << (int(bit) % 64))
    both, size = np.concatenate([p, q]), np.log(np.full(600, 100))
    pairs = {(int(a), int(b)) for u, w in simhash.near_pairs(both, size, None, None, simhash.Near(), leaf=8) for a, b in zip(u, w)}
    assert pairs == {(i, i + 300) for i in range(300)}
    root = simhash.build(both, size, simhash.Near(), 1.0, 8, 10)
    met = {}
    for leaf, own, guests in simhash.visits(root, both, size, simhash.Near()):
        for x in own:
            met.setdefault(int(x), set()).update(map(int, own), map(int, guests))
    assert all(i + 300 in met[i] or i in met[i + 300] for i in range(300))


def test_ids_of_any_type(spark):
    rows = planted(5, 8, 10)
    want = {f"d{d:03d}": f"d{g:03d}" for d, g in brute_groups(rows).items()}
    docs = spark.createDataFrame([(f"d{d:03d}", t) for d, t in rows] + [(None, rows[0][1])], "doc_id string, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(docs).collect()}
    assert got == want
    assert {r["doc_id"] for r in simhash.deduplicate(docs).collect()} == {d for d, g in want.items() if d == g} | {None}
    assert {r["doc_id"] for r in weighted_minhash.fingerprint(docs).collect()} == {*want, None}
    t = " ".join(words(random.Random(3), 60))
    two = spark.createDataFrame([("a", t), ("b", "x " + t), ("b", t), ("c", "short")], "doc_id string, text string")
    assert sorted(tuple(r) for r in substring.repeated_passages(two).collect()) == [("a", 0, 60, 60), ("b", 0, 61, 61)]


def test_words_end_at_what_is_no_letter_in_any_script():
    texts = ["МИР и Ω\u00a0ÉTÉ“quoted”\u3000日本、語 x\u0301y ﬁn １２ İ", "aé—ñb…Σ", "\U0001f642ab\U00020000c", "Ⱥbc ǅ ẞ", ""]
    data, off = T.buffers(pa.array(texts))
    low = T.lower(data)
    starts, ends, woff = T.split(low, off, T.ALNUM)
    got = [[bytes(low[a:b]).decode() for a, b in zip(starts[woff[i] : woff[i + 1]], ends[woff[i] : woff[i + 1]])] for i in range(len(texts))]
    assert got == [plain_words(t) for t in texts] and got[0][:4] == ["мир", "и", "ω", "été"]
    a, b = simhash.fingerprint_batch(pa.array(["МИР «во» всём мире", "мир во всём Мире"]))[0]
    assert (a == b).all()


# ---- consistent weighted sampling ----


def test_samples_are_those_of_a_plain_version():
    """Term by term with scalars of the same kinds."""
    texts = ["a b b c", "B a, b" + " q" * 40, "z", None, " ".join(words(random.Random(7), 80, 30))]
    got, sizes = weighted_minhash.signatures(pa.array(texts, pa.string()), 24)
    f, u = np.float32, lambda x: (np.float32(x) + np.float32(0.5)) * np.float32(2.0**-32)
    g = 0x9E3779B97F4A7C15
    for i, t in enumerate(texts):
        count = {}
        for w in plain_words(t):
            h = plain_hash(w) >> 20
            count[h] = count.get(h, 0) + 1
        assert sizes[i] == len(count)
        for k in range(24) if count else []:
            best = None
            for h in sorted(count):
                x = plain_mix(plain_mix(h) + (k + 1) * g & MASK)
                r = max(-np.log(u(x >> 32) * u(x & 0xFFFFFFFF)), f(1e-7))
                y = plain_mix(x + g & MASK)
                ln_c = np.log(-np.log(u(y >> 32) * u(y & 0xFFFFFFFF) * f(1 - 1e-7)))
                b = u(plain_mix(y + g & MASK) >> 32) * f(1 - 1e-7)
                step = np.floor(np.log(f(count[h])) / r + b)
                ln_a = ln_c - r * (step - b) - r
                if best is None or ln_a < best[0]:
                    best = (ln_a, h, int(min(max(step, 0), 2**30)))
            assert int(got[i, k]) & MASK == plain_mix(best[1] ^ plain_mix(best[2] + g & MASK)), (i, k)


def jaccard(a, b):
    from collections import Counter

    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_collisions_estimate_generalised_jaccard():
    rng = random.Random(4)
    base = words(rng, 200, 60)
    pairs, estimates = [], []
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        other = base[: int(200 * share)] + words(rng, 200 - int(200 * share), 60)
        s, _ = weighted_minhash.signatures(pa.array([" ".join(base), " ".join(other)]), 2048)
        pairs.append(jaccard(base, other))
        estimates.append((s[0] == s[1]).mean())
    assert np.abs(np.array(pairs) - estimates).max() < 4 * 0.5 / 2048**0.5


def test_odd_rows_of_fingerprints(spark):
    docs = spark.createDataFrame([(1, "a b b"), (1, "B a, b"), (2, None), (3, ""), (None, "a"), (4, "a " * 100_000)], DOC).withColumn("signature", F.lit("x"))
    got = weighted_minhash.fingerprint(docs, 16).collect()
    by = {(r["doc_id"], r["n_terms"]): r["signature"] for r in got}
    assert len(got) == 6 and by[2, 0] == by[3, 0] == [] and len(by[1, 2]) == 16 and len({tuple(r["signature"]) for r in got if r["doc_id"] == 1}) == 1
    s = spark.createDataFrame([([1, 2], [1, 3]), ([], [1])], "a array<long>, b array<long>").select(weighted_minhash.similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in s] == [0.5, None] and weighted_minhash.fingerprint(docs.where("false")).count() == 0


# ---- repeated passages ----


def test_passages_match_their_sql(spark, sf_dir):
    assert assert_same(queries.op7_substring_dedup(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op7_substring_dedup"]) > 0


@pytest.mark.parametrize("bits", [6, 12, 20])
def test_a_narrow_sketch_loses_nothing(spark, bits):
    """However many cells collide, the exact pass decides."""
    rng = random.Random(bits)
    shared = [words(rng, 12, 40) for _ in range(4)]
    rows = [(i, " ".join(words(rng, 30, 40) + rng.choice(shared) + words(rng, rng.randrange(30), 40))) for i in range(40)]
    want = set()
    seen = {}
    for d, t in rows:
        w = t.split()
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), set()).add(d)
    for d, t in rows:
        w, run = t.split(), None
        for k in range(len(w) - 6):
            hit = k <= len(w) - 8 and len(seen[tuple(w[k : k + 8])]) > 1
            if hit and run is None:
                run = k
            elif not hit and run is not None:
                want.add((d, run, k - 1 + 8, k - 1 + 8 - run))
                run = None
    got = substring.repeated_passages(spark.createDataFrame(rows, DOC).repartition(3), 8, bits, 4)
    assert {tuple(r) for r in got.collect()} == want and want


def test_odd_rows_of_passages(spark):
    t = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(1, t), (1, t), (2, None), (3, ""), (None, t), (4, "short one")], DOC).withColumn("pos", F.lit(1))
    assert substring.repeated_passages(docs).count() == 0 and substring.repeated_passages(docs.where("false")).count() == 0
    two = docs.select("doc_id", "text").union(spark.createDataFrame([(9, "x\t" + t.replace(" ", "\n")), (8, "y " * 300_000)], DOC))
    assert sorted(tuple(r) for r in substring.repeated_passages(two).collect()) == [(1, 0, 60, 60), (9, 1, 61, 60)]


def test_windows_are_judged_alike_however_batches_fall():
    rng = random.Random(9)
    rows = sorted((rng.randrange(6), rng.randrange(2), rng.randrange(3), k) for k in range(80))
    docs = {}
    for a, b, d, _ in rows:
        docs.setdefault((a, b), set()).add(d)
    want = [(d, k) for a, b, d, k in rows if len(docs[a, b]) > 1]
    for size in (1, 2, 3, 7, 80):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names=["h1", "h2", "doc_id", "pos"]) for i in range(0, 80, size)]
        got = [tuple(r.values()) for out in substring._repeated(iter(batches)) for r in out.to_pylist()]
        assert got == want
    assert list(substring._repeated(iter([]))) == []
