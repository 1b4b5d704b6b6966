"""Substring and SimHash deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from vellum.llm import common, near_copies, simhash, substrings

SCHEMA = "doc_id long, text string, component_id long, run string"


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß日"]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [words(n) for n in (49, 50, 51, 60, 90, 200)]
    texts = []
    for _ in range(60):
        parts = words(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 3)):
            parts += rnd.choice(passages) + words(rnd.randint(0, 30))
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    long = words(5000)
    texts += ["", None, " \t\n", "a b", texts[0], texts[0], " ".join(["x"] * 300), " ".join(["x"] * 120), " ".join(long), " ".join(long[:2500] + ["!"] + long[2500:])]
    rnd.shuffle(texts)
    return [(3 * i + 1, t, i, "x") for i, t in enumerate(texts)]


def removed_by_definition(rows, window=50):
    first = {}
    split = {d: (t or "").encode().split() for d, t, *_ in rows}
    for d, w in split.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed,hot", [(1, 10_000), (2, 3)])
def test_substrings_match_the_definition(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = corpus(seed)
    got = substrings.deduplicate(spark.createDataFrame(rows, SCHEMA), digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed_by_definition(rows)
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_join_like_others(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    big = spark.createDataFrame([(k, v) for v, k in enumerate([1, 1, 1, 2, 3, 3, 3, 4, None])], "k long, v long")
    small = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, None, 3), (7, "c", 9), (None, "d", 1)], "k long, x string, n long")
    want = sorted(map(tuple, big.join(small.drop("n"), "k", how).collect()), key=str)
    assert sorted(map(tuple, common.hot_join(big, small, "k", "n", how).collect()), key=str) == want


def test_substrings_edge_cases(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substrings.deduplicate(docs).count() == 0
    text = " ".join(str(i) for i in range(60))
    rows = [(None, text, 0, ""), (5, text, 0, ""), (5, text, 0, ""), (9, text, 0, "")]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(0, 60, 0, text), (5, 60, 0, text), (5, 60, 0, text), (9, 60, 60, "")]


def fingerprint_by_definition(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_definition(fps):
    ids = sorted(fps)
    top = {d: d for d in ids}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_simhash_matches_the_definition(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = corpus(3)
    base = next(t for _, t, *_ in rows if t and len(t.split()) > 200)
    rows += [(1000 + i, base + f" extra{i}", 0, "") for i in range(20)] + [(2000, "One TWO ÄÖ three", 0, ""), (2001, "one two ÄÖ three", 0, "")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {d: fingerprint_by_definition(t) for d, t, *_ in rows}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r.component_id for d, r in got.items()} == components_by_definition(fps)


@pytest.mark.parametrize("band", [4096, 8])
def test_links_lose_nothing(spark, band):
    rnd = random.Random(5)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(30):
            x = centre
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}
    nodes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    got = {(r.a, r.b) for r in simhash.links(nodes, band).collect()}
    assert got == want and len(want) > 100


def test_pivots_never_part_a_near_pair():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.concatenate([fps, fps ^ np.uint64(5)])
    i, j = simhash.near_pairs(fps, np.zeros(len(fps), np.int64))
    assert len(i) >= 300 and (np.bitwise_count(fps[i] ^ fps[j]) <= 2).all()


def test_components_of_a_long_path(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    n = 40
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(max(a, b), min(a, b)) for a, b in zip(order, order[1:])] + [(101, 100)]
    got = {r.a: r.b for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n)} | {101: 100}


def test_simhash_edge_cases(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(4, None, 0, ""), (2, "", 0, ""), (7, "  ", 0, ""), (None, "", 0, ""), (7, "  ", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 5 and {(r.fingerprint, r.component_id) for r in got} == {("0" * 16, 2)}
    kept = near_copies.deduplicated(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert near_copies.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [10_000, 1])
def test_null_and_repeated_ids_keep_one_row_of_each_group(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rnd = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{rnd.randrange(5000)}" for _ in range(80)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (5, c), (5, c), (5, d), (3, e), (5, e), (None, e), (8, d), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_copies.deduplicated(docs).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (5, c), (5, d), (3, e)], key=str)


def test_chains_run_through_null_ids(spark, monkeypatch):
    fps = {"one": 0b1, "two": 0b111, "three": 0b11111, "four": 0b1111111}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words=3: docs.sparkSession.createDataFrame([(r.doc_id, fps[r.text]) for r in docs.collect()], "doc_id long, fp long"))
    docs = spark.createDataFrame([(1, "one"), (None, "two"), (3, "three"), (3, "four")], "doc_id long, text string")
    got = sorted((r.fingerprint, r.component_id, r.n_links) for r in simhash.near_duplicates(docs).collect())
    assert got == [(f"{f:016x}", 1, n) for f, n in ((0b1, 1), (0b111, 2), (0b11111, 2), (0b1111111, 1))]


def near_by_definition(texts, words=5, similarity=0.8):
    """The smallest position reachable over similar pairs, for each text."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - common_
            if not union or common_ >= similarity * union - 1e-9:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("block,hot", [(512, 10_000), (4, 3)])
def test_near_copies_match_the_definition(spark, monkeypatch, block, hot):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = ["", None, " ", "a b", "A  b", "a b c d e", "a b c d e f", "\n".join(["same line of six words here"] * 50)]
    for size in (8, 30, 100, 300, 2000):
        for _ in range(4):
            base = [rnd.choice(vocabulary) for _ in range(size)]
            for _ in range(12):
                w = list(base)
                for _ in range(rnd.randint(0, max(1, size // 60))):
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
                texts.append(" ".join(w[: len(w) - rnd.randint(0, size // 30)]))
    shared = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    rnd.shuffle(texts)
    want = {i for i, r in enumerate(near_by_definition(texts)) if i == r}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id for r in near_copies.deduplicated(docs).collect()}
    assert got == want and 60 < len(want) < len(texts) - 100


def test_copies_of_copies_chain(spark):
    rnd = random.Random(10)
    w = [f"w{rnd.randrange(9000)}" for _ in range(200)]
    texts = []
    for _ in range(12):
        texts.append(" ".join(w))
        w = w[8:] + [f"w{rnd.randrange(9000)}" for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in near_copies.deduplicated(docs).collect()] == [0]
