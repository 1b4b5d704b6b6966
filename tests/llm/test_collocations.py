import re
from collections import Counter

import numpy as np
import pytest
from vellum.llm.collocations import collocations, phrase_counts

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, longest):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f[lang or "und", ()] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    return f


def brute(rows, least, longest=5, top=2000, share=100):
    f = brute_counts(rows, longest)
    kept = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        n = f[lang, ()]
        score, k = min((1000 * a * n // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(q != p and len(q) > len(p) and b >= least and g == lang and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in f.items())
        if not inside:
            kept.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n))
    out, rank = [], Counter()
    for lang, score, a, p, left, right, n in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n, -score))
    return out


def rows_of(seed, n=80):
    rng = np.random.default_rng(seed)
    words = ["of", "the", "New", "york", "city", "é", "a.b", "x\ty", "ß", "in spite of"]
    join = [" ", " ", " ", ", ", "\n", "  "]
    p = np.array([8, 8, 3, 3, 3, 1, 1, 1, 1, 3], float)
    return [(["en", "de", None][i % 3], "".join(w + join[rng.integers(len(join))] for w in rng.choice(words, rng.integers(0, 60), p=p / p.sum()))) for i in range(n)]


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    return sorted(tuple(r) for r in collocations(df, **kw).collect())


@pytest.mark.parametrize("seed,least,share", [(0, 5, 100), (1, 12, 100), (2, 5, 60)])
def test_equals_the_definition(spark, seed, least, share):
    rows = rows_of(seed)
    assert result(spark, rows, least=least, share=share) == sorted(brute(rows, least, share=share))


def test_a_crowded_sketch_loses_nothing(spark):
    # 2^10 cells for thousands of phrases: most seem frequent, and the exact pass drops them
    rng = np.random.default_rng(9)
    rows = [("en", " ".join(rng.choice([f"w{i}" for i in range(60)], 150))) for _ in range(40)] + rows_of(3)
    assert result(spark, rows, least=6, bits=10) == sorted(brute(rows, 6))
    small = {(r["lang"], r["phrase"]): r["f"] for r in phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 6, 5, 10).collect()}
    f = brute_counts(rows, 5)
    frequent = {(g, p) for (g, p), n in f.items() if n >= 6 and len(p) > 1}
    assert {k: n for k, n in small.items() if " " in k[1] or not k[1]} == {(g, " ".join(p)): f[g, p] for g, p in frequent | {k for k in f if not k[1]}}
    words = {(g, w) for g, p in frequent for w in p}
    assert all(small[g, w] == f[g, (w,)] for g, w in words)


def test_top_and_ties(spark):
    rows = [("en", "b c. a b. c a.")] * 10
    got = result(spark, rows, least=10, top=2)
    assert [r[:4] for r in got] == [("en", 1, "a b", 10), ("en", 2, "b c", 10)]


def test_nulls_empty_and_clashing_names(spark):
    rows = [(None, "a b", 1, "x"), ("und", "a b", 2, "y"), ("en", None, 3, "z"), ("en", "", 4, None)]
    df = spark.createDataFrame(rows, "lang string, text string, n long, phrase string")
    assert [tuple(r) for r in collocations(df, least=2).collect()] == [("und", 1, "a b", 2, 2, 2, 4, 2000)]
    assert collocations(df.limit(0)).collect() == []


def test_a_very_long_text_and_repeated_rows(spark, monkeypatch):
    from vellum.llm import collocations as module

    monkeypatch.setattr(module, "CHUNK", 1000)
    rows = [("en", "so it goes " * 30_000), ("en", "so it goes")] + [("en", "so it goes")] * 5
    assert result(spark, rows, least=6) == sorted(brute([(g, t) for g, t in rows], 6))


def test_counts_beyond_64_bits_divide_exactly(spark):
    from vellum.llm.collocations import scored

    a, left, right, n = 9_999_999_999_999, 99_999_999_999_999, 99_999_999_999_989, 999_999_999_999_999_999
    counts = spark.createDataFrame([("en", "p q", a), ("en", "p", left), ("en", "q", right), ("en", "", n)], "lang string, phrase string, f long")
    assert scored(counts).first()["score"] == 1000 * a * n // (left * right)


def test_impossible_parameters_are_refused(spark):
    with pytest.raises(ValueError):
        collocations(spark.createDataFrame([], "lang string, text string"), longest=1)
