"""Exact top-k against brute force."""

import math
import random

from vellum.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def by_definition(rows, k):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = []
    for q, vs in ok.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vs[0], w)), i) for i, ws in ok.items() if i != q for w in ws)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rnd = random.Random(1)
    # half-precision values are exact as floats, so both sides floor the same numbers
    vector = lambda: [rnd.randint(-300, 300) / 512 for _ in range(40)]
    rows = [(i, vector(), 0, "x") for i in range(400)]
    rows += [(400 + i, rows[i % 7][1], 0, "x") for i in range(60)]  # ties
    rows += [(600, None, 0, ""), (620, [0.5, None], 0, ""), (640, [float("nan")] * 40, 0, ""), (641, [float("inf")] * 40, 0, ""), (None, vector(), 0, ""), (660, [], 0, ""), (661, [0.5], 0, ""), (3, rows[3][1], 1, "again")]
    df = spark.createDataFrame(rows, SCHEMA)
    for block, k in ((4096, 20), (37, 5)):
        got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), k, block=block).collect())
        assert got == by_definition(rows, k)


def test_few_or_no_candidates(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, empty).count() == 0
    two = spark.createDataFrame([(20, [1.0], 0, ""), (21, [-1.0], 0, "")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(two, two.filter("vec_id = 20")).collect()] == [(20, 1, 21, -4096)]
    assert topk.top_k(two, two.filter("vec_id = 5")).count() == 0
