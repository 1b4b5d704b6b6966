"""Mixing: targets against the definition, sums, bounds, expectation and reruns."""

import random
import re

import pytest

from vellum.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        rate = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * rate > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else weight[s] * rate for s in names}
        capped |= above


def documents(seed, n):
    rnd = random.Random(seed)
    names = ["b", "a", "Z", "é", "tiny", None, "hot", "none"]
    rows = [(i, " ".join(["w"] * rnd.choice([1, 5, 60, 300])), rnd.choices(names, [5, 5, 5, 5, 0.3, 3, 30, 0])[0], "x") for i in range(n)]
    return rows + [(n, None, "a", ""), (n + 1, " \t", "none", ""), (5, "w w", "a", ""), (5, "w w", "a", ""), (None, "w w w", "b", "")]


@pytest.mark.parametrize("bucket", [2000, 40])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = documents(1, 1500)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    source = {(d, size(t)): s for d, t, s, _ in rows}
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 300, s  # one document, the last residual, is rounded by itself
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_pivot_keeps_mass_and_expectation():
    rng = random.Random(3)
    units = [(str(i), rng.choice([1.0, 7.0, 50.0]), rng.random()) for i in range(60)]
    mass = sum(b * p for _, b, p in units)
    hits = {k: 0 for k, *_ in units}
    for seed in range(1500):
        settled, left = mixing.pivot(units, seed)
        assert len(settled) + (left is not None) == len(units)
        up = sum(b for k, b, _ in units if dict(settled).get(k))
        assert abs(up + (left[1] * left[2] if left else 0) - mass) < 1e-6
        for k, x in settled:
            hits[k] += x
        if left:
            hits[left[0]] += left[2]
    assert all(abs(hits[k] / 1500 - p) < 0.06 for k, _, p in units)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, "")], SCHEMA)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)]


def test_large_documents_leave_a_small_residual(spark):
    rnd = random.Random(9)
    rows = [(i, "w " * (20_000 if i == 7 else rnd.choice([900, 900, 300, 40, 40, 7, 7, 2])), f"s{i % 5}", "") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.02 * mine[0].target, s


def test_versions_of_one_length_are_taken_each(spark):
    kind = "doc_id long, text string, source string, h1 string, _size int"
    rows = [(1, "a b c", "s", "", 0), (1, "x y z", "s", "", 0), (1, "x y z", "s", "", 1), (None, "k l m", "s", "", 0), (None, "k l m", "s", "", 0), (2, None, "s", "", 0), (2, None, "s", "", 0)]
    df = spark.createDataFrame(rows, kind)
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, df.collect()))  # one source takes all its words once


def test_a_row_that_repeats_very_often(spark):
    rows = [(5, "w w", "a", "")] * 3000 + [(None, None, None, "")] * 3000 + [(i, "w", "b", "") for i in range(10, 90)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) <= 6080
    assert {r.copies for r in got if r.doc_id == 5} == {0, 1} or {r.copies for r in got if r.doc_id == 5} == {1}
    assert sum(r.source is None and r.text is None for r in mixing.mixed(df).collect()) == 3000
