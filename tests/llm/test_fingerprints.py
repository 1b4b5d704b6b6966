"""Canonical fingerprints against a definition in Python."""

import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from vellum.llm import fingerprints

SCHEMA = "doc_id long, text string, fingerprint string, range string"


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", t).strip()


def check(spark, rows, digest=fingerprints.wide):
    got = fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA), digest).collect()
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    classes = {}
    for d, t, *_ in rows:
        classes.setdefault(canon(t), []).append(d)
    for k, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = by[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(canon(edited) == canon(t)) and r.near_next == float(canon(after) == canon(t))
        assert (r.class_id, r.copies) == (min(classes[canon(t)]), len(classes[canon(t)]))
    return by


def rows(seed, n=120):
    rnd = random.Random(seed)
    pieces = ["Ａb", "ﬁn", "STRASSE", "straße", "é", "é", " ", "\t\n", "　", "x", "日本", "😀", "İ"]
    out = [(rnd.randrange(10**6), "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))), "", "") for _ in range(n)]
    out += [(2 * 10**6 + i, "Same  Text", "", "") for i in range(40)] + [(-5, None, "", ""), (-6, "same text", "", ""), (-7, "long " * 30_000, "", "")]
    return list({r[0]: r for r in out}.values())


def test_matches_the_definition(spark):
    for seed in (1, 2):
        by = check(spark, rows(seed))
        assert len({r.fingerprint for r in by.values()}) == len({r.class_id for r in by.values()})


def test_equal_buckets_are_told_apart_by_bytes(spark):
    check(spark, rows(3), lambda c: F.substring(fingerprints.wide(c), 1, 1))


def test_small_tables(spark):
    assert fingerprints.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(7, "abcdef", "", "")])
    got = fingerprints.fingerprints(spark.createDataFrame([(None, "b", "", ""), (1, "aaa", "", ""), (1, "aaa", "", "")], SCHEMA)).collect()
    assert len(got) == 3
