"""Ordinal toxicity: held-out accuracy, thresholds and edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, toxic string"


def labelled(n, seed):
    rnd = random.Random(seed)
    bad = ["vilefoo", "vilebar", "grimbaz"]
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(5, 150))]
        grade = rnd.choice([0, 0, 0, 1, 2])
        for _ in range(grade * (1 + len(words) // 40)):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        docs.append((i, " ".join(words), "en", "x"))
        labels.append((i, 0 if grade == 2 else 1, int(grade > 0)))
    return docs, labels


def test_held_out_documents_are_graded(spark):
    docs, labels = labelled(1500, 1)
    df = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(df, spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    truth = {i: t for i, _, t in labels[1000:]}
    assert np.mean([got[i].toxic == bool(t) for i, t in truth.items()]) > 0.97
    severe = [got[i].expected_severity for i, q, t in labels[1000:] if t and not q]
    mild = [got[i].expected_severity for i, q, t in labels[1000:] if t and q]
    assert np.mean(severe) > np.mean(mild) and all(0 <= r.expected_severity <= 2 for r in got.values())
    left = toxicity.kept(df, model)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.toxic}


def test_edge_cases(spark):
    none = toxicity.fit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = [(1, None, None, None), (None, "", "", ""), (2, "word " * 100_000, "", ""), (2, "word " * 100_000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.score(df, none).collect()
    assert len(got) == 4 and not any(r.toxic for r in got)
    assert toxicity.score(df.limit(0), none).count() == 0
    docs, labels = labelled(300, 2)
    model = toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert toxicity.kept(df, model).filter(F.col("doc_id") == 2).count() == 2


def test_one_weight_vector_serves_both_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    grades = np.digitize(2 * x + rng.logistic(size=3000), [1.0, 3.0])
    w, theta = toxicity.fit_ordinal([([0], [v]) for v in x], grades, 1, l2=0.0)
    assert theta[1] > theta[0] and w[0] > 1.0
