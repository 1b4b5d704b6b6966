"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 toxic and of poor quality. One weight vector serves all
thresholds: P(grade > k) = logistic(w.x - theta_k) with theta_0 < theta_1, and the expected severity is the
sum of these probabilities. Features are lower-cased words and their first four, five and six letters;
a feature's value is the logarithm of its density in the text over the norm of all word densities.

Fitting takes at most CLEAN clean and TOXIC toxic labelled documents, those first by a hash of the id. Spark
counts in how many of them each feature occurs; only features whose shares differ by Z standard errors
stay, scaled by their log odds. The few values that are left are fitted on the driver. A fifth of the
sample is held out to set the probability from which a document is rejected. Every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import written

#: Bounds of the sample, least documents of a feature, least standard errors, most features.
CLEAN, TOXIC, LEAST, Z, FEATURES = 6000, 3000, 5, 4.0, 4096
WORDS = re.compile(r"\w+")


def keys(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)] if len(word) >= 4 else [word]


def counted(text: str | None) -> tuple[Counter, float, float]:
    """Words with their counts, the length that densities refer to, the norm of the word densities."""
    words = Counter(WORDS.findall((text or "").lower()))
    length = max(sum(words.values()), 60)
    density = np.log1p(300.0 / length * np.fromiter(words.values(), float, len(words)))
    return words, length, float(np.sqrt((density * density).sum())) or 1.0


class Active(dict):
    """Word to the positions of its features in the model; bounded by starting anew."""

    def __init__(self, names: list[str]):
        super().__init__()
        self.at = {n: i for i, n in enumerate(names)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = tuple(self.at[k] for k in keys(word) if k in self.at)
        return found

    def values_of(self, text: str | None) -> tuple[list[int], list[float]]:
        words, length, norm = counted(text)
        totals: dict[int, int] = {}
        for word, n in words.items():
            for i in self[word]:
                totals[i] = totals.get(i, 0) + n
        return list(totals), [float(np.log1p(300.0 * n / length) / norm) for n in totals.values()]


@dataclass
class Model:
    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([8.0, 16.0]))
    reject_from: float = 0.5

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, one row per score."""
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(rows: list[tuple[list[int], list[float]]], grades: np.ndarray, dims: int, l2: float = 1e-3, rate: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that minimise the class-balanced negative log likelihood, by gradient descent with momentum."""
    n, top = len(rows), int(grades.max(initial=1))
    at = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    idx = np.array([j for i, _ in rows for j in i], np.int64)
    val = np.array([x for _, v in rows for x in v], float)
    share = np.maximum(np.bincount(np.minimum(grades, 1), minlength=2), 1)
    cost = n / (2.0 * share[np.minimum(grades, 1)]) / n
    w, theta = np.zeros(dims), 2.0 + np.arange(top, dtype=float)
    move_w, move_t = np.zeros(dims), np.zeros(top)
    levels = np.arange(top)
    for _ in range(rounds):
        s = np.bincount(at, val * w[idx], minlength=n)
        low = 1.0 / (1.0 + np.exp(-np.clip(theta[None, :] - s[:, None], -40, 40)))  # P(grade <= k)
        slope = low * (1 - low)
        here, before = grades[:, None] == levels, grades[:, None] == levels + 1  # the thresholds above and below
        p = np.where(grades == top, 1.0, (low * here).sum(axis=1)) - (low * before).sum(axis=1)
        pull = cost / np.maximum(p, 1e-9)
        g_s = pull * ((slope * here).sum(axis=1) - (slope * before).sum(axis=1))
        g_t = -(pull[:, None] * slope * (here.astype(float) - before)).sum(axis=0)
        move_w = 0.9 * move_w + np.bincount(idx, val * g_s[at], minlength=dims) + l2 * w
        move_t = 0.9 * move_t + g_t
        w -= rate * move_w
        theta -= 0.2 * rate * move_t
        theta = np.maximum.accumulate(theta + 1e-6 * levels)
    return w, theta


def fit(docs: DataFrame, labels: DataFrame, clean: int = CLEAN, toxic: int = TOXIC) -> Model:
    """The model of the labelled documents; labels: (doc_id, quality, toxic). Without both classes nothing is rejected."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    known = known.select("doc_id", F.when(F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1)).otherwise(0).alias("grade"))
    first = [F.xxhash64(F.lit(5), "doc_id"), F.col("doc_id")]
    picked = known.filter("grade = 0").orderBy(*first).limit(clean).union(known.filter("grade > 0").orderBy(*first).limit(toxic))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id"))
    sample = written(sample.select("doc_id", "text", "grade"), "labelled")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, grade in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[grade > 0].update({k for w in counted(text)[0] for k in keys(w)})
            every = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([s[k] for k in every], pa.int64()) for s in seen)], ["feature", "clean", "toxic"])

    sizes = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("grade") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(True) and sizes.get(False)):
        return Model()
    n1, n0 = sizes[True], sizes[False]
    counts = sample.select("text", "grade").mapInArrow(occurrences, "feature string, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).filter(F.col("c") + F.col("t") >= LEAST)
    gap = (F.col("t") / n1 - F.col("c") / n0) / F.sqrt((F.col("t") + F.col("c") + 1) / (n0 + n1) * (1 / n1 + 1 / n0))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    chosen = counts.select("feature", gap.alias("z"), odds.alias("odds")).filter(F.abs("z") >= Z).orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect()
    names, odds_of = [r["feature"] for r in chosen], np.array([r["odds"] for r in chosen])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = Active(names)
        for b in batches:
            found = [active.values_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["doc_id", "grade", "i", "x"])

    rows = sorted(sample.mapInArrow(values, "doc_id long, grade int, i array<int>, x array<double>").collect(), key=lambda r: (r["doc_id"], r["grade"]))
    data = [(r["i"], [x * odds_of[i] for i, x in zip(r["i"], r["x"], strict=True)]) for r in rows]
    grades = np.array([r["grade"] for r in rows])
    held = np.array([xxhash.xxh64_intdigest(str(r["doc_id"]), 9) % 5 == 0 for r in rows])
    model = Model(names)
    if held.any() and (grades[held] > 0).any() and (grades[~held] > 0).any():
        w, theta = fit_ordinal([d for d, h in zip(data, held, strict=True) if not h], grades[~held], len(names))
        p = Model(names, w, theta).above(np.array([sum(w[j] * x for j, x in zip(*d, strict=True)) for d, h in zip(data, held, strict=True) if h]))[:, 0]
        truth = grades[held] > 0
        tries = np.linspace(0.2, 0.9, 71)
        # the balanced error, a clean document lost counting three times
        loss = [(p[truth] < t).mean() + 3 * (p[~truth] >= t).mean() for t in tries]
        model.reject_from = float(np.median(tries[np.flatnonzero(np.isclose(loss, min(loss)))]))
    w, model.thresholds = fit_ordinal(data, grades, len(names))
    model.weights = w * odds_of
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, toxic) of every document; a null text counts as empty.

    grade is the likeliest one; toxic: p_toxic reaches the model's threshold. Texts without a known
    feature get the same low score. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, weights = Active(model.features), model.weights
        for b in batches:
            s = np.array([sum(weights[i] * x for i, x in zip(*active.values_of(t), strict=True)) for t in b.column(1).to_pylist()], float)
            above = model.above(s)
            each = -np.diff(np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= model.reject_from)], ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, with all their columns, whatever their names; each row is judged by its own text.

    A null text counts as empty; null and repeated ids do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, weights = Active(model.features), model.weights
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            s = np.array([sum(weights[i] * x for i, x in zip(*active.values_of(t), strict=True)) for t in texts], float)
            yield b.filter(pa.array(model.above(s)[:, 0] < model.reject_from))

    return docs.mapInArrow(run, docs.schema)
