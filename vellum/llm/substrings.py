"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the 35 16-word grams in a window of 50 words, the one with the smallest
hash. Equal windows choose the same anchor, so a window can only repeat where its anchor does. The
consecutive windows that share an anchor are a run; the run's words are the anchor extended to both
sides as far as the anchor rules.

Anchors that occur in one document only are put away first. Where two documents share a whole run, the
later one loses it: one row per run, not per window. The runs at the ends of a shared passage differ
outside it; for one occurrence of each run of an anchor that has several, the extension is settled word
by word: its windows are hashed one by one and meet by hash. The union of the windows found in a smaller
document is the maximal repeat, and its words go. Copies meet as (run, smallest document), pre-aggregated
on the map side, never as pairs. Anchors, runs and windows with very many rows are joined apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import hot_join, written

#: Words of a window, and of an anchor.
WINDOW, GRAM = 50, 16
#: Two independent 64-bit hashes stand for equal words: at 10^13 windows one of them alone would meet by chance.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any word range of a text in constant time."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        self.sums, self.back = [], []
        for seed, (base, inverse) in enumerate(zip(_BASES, _INVERSES, strict=True)):
            h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, n)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, n), dtype=np.uint64)]))
            self.back.append(powers(inverse, n + 1))

    def of(self, start: np.ndarray, size: np.ndarray | int, which: int = 0) -> np.ndarray:
        sums, back = self.sums[which], self.back[which]
        return mixed((sums[start + size] - sums[start]) * back[start] + np.asarray(size).astype(np.uint64))


def runs(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, two run hashes, first window, number of windows) of each run of a text, in text order."""
    n = len(words) - window + 1
    if n <= 0:
        return (*(np.zeros(0, np.uint64),) * 3, *(np.zeros(0, np.int64),) * 2)
    hashes = Hashes(words)
    grams = hashes.of(np.arange(len(words) - gram + 1), gram)
    reach = window - gram + 1
    least = np.empty(n, np.int64)
    for at in range(0, n, 1 << 15):
        part = grams[at : min(at + (1 << 15), n) + reach - 1]
        least[at : at + (1 << 15)] = np.lib.stride_tricks.sliding_window_view(part, reach).argmin(axis=1) + np.arange(at, at + len(part) - reach + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    anchor = least[first]
    whole = [mixed(hashes.of(first, count + window - 1, k) + (anchor - first).astype(np.uint64)) for k in (0, 1)]
    return grams[anchor], *whole, first, count


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, anchor, run, run2, first, n) of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [runs((t or "").encode("utf-8", "surrogatepass").split(), window) for t in b.column(1).to_pylist()]
            sizes = [len(p[0]) for p in parts]
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []
            if sum(sizes):
                ids = np.repeat(np.asarray(b.column(0)), sizes)
                values = [pa.array(c.view(np.int64)) for c in cols[:3]] + [pa.array(c.astype(np.int32)) for c in cols[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *values], ["doc_id", "anchor", "run", "run2", "first", "n"])

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(run, "doc_id long, anchor long, run long, run2 long, first int, n int")


def window_hashes(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, window2, doc_id, run, run2, offset) for each window of the wanted runs; wanted: (doc, runs array<struct<run, run2, first, n>>)."""
    names = ["window", "window2", "doc_id", "run", "run2", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for doc, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                hashes = Hashes((text or "").encode("utf-8", "surrogatepass").split())
                first = np.array([r["first"] for r in found], np.int64)
                n = np.array([r["n"] for r in found], np.int64)
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(first, n) + offset
                keys = [np.repeat(np.array([r[k] for r in found], np.int64), n) for k in ("run", "run2")]
                for part, column in zip(out, [*(hashes.of(start, window, k).view(np.int64) for k in (0, 1)), np.full(n.sum(), doc), *keys, offset.astype(np.int32)], strict=True):
                    part.append(column)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    joined = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "runs")
    return joined.mapInArrow(run, "window long, window2 long, doc_id long, run long, run2 long, offset int")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, spans array<struct<first, n, mask>>): windows of each document that also start in a smaller one.

    first and n: a run's windows; mask: null for all of them, else the bits of those that repeat.
    """
    found = written(anchors(docs, window), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).filter("lo < hi").select("anchor", "rows")
    found = written(hot_join(found, written(shared, "anchors-shared"), "anchor", "rows", "left_semi"), "shared")
    kinds = written(found.groupBy("anchor", "run", "run2").agg(F.min(F.struct("doc_id", "first", "n")).alias("at"), F.count("*").alias("copies")), "runs")
    several = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "several")
    wanted = hot_join(kinds, several, "anchor", "kinds", "left_semi").groupBy(F.col("at.doc_id").alias("doc")).agg(F.collect_list(F.struct("run", "run2", "at.first", "at.n")).alias("runs"))
    single = written(window_hashes(docs, wanted, window), "windows")
    least = single.groupBy("window", "window2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).filter("lo < hi").select("window", "window2", "lo", "rows")
    masks = hot_join(single, written(least, "least"), ["window", "window2"], "rows").filter("doc_id > lo").groupBy("run", "run2").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"))
    settled = written(kinds.select("run", "run2", F.col("at.doc_id").alias("lo"), "copies").join(masks, ["run", "run2"], "left"), "settled")
    spans = hot_join(found, settled, ["run", "run2"], "copies").filter("doc_id > lo or mask is not null")
    spans = spans.select(F.col("doc_id").alias("doc"), F.struct("first", "n", F.when(F.col("doc_id") > F.col("lo"), F.lit(None)).otherwise(F.col("mask")).cast("long").alias("mask")).alias("span"))
    return spans.groupBy("doc").agg(F.collect_list("span").alias("spans"))


def deduplicate(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document, or kept_sha256 in place of kept.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller
    doc_id. Words are parted by space and U+0009 to U+000D and stay as they are; kept ones are joined by
    one space. A null text has no words. Rows with one doc_id are one document's versions: they do not
    count as smaller than each other. A row without doc_id keeps all its words.
    """
    if not GRAM < window <= GRAM + 63:
        raise ValueError("a window has between 17 and 79 words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    starts = np.arange(s["n"])
                    if s["mask"] is not None:
                        starts = starts[(s["mask"] >> starts) & 1 == 1]
                    starts = starts + s["first"]
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.minimum(starts + window, len(words)), -1)
                stay = np.cumsum(edge)[:-1] == 0
                left = b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s] if spans else words)
                total.append(len(words))
                removed.append(len(words) - int(stay.sum()))
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    found = repeats(docs, window)
    joined = docs.select("doc_id", "text").join(found, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
