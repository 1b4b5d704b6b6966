"""Phrase collocations per language: count-min sketches, exact counts of what survives them, scores, subsumption.

Two sketch passes, one exact pass. The first sketch counts words and pairs, the second phrases of three to
`longest` words all of whose pairs survived the first. A task counts into its own sketch and sends the
cells that are not zero, by blocks; equal blocks are added as sorted streams. A cell is only asked whether
it reaches `least`, so counts are cut at `least` before and after adding, which changes no answer, and the
merged sketch comes down to one bit for each cell. A cell holds at least the count of each phrase in it,
so every phrase with `least` occurrences survives, and so do all phrases inside it. The second pass also
marks the words of surviving pairs, as no other word is part of a phrase. The third pass counts the
survivors exactly, by the words themselves and summed in the task, and drops those that only seemed frequent.

Cells grow with the input, from 2^16 to 2^MAX_BITS a row: what is broadcast is DEPTH rows of one bit for
each cell, twice, and the marks, 68 MB at most. A larger corpus lets more phrases through to the exact pass;
none is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import hot_join, parallelism, written

LEAST, LONGEST, TOP = 100, 5, 2000
DEPTH, MAX_BITS, BLOCK_BITS = 2, 27, 16
#: Bytes of text that are counted at once (a longer text alone), and phrases that a task sums before it sends them on.
CHUNK, HELD = 8 << 20, 1_000_000
#: Bytes of input of a task at most, where that leaves TASKS tasks to a core: what a task sums and sends grows less than what it reads.
TASK_BYTES, TASKS = 1 << 30, 2
#: Piece separators become line feeds, tabs become spaces, A to Z are lower-cased.
FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
TOKEN = re.compile(rb"[^ \n]+|\n")
ODD = np.array([xxhash.xxh64_intdigest(b"row %d" % d, 1) | 1 for d in range(DEPTH)], np.uint64)
MIX = np.uint64(xxhash.xxh64_intdigest(b"next word", 1) | 1)


class Numbers(dict):
    """A number for each word, from 1 in the order they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(lang, word numbers, words) of (lang, text as bytes): pieces one after the other, each ended by a 0."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text.translate(FOLD))
            size += len(text)
            if size >= CHUNK:
                yield from numbered(held)
                held, size = {}, 0
    yield from numbered(held)


def numbered(held: dict[str, list[bytes]]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    for lang, texts in held.items():
        numbers = Numbers({b"\n": 0})
        ids = [np.fromiter(map(numbers.__getitem__, TOKEN.findall(t)), np.int32) for t in texts]
        yield lang, np.concatenate([x for part in ids for x in (part, np.zeros(1, np.int32))]), list(numbers)


def hashes(lang: str, ids: np.ndarray, words: list[bytes], longest: int) -> list[np.ndarray]:
    """For each length from 1 to longest, the hash of the phrase that starts at each place."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    one = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))[ids]
    out = [one]
    for m in range(2, longest + 1):
        before = out[-1][:-1] * MIX
        out.append((before ^ (before >> np.uint64(29))) + one[m - 1 :])
    return out


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * ODD[row]) >> np.uint64(64 - bits)).astype(np.int64)


def bits_of(row: int, bits: int) -> int:
    """Cells of a row, as a power of two: counts have DEPTH rows, the marks of words one that is smaller."""
    return bits if row < DEPTH else max(6, bits - 2)


def survives(rows: list[np.ndarray], h: np.ndarray, marks: bool = False) -> np.ndarray:
    """Whether the cells of all rows of counts, or the cell of the marks, are set; 8 cells to a byte."""
    out = np.ones(len(h), bool)
    for row in [DEPTH] if marks else range(DEPTH):
        at = cells(h, min(row, DEPTH - 1), len(rows[row]).bit_length() + 2)
        out &= (rows[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def inside(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length, whether the phrase that starts at a place lies inside one piece."""
    out = [ids > 0]
    for m in range(2, longest + 1):
        out.append(out[-1][:-1] & out[0][m - 1 :])
    return out


def counted(bits: int, least: int, longest: int, pairs=None):
    """(row, block, cells, counts): a task's sketch of words and pairs or, given the sketch of these, of longer phrases and the marks of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [np.zeros(1 << bits_of(row, bits), np.min_scalar_type(least)) for row in range(DEPTH if pairs is None else DEPTH + 1)]
        for lang, ids, words in chunks(batches):
            h = hashes(lang, ids, words, 2 if pairs is None else longest)
            fit = inside(ids, len(h))
            if pairs is None:
                found = [h[m][fit[m]] for m in (0, 1)]
            else:
                good, found = fit[1] & survives(pairs.value, h[1]), [np.zeros(0, np.uint64)]
                of_good = np.zeros(len(ids), bool)
                of_good[:-1] |= good
                of_good[1:] |= good
                table[DEPTH][cells(np.unique(h[0][of_good]), DEPTH - 1, bits_of(DEPTH, bits))] = least
                run_of = good
                for m in range(3, longest + 1):
                    run_of = run_of[:-1] & good[m - 2 :]
                    found.append(h[m - 1][run_of & fit[m - 1]])
            every = np.concatenate(found)
            for row in range(DEPTH):
                at, n = np.unique(cells(every, row, bits), return_counts=True)
                table[row][at] = np.minimum(table[row][at].astype(np.int64) + n, least)
        for row, counts in enumerate(table):
            block = min(len(counts), 1 << BLOCK_BITS)
            for b in range(len(counts) // block):
                part = counts[b * block : (b + 1) * block]
                at = np.flatnonzero(part)
                if len(at):
                    yield pa.RecordBatch.from_pylist([{"row": row, "block": b, "cells": at.astype(np.uint16).tobytes(), "counts": part[at].tobytes()}], SENT)

    return run


SENT = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


def added(bits: int, least: int):
    """(row, block, reached): of blocks in order, one bit for each cell, whether the counts add up to least."""
    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("reached", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, at, total = np.min_scalar_type(least), None, None
        send = lambda: pa.RecordBatch.from_pylist([{"row": at[0], "block": at[1], "reached": np.packbits(total >= least, bitorder="little").tobytes()}], schema)
        for b in batches:
            for r in b.to_pylist():
                if (r["row"], r["block"]) != at:
                    if at is not None:
                        yield send()
                    at, total = (r["row"], r["block"]), np.zeros(1 << min(bits_of(r["row"], bits), BLOCK_BITS), np.int64)
                total[np.frombuffer(r["cells"], np.uint16)] += np.frombuffer(r["counts"], kind)
        if at is not None:
            yield send()

    return run


def sketch(texts: DataFrame, bits: int, least: int, longest: int, pairs=None) -> list[np.ndarray]:
    """The merged sketch: rows of cells, 8 to a byte, set where a count reaches least; given pairs, the marks of words come last."""
    sent = texts.mapInArrow(counted(bits, least, longest, pairs), "row int, block int, cells binary, counts binary")
    order = sent.repartition(parallelism(texts.sparkSession), "row", "block").sortWithinPartitions("row", "block")
    out = [np.zeros((1 << bits_of(row, bits)) // 8, np.uint8) for row in range(DEPTH if pairs is None else DEPTH + 1)]
    for r in order.mapInArrow(added(bits, least), "row int, block int, reached binary").toLocalIterator():
        part = np.frombuffer(r["reached"], np.uint8)
        out[r["row"]][r["block"] * len(part) : (r["block"] + 1) * len(part)] = part
    return out


def survivors(pairs, longer, longest: int):
    """(lang, phrase, f): what survives, counted by its words and summed in the task, and as the empty phrase all words."""

    def found(lang: str, ids: np.ndarray, words: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
        h, fit = hashes(lang, ids, words, longest), inside(ids, longest)
        yield [b""], [int(fit[0].sum())]
        group, live = ids.astype(np.int64), None
        for m in range(1, longest + 1):
            may = fit[m - 1] if live is None else live[:-1] & live[1:] & fit[m - 1]
            at = np.flatnonzero(may)
            at = at[survives((pairs if m == 2 else longer).value, h[m - 1][at], m == 1)]
            # a phrase is its first words, numbered before, and its last word
            key = ids[at].astype(np.int64) if m == 1 else group[at] * len(words) + ids[at + m - 1]
            _, first, same, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            yield [b" ".join([words[w] for w in row]) for row in ids[at[first][:, None] + np.arange(m)].tolist()], n.tolist()
            live, group = np.zeros(len(may), bool), np.zeros(len(may), np.int64)
            live[at], group[at] = True, same

    def sent(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            phrases, f = pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())
            for lo in range(0, len(f), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f[part])), phrases[part], f[part]], ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}
        for lang, ids, words in chunks(batches):
            counts = held.setdefault(lang, {})
            for phrases, f in found(lang, ids, words):
                for phrase, n in zip(phrases, f, strict=True):
                    counts[phrase] = counts.get(phrase, 0) + n
            if sum(map(len, held.values())) >= HELD:
                yield from sent(held)
                held = {}
        yield from sent(held)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int | None = None) -> DataFrame:
    """(lang, phrase, f): every phrase of two to `longest` words with f >= least, exactly, every word of one, and all words as the empty phrase."""
    sc = docs.sparkSession.sparkContext
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if bits is None:
        bits = min(MAX_BITS, max(16, (size // 32).bit_length()))
    tasks = max(TASKS * sc.defaultParallelism, -(-size // TASK_BYTES))
    if docs.rdd.getNumPartitions() > tasks:
        docs = docs.coalesce(tasks)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    pairs = sc.broadcast(sketch(texts, bits, least, longest))
    longer = sc.broadcast(sketch(texts, bits, least, longest, pairs))
    found = texts.mapInArrow(survivors(pairs, longer, longest), "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of counted phrases of two words or more: the lowest score of all cuts, the first of equal ones."""
    rows = counts.filter("phrase <> ''").withColumn("words", F.split("phrase", " "))
    cut = rows.filter(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    part = lambda lo, n: F.array_join(F.slice("words", lo, n), " ")
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    of = lambda key, name: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    cut = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    totals = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    cut = hot_join(cut, written(totals.join(sizes, "lang"), "langs"), "lang", "rows")
    # up to 38 digits: a, l, r of 14 and n of 18 digits are exact
    score = F.expr("cast(1000 * cast(a as decimal(14,0)) as decimal(18,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    return best.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")


def subsumed(counts: DataFrame, share: int = 100) -> DataFrame:
    """(lang, phrase) that lie in a longer counted phrase with at least share percent of their own count.

    A phrase between the two occurs at least as often as the longer one, so one word more is enough to look at.
    """
    rows = counts.filter("phrase <> ''").withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 2)
    short = F.array(*[F.array_join(F.slice("words", F.lit(at), F.size("words") - 1), " ") for at in (1, 2)])
    most = rows.select("lang", "f", F.explode(short).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("more"))
    return counts.join(most, ["lang", "phrase"]).filter(f"100 * cast(more as decimal(20,0)) >= {int(share)} * cast(f as decimal(20,0))").select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 100, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` best collocations of each lang.

    Words are what spaces and tabs part inside a piece of text without .,;:!? and line ends; A to Z count
    as lower case. A null lang counts as und, a null text as empty; equal rows count each. A phrase needs
    `least` occurrences; phrases inside a longer one with `share` percent of their count go. Ranks are by
    score, count and phrase, descending, descending and ascending. An empty table gives no rows; only the
    columns lang and text are read, so others may have any name.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    counts = written(phrase_counts(docs, least, longest, bits), "phrases")
    kept = scored(counts).join(subsumed(counts, share), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
