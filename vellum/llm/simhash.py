"""SimHash near-duplicates: pivot distance tables inside bands, components by star contraction.

Equal fingerprints are one node. Two fingerprints that differ in at most two bits agree in one of three
blocks of bits, so each goes to three bands, each an equi-join key. Inside a band every fingerprint has a
row in a table of Hamming distances to PIVOTS fixed reference fingerprints. By the triangle inequality
two fingerprints that differ in at most two bits have distances to any reference that differ by at most
two: the band is sorted by the first distance, only neighbours within two of it are paired, a pair goes
as soon as one coordinate differs by more, and what survives is verified bit by bit.

A band with more than BAND fingerprints is cut again by three blocks of its remaining bits, and so on:
nothing is dropped, and a band of fingerprints that agree in all but r bits has at most 2^r of them.
Rows of very common bands, nodes and fingerprints are joined apart from the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vellum.llm.common import hot_join, written

#: Reference fingerprints, and the most fingerprints of a band that one task compares.
PIVOTS, BAND = 32, 4096
SEED = 42


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased; space and U+0009 to U+000D part them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(w: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than a shingle are hashed whole."""
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    return majority(shingles(words_of(text), words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every document; a null text counts as empty, with fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t or "", words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split(mask: int, parts: int = 3) -> list[int]:
    """The mask with each of `parts` blocks of the bits that it lacks."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i * len(free) // parts : (i + 1) * len(free) // parts]) for i in range(parts)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 1) for i in range(n)], np.uint64)


def near_pairs(fps: np.ndarray, band: np.ndarray, most: int = 2, n_pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs inside a band that differ in at most `most` bits."""
    refs = pivots(n_pivots)
    first = np.bitwise_count(fps ^ refs[0]).astype(np.int16)
    order = np.lexsort((first, band))
    fps, band = fps[order], band[order]
    dist = np.stack([np.bitwise_count(fps ^ r) for r in refs]).astype(np.int16)
    left, right, k = [], [], 1
    open_ = np.arange(len(fps) - 1)
    while len(open_):
        open_ = open_[open_ + k < len(fps)]
        j = open_ + k
        near = (band[j] == band[open_]) & (dist[0][j] - dist[0][open_] <= most)
        open_ = open_[near]  # sorted by distance: one that is too far now is too far from all further on
        i, j = open_, j[near]
        for d in dist[1:]:
            if not len(i):
                break
            keep = np.abs(d[i] - d[j]) <= most
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= most
        left.append(order[i[keep]])
        right.append(order[j[keep]])
        k += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def links(nodes: DataFrame, band: int = BAND) -> DataFrame:
    """(a, b), a > b: node ids of all pairs of distinct fingerprints that differ in at most two bits. nodes: (fp, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            sizes = np.diff(np.asarray(lists.offsets))
            items = lists.flatten()
            fps = np.asarray(items.field(0)).view(np.uint64)
            ids = np.asarray(items.field(1))
            i, j = near_pairs(fps, np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.array(np.minimum(ids[i], ids[j]))], ["a", "b"])

    found = None
    todo = nodes.select("fp", "node", F.lit(-1).alias("mask"), F.lit(0).cast("long").alias("key"))
    masks = [0]
    while masks:
        nxt = [m for p in masks for m in split(p)]
        subs = [F.struct(F.lit(3 * i + k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, p in enumerate(masks) for k, m in enumerate(split(p))]
        if len(masks) == 1:
            keys = F.array(*subs)
        else:  # the three blocks of the band that a row comes from
            by = F.array(*[F.array(*subs[3 * i : 3 * i + 3]) for i in range(len(masks))])
            keys = by[F.col("mask")]
        rows = todo.select("fp", "node", F.explode(keys).alias("at")).select("fp", "node", "at.mask", "at.key")
        sizes = written(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("rows", F.col("n")), "sizes")
        rows = written(hot_join(rows, sizes, ["mask", "key"], "rows"), "bands")
        small = rows.filter(F.col("n") <= band).groupBy("mask", "key").agg(F.collect_list(F.struct("fp", "node")).alias("all"))
        pairs = small.select("all").mapInArrow(run, "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        todo = rows.filter(F.col("n") > band).select("fp", "node", "mask", "key")
        masks = nxt if todo.limit(1).count() else []
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not the smallest of its component, with the smallest. edges: (a, b), a > b.

    Large and small stars in turn: each node ties its larger neighbours, then its smaller ones, to the
    smallest node near it; the number of rounds grows with the logarithm of the longest path.
    """
    edges = written(edges.select("a", "b"), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = hot_join(both, written(least, "least"), "a", "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        joined = hot_join(large, low, "a", "n")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "small")
        centres = edges.select(F.col("b").alias("c")).distinct()
        if not edges.join(centres, edges["a"] == centres["c"], "left_semi").limit(1).count():
            if not edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
                return edges


def grouped(fps: DataFrame) -> DataFrame:
    """(fp, top, component_id, n_links, copies) of each fingerprint of fps (doc_id, fp); top: its component's smallest fingerprint."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    pairs = written(links(nodes.select("fp", F.col("fp").alias("node"))), "links")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
    top = components(pairs).withColumnRenamed("b", "top")
    named = nodes.join(top, nodes["fp"] == top["a"], "left").join(ends, nodes["fp"] == ends["c"], "left")
    named = written(named.select("fp", F.coalesce("top", "fp").alias("top"), "least", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies"), "tops")
    heads = written(named.groupBy("top").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "heads")
    return written(hot_join(named.drop("least"), heads, "top", "n").select("fp", "top", "component_id", "n_links", "copies"), "named")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of every document.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most two bits;
    n_links counts the other fingerprints linked to the document's own. A text without words has
    fingerprint zero, a text with fewer words than a shingle is hashed whole. Repeated rows give repeated
    rows. A null doc_id takes its component from the others, and is null where all are.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    out = hot_join(fps, grouped(fps), "fp", "copies")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
