"""SimHash near-dedup of documents at a shingle similarity: one document of each group stays.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Their
fingerprints then differ in some ten of 64 bits, which is too many for bands of agreeing bits, so
candidates agree in one of BANDS bands of ROWS MinHash values each: a pair of similarity 0.8 is missed
with a chance of 0.0002, one of 0.9 with 10^-7. Of the candidates of a band, the pivot tables and the
Hamming distance discard those that differ in over BITS bits, the sizes those that cannot reach the
similarity, and what survives is verified over all shingles.

Equal word sequences are one node. Survivors tie nodes into clusters, of which only a spanning set of
pairs is written; the shingle sets of a cluster then meet once, and its candidates are verified where
they are not tied yet. A band of more than BLOCK nodes, or a cluster of more than that or SHINGLES
shingles, is cut into blocks, and each pair of blocks is one group: nothing is dropped, no task holds
more than two blocks (a longer text is a block of its own), and no pair is written but a tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from vellum.llm.common import hot_join, plain, sized, under_safe_names, written
from vellum.llm.simhash import SEED, components, majority, near_pairs, shingles, words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Most differing bits of a candidate (4.5 standard deviations above the mean at 0.8), and pivots of a band's table.
BITS, PIVOTS = 22, 8
#: Nodes of a block, shingles of a block on average, and comparisons that a worker holds at once.
BLOCK, SHINGLES, AT_ONCE = 512, 1 << 19, 1 << 20
FACTORS = np.array([xxhash.xxh64_intdigest(b"factor %d" % i, 1) | 1 for i in range(BANDS * ROWS)], np.uint64)


def digest(w: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(w), SEED)


def bands(h: np.ndarray) -> list[int]:
    """A key for each band of MinHash values of the hashes, signed; none for no hashes."""
    if not len(h):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[None, at : at + 4096] * FACTORS[:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, node, fp, n, bands) of every document: digest of its words, fingerprint and number of its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, sizes, keys = [], [], [], []
            for text in b.column(1).to_pylist():
                w = words_of(text or "")
                h = np.unique(shingles(w, words))
                nodes.append(digest(w))
                fps.append(majority(h))
                sizes.append(len(h))
                keys.append(bands(h))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), fp, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "fp", "n", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, node binary, fp long, n long, bands array<long>")


def with_node(docs: DataFrame) -> DataFrame:
    """docs with the column _node."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = pa.array([digest(words_of(t or "")) for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, nodes], [*b.schema.names, "_node"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_node", BinaryType())]))


def cells(nodes: DataFrame) -> DataFrame:
    """(all): lists of the nodes (node, fp, n) that meet, of bands with several nodes. Bands are matched by numbers only; what a node holds comes to those that stay."""
    rows = nodes.select("id", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    sizes = written(sizes.select("key", "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "sizes")
    stay = hot_join(rows, sizes, "key", "rows").join(nodes.select("id", "node", "fp", "n"), "id").drop("id")
    return dealt(stay).groupBy("key", "i", "j").agg(F.collect_list(F.struct("node", "fp", "n")).alias("all")).select("all")


def dealt(rows: DataFrame) -> DataFrame:
    """rows, each once for every pair (i, j) of the `blocks` of its key that holds its own block."""
    met = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest that it reaches over the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def proposed(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b): in each cell, every node with the first that it reaches over pairs that pass pivots, distance and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            ends = np.asarray(lists.offsets).astype(np.int64)
            ends = ends - ends[0]
            items = lists.flatten()
            nodes, fps, n = items.field(0), np.asarray(items.field(1)).view(np.uint64), np.asarray(items.field(2))
            cost = np.cumsum(np.diff(ends) ** 2)
            at = 0
            while at < len(cost):
                to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + AT_ONCE, "right")))
                lo, hi = ends[at], ends[to]
                i, j = near_pairs(fps[lo:hi], np.repeat(np.arange(at, to), np.diff(ends[at : to + 1])), BITS, PIVOTS)
                size = n[lo:hi]
                fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
                label = smallest_reached(hi - lo, i[fits], j[fits])
                tied = np.flatnonzero(label != np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(tied + lo)), nodes.take(pa.array(label[tied] + lo))], ["node", "other"])
                at = to

    return run


def ordered(pairs: DataFrame) -> DataFrame:
    """(a, b), a > b, each once."""
    return pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def linked(fps: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions that tie the sets together as all pairs would that share a band, pass distance and size and reach the similarity.

    A pair whose ends are tied already is not compared.
    """
    n = np.array([len(x) for x in sets], np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    every, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(every), bool)
    root, found = np.arange(len(n)), []
    for i in range(len(n) - 1):
        js = np.arange(i + 1, len(n))
        js = js[(root[js] != root[i]) & (np.bitwise_count(fps[js] ^ fps[i]) <= BITS) & (np.minimum(n[js], n[i]) >= similarity * np.maximum(n[js], n[i]) - 1e-9)]
        js = js[(keys[js] == keys[i]).any(axis=1)]
        if not len(js):
            continue
        mine[ids[ends[i] : ends[i + 1]]] = True
        for j in js:
            if root[j] == root[i]:
                continue
            both = np.count_nonzero(mine[ids[ends[j] : ends[j + 1]]])
            if both >= similarity * (n[i] + n[j] - both) - 1e-9:
                found.append((i, int(j)))
                root[root == root[j]] = root[i]
        mine[ids[ends[i] : ends[i + 1]]] = False
    return found


def verified(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """(node, other): links of the nodes (node, fp, bands, h) of one pair of blocks of a cluster."""

    def run(rows: pa.Table) -> pa.Table:
        nodes = rows["node"].combine_chunks()
        fps = np.asarray(rows["fp"].combine_chunks()).view(np.uint64)
        keys = np.asarray(rows["bands"].combine_chunks().flatten()).reshape(len(fps), BANDS)
        lists = rows["h"].combine_chunks()
        cuts = np.asarray(lists.offsets).astype(np.int64)
        hashes = np.asarray(lists.values)
        pairs = linked(fps, keys, [hashes[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], similarity)
        i, j = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        return pa.table({"node": nodes.take(i), "other": nodes.take(j)})

    return run


def sets(docs: DataFrame, wanted: DataFrame, words: int, named: bool) -> DataFrame:
    """wanted (node, own, ...) with h, the distinct shingle hashes of each node, from the text of its smallest doc_id.

    Documents are chosen by doc_id before their texts meet, so the copies of a text do not. Where each doc_id
    names one row (named) their hashes are taken in place; else rows without an id all come, and one text is
    chosen for each node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.unique(shingles(words_of(t or ""), words)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.list_(pa.int64()))], ["of", "h"])

    ids = sized(written(wanted.filter("own is not null").select("own").distinct(), "wanted-ids"))
    chosen = docs.join(ids, docs["doc_id"] == ids["own"], "left_semi")
    if named:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return chosen.select("doc_id", "text").mapInArrow(run, f"of {kind}, h array<long>").join(sized(wanted), F.col("of") == F.col("own")).drop("of", "own")
    texts = with_node(chosen.select("text").unionByName(docs.filter("doc_id is null").select("text"))).withColumnRenamed("_node", "node").join(wanted.select("node"), "node", "left_semi")
    return texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(run, "of binary, h array<long>").withColumnRenamed("of", "node").join(wanted.drop("own"), "node")


def grouped(docs: DataFrame, sketched: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, named: bool = False) -> DataFrame:
    """(node, top, least, copies) of each node: its component's smallest node and smallest doc_id, and its rows. named: each doc_id names one row."""
    rest = [F.first(c).alias(c) for c in ("fp", "n", "bands")]
    nodes = sketched.groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies"), *rest)
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    near = components(ordered(cells(nodes).mapInArrow(proposed(similarity), "node binary, other binary")))
    ends = near.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("cluster")).distinct()
    ends = written(ends.join(nodes.select("node", "own", "fp", "n", "bands"), "node"), "clustered")
    size = F.greatest(F.ceil(F.sum("n") / SHINGLES), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks")
    sizes = written(ends.groupBy("cluster").agg(F.count("*").alias("members"), size), "clusters")
    met = dealt(sets(docs, written(hot_join(ends.drop("n"), sizes, "cluster", "members"), "wanted"), words, named))
    links = met.groupBy("cluster", "i", "j").applyInArrow(verified(similarity), "node binary, other binary")
    tops = components(ordered(links))
    top = nodes.join(tops, nodes["node"] == tops["a"], "left").select("node", F.coalesce("b", "node").alias("top"), "own", "copies")
    top = written(top, "tops")
    heads = written(top.groupBy("top").agg(F.min("own").alias("least"), F.count("*").alias("nodes")), "heads")
    return written(hot_join(top.drop("own"), heads, "top", "nodes").select("node", "top", "least", "copies"), "named")


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component, all columns kept: the one with the smallest doc_id, nulls last, then the smallest text.

    Texts without words are equal to each other; one with fewer words than a shingle is one shingle. A
    doc_id that occurs once names its row. Rows whose doc_id is null or repeated are few as a rule: their
    digests are taken again, so that a row is judged by its own component. Other columns may have any names
    and types, and are left as they are.
    """
    return under_safe_names(docs, ["doc_id", "text"], lambda rows: one_of_each(rows, words, similarity))


def one_of_each(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    sketched = written(sketches(docs, words), "sketches")
    ids = sketched.filter("doc_id is not null").select("doc_id", "node")
    repeated = written(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    nameless = sketched.filter("doc_id is null").limit(1).count() > 0
    named = grouped(docs, sketched, words, similarity, not nameless and not repeated.limit(1).count())
    gone = hot_join(ids, named, "node", "copies").filter("doc_id <> least").select(F.col("doc_id").alias("_gone"))
    gone = written(gone.unionByName(repeated.select(F.col("doc_id").alias("_gone"))).distinct(), "gone")
    gone = sized(gone)
    kept = docs.filter("doc_id is not null").join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    rest = [docs.filter("doc_id is null")] if nameless else []
    if repeated.limit(1).count():
        rest.append(hot_join(docs, repeated, "doc_id", "n", "left_semi").select(docs.columns))
    heads = named.select(F.col("node").alias("_node"), F.col("top").alias("_top"), F.col("least").alias("_least"), F.col("copies").alias("_copies"))
    for rows in rest:
        own = hot_join(with_node(rows), heads, "_node", "_copies").filter(F.col("doc_id").eqNullSafe(F.col("_least")))
        order = F.struct("text", *[plain(docs, c) for c in docs.columns if c != "text"])
        first = own.groupBy("_top").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
        kept = kept.unionByName(first.select("row.*"))
    return kept
