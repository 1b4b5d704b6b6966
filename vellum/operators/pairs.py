"""Similarity of notes: a set-similarity join by pairs of blocks with a second gate on telling stems."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import BARS
from vellum.operators.index import NoteIndex
from vellum.operators.ranks import rank_within as rank_of
from vellum.storage import kept, sized


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b - shared > 0, shared / (a + b - shared)).otherwise(F.lit(0.0))


def candidates(index: NoteIndex) -> DataFrame:
    """(a, b, shared), a < b: pairs of notes with a top stem in common and how many; excluded notes open none."""
    return block_pairs(index).select("a", "b", "shared")


#: Notes of a block at most; notes that a block has at least before there are more blocks than cores ask for; rows of a batch that a task gives.
BLOCK, LEAST, GIVEN = 16_000, 500, 50_000
#: A stem that more than one of so many notes of a block have is kept as a row of bytes, one for each note: of top stems, of telling ones.
TOP_SHARE, TELLING_SHARE = 64, 16
PAIRS = "a string, b string, shared long, score double, overlap double, known boolean"
PACKED = "path string, size int, top binary, told int, stems binary"


def stem_sets(index: NoteIndex, of: DataFrame | None = None) -> DataFrame:
    """(path, stems array<long>): hashes of the telling stems of each note, or of those of a written table (path)."""
    rows = index.disc if of is None else index.disc.join(sized(of), "path", "left_semi")
    return rows.groupBy("path").agg(F.collect_list(F.xxhash64("stem")).alias("stems"))


def stem_ids(rows: DataFrame) -> DataFrame:
    """(h, id): a number for the hash of each stem that two rows (path, stem) or more have, from 1, the commonest first."""
    shared = kept(rows.groupBy(F.xxhash64("stem").alias("h")).agg(F.count("*").alias("df")).filter("df > 1"), "shared-stems")
    return kept(rank_of(shared, "id", [], [F.col("df").desc(), F.col("h")]).select("h", F.col("id").cast("int").alias("id")), "stem-ids")


def numbered(rows: DataFrame, ids: DataFrame, size: str, name: str) -> DataFrame:
    """(path, size, name array<int>): how many stems each note of rows (path, stem) has, and the numbers of those that others have too."""
    met = rows.select("path", F.xxhash64("stem").alias("h")).join(sized(ids), "h", "left")
    return met.groupBy("path").agg(F.count("*").cast("int").alias(size), F.collect_list("id").alias(name))


def pack(sets: pa.ListArray) -> pa.Array:
    """Sets of numbers as bytes: sorted, the gaps between them in groups of seven bits, the eighth set where more follow."""
    values, lengths = ragged(sets)
    ends = np.cumsum(lengths)
    values = values.astype(np.int64)[np.lexsort((values, np.repeat(np.arange(len(lengths)), lengths)))]
    gaps = np.diff(values, prepend=0)
    first = (ends - lengths)[lengths > 0]
    gaps[first] = values[first]
    width = 1 + (gaps >= 1 << 7) + (gaps >= 1 << 14) + (gaps >= 1 << 21) + (gaps >= 1 << 28)
    at = np.cumsum(width) - width
    data = np.zeros(width.sum(), np.uint8)
    for k in range(5):
        more = width > k
        data[at[more] + k] = (gaps[more] >> 7 * k & 127) | np.where(width[more] > k + 1, 128, 0)
    offsets = np.append(0, np.append(0, np.cumsum(width))[ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, lengths) of the sets of pack()."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    if offsets[0] == offsets[-1]:
        return np.empty(0, np.int64), np.zeros(len(packed), np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    last = np.flatnonzero(data < 128)
    starts = np.append(0, last[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    gaps = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)
    lengths = np.diff(np.searchsorted(last, offsets - offsets[0]))
    sums = np.cumsum(gaps)
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    return sums - np.repeat(sums[first] - gaps[first], lengths[lengths > 0]), lengths


def ragged(sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return sets.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of these lengths from these starts, one run after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


class Block:
    """Which notes of a block have a stem: a row of bytes for a common one, the notes listed for any other. ask() names the sets to be counted."""

    def __init__(self, sets: tuple[np.ndarray, np.ndarray], share: int) -> None:
        self.values, self.lengths = sets
        self.starts, self.notes, self.share = np.cumsum(self.lengths) - self.lengths, len(self.lengths), share
        self.count = np.bincount(self.values, minlength=1)  # by number; 0 is none's
        self.marks = np.zeros(len(self.count), np.uint8)

    def ask(self, sets: tuple[np.ndarray, np.ndarray]) -> None:
        values, lengths = sets
        known = self.count[np.where(values < len(self.count), values, 0)] > 0
        self.asked = values[known]
        self.begin = np.searchsorted(np.repeat(np.arange(len(lengths)), lengths)[known], np.arange(len(lengths) + 1))
        self.kind = np.uint8 if max(lengths.max(initial=0), self.lengths.max(initial=0)) < 255 else np.int32

    @cached_property
    def rows(self) -> np.ndarray:
        """The notes by number."""
        return np.repeat(np.arange(self.notes, dtype=np.int32), self.lengths)[np.argsort(self.values, kind="stable")]

    @cached_property
    def first(self) -> np.ndarray:
        return np.cumsum(self.count) - self.count

    @cached_property
    def line(self) -> np.ndarray:
        common = self.count * self.share > self.notes
        return np.where(common, np.cumsum(common) - 1, -1)

    @cached_property
    def lines(self) -> np.ndarray:
        at, lines = np.repeat(self.line, self.count), np.zeros((self.line.max() + 1, self.notes), np.uint8)
        lines[at[at >= 0], self.rows[at >= 0]] = 1
        return lines

    def every(self, a: int) -> np.ndarray:
        """How many stems of set a each note of the block has."""
        stems = self.asked[self.begin[a] : self.begin[a + 1]]
        lines = self.line[stems]
        few, lines = stems[lines < 0], lines[lines >= 0]
        shared = np.zeros(self.notes, self.kind)
        for k in range(0, len(lines), 255):  # a byte holds as much
            shared += np.add.reduce(self.lines[lines[k : k + 255]], axis=0, dtype=np.uint8)
        if len(few):
            np.add.at(shared, self.rows[spans(self.first[few], self.count[few])], self.kind(1))
        return shared

    def some(self, a: int, b: np.ndarray) -> np.ndarray:
        """How many stems of set a the notes b have: by their own stems where these are few."""
        stems, lengths = self.asked[self.begin[a] : self.begin[a + 1]], self.lengths[b]
        if 32 * lengths.sum() > len(stems) * self.notes:
            return self.every(a)[b].astype(np.int64)
        shared, some = np.zeros(len(b), np.int64), lengths > 0
        if some.any():
            self.marks[stems] = 1
            lengths = lengths[some]
            shared[some] = np.add.reduceat(self.marks[self.values[spans(self.starts[b[some]], lengths)]], np.cumsum(lengths) - lengths, dtype=np.int64)
            self.marks[stems] = 0
        return shared


def ratio(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """jaccard() of arrays."""
    return np.divide(shared, a + b - shared, out=np.zeros(len(shared)), where=a + b - shared > 0)


def bars(tau: float, size: int, sizes: np.ndarray, kind: type) -> np.ndarray:
    """For each of the sizes the least that a set of it must share with one of `size` to come to tau; never where it cannot."""
    never = np.iinfo(kind).max
    found = np.full(sizes.max(initial=0) + 1, never, kind)
    for other in np.unique(sizes).tolist():
        shared = np.arange(1, min(size, other) + 1)
        reached = shared[ratio(shared, size, other) >= tau]
        found[other] = reached[0] if len(reached) else never
    return found[sizes]


def codes_of(links: pa.Table, owners: pa.Array, paths: pa.Array) -> np.ndarray:
    """The links (path, to) between notes of two blocks, either way, as sorted numbers: the place of the one times the size of the other block, plus the place of the other."""
    found = []
    for a, b in (("path", "to"), ("to", "path")):
        i, j = (pc.fill_null(pc.index_in(links[c], value_set=where), -1).to_numpy() for c, where in ((a, owners), (b, paths)))
        found.append((i.astype(np.int64) * len(paths) + j)[(i >= 0) & (j >= 0)])
    return np.unique(np.concatenate(found))


def met(left: pa.Table, right: pa.Table, same: bool, tau: float, gate: float | None, links: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of PAIRS for two blocks of PACKED, or for one block with itself; known: whether links (path, to) has the pair."""
    one = lambda t, c: t[c].combine_chunks()
    sizes_of = lambda t, c: one(t, c).to_numpy(zero_copy_only=False).astype(np.int64)
    paths, owners, sizes, mine = one(right, "path"), one(left, "path"), sizes_of(right, "size"), sizes_of(left, "size")
    tops = Block(unpack(one(right, "top")), TOP_SHARE)
    tops.ask(unpack(one(left, "top")))
    if gate is not None:
        telling, told, my_told = Block(unpack(one(right, "stems")), TELLING_SHARE), sizes_of(right, "told"), sizes_of(left, "told")
        telling.ask(unpack(one(left, "stems")))
    if max(mine.max(), sizes.max()) >= 255:
        tops.kind = np.int32
    codes = codes_of(links, owners, paths) if links is not None and len(links) else np.empty(0, np.int64)
    bar: dict[int, np.ndarray] = {}
    done, rows = [], 0

    def batch() -> pa.RecordBatch:
        a = np.repeat([d[0] for d in done], [len(d[1]) for d in done])
        b, shared, overlap = (np.concatenate([d[k] for d in done]) for k in (1, 2, 3))
        shared = shared.astype(np.int64)
        known = np.isin(a * len(paths) + b, codes) if len(codes) else np.zeros(len(b), bool)
        columns = [owners.take(pa.array(a)), paths.take(pa.array(b)), pa.array(shared), pa.array(ratio(shared, mine[a], sizes[b])), pa.array(overlap), pa.array(known)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "shared", "score", "overlap", "known"])

    for a, size in enumerate(mine.tolist()):
        if size not in bar:
            bar[size] = bars(tau, size, sizes, tops.kind)
        shared = tops.every(a)
        near = shared >= bar[size]
        if same:
            near[: a + 1] = False
        b = np.flatnonzero(near)
        if not len(b):
            continue
        overlap = np.zeros(len(b))
        if gate is not None:
            overlap = ratio(telling.some(a, b), my_told[a], told[b])
            b, overlap = b[overlap >= gate], overlap[overlap >= gate]
        if len(b):
            done.append((a, b, shared[b], overlap))
            rows += len(b)
        if rows >= GIVEN:
            yield batch()
            done, rows = [], 0
    if done:
        yield batch()


def block_pairs(index: NoteIndex, tau: float = 0.0, gate: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, score, overlap), with a table known also known, a < b: pairs of notes, excluded ones apart, with a top stem in common and a score of tau at least.

    With gate, only those whose overlap, the similarity of the telling stems (0 where a note has none), reaches it; else it is
    not computed. Notes are dealt to blocks of bounded size by a hash, and a task holds two blocks and one note's counts:
    no pair is written or shuffled to be counted, and pairs below the bars never leave their task. A note is sent once to each
    block, so its stems go as packed numbers, those that no other note has as their count only. Pairs of the table known (a, b), in
    any order, are told: each goes once to the task of its blocks, so no pair is shuffled to meet them. The work is that of all
    pairs of notes, which grows with their square.
    """
    tops = index.top.filter("not excluded").select("path", "stem")
    ids = stem_ids(tops if gate is None else index.counts)
    sets = numbered(tops, ids, "size", "top")
    if gate is None:
        sets = sets.withColumns({"told": F.lit(0), "stems": F.array().cast("array<int>")})
    else:
        sets = sets.join(numbered(index.disc, ids, "told", "stems"), "path", "left").fillna(0, ["told"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["path"], b["size"], pack(b["top"]), b["told"], pack(b["stems"])], names=["path", "size", "top", "told", "stems"])

    sets = kept(sets.select("path", "size", "top", "told", "stems").mapInArrow(packed, PACKED), "pair-sets")
    n, cores = sets.count(), sets.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(n / BLOCK), min(math.ceil(math.sqrt(6 * cores)), math.ceil(n / LEAST)), 1)
    block_of = lambda path: F.pmod(F.xxhash64(path), F.lit(blocks)).cast("int")
    own = sets.withColumns({"block": block_of("path"), "to": F.lit(None).cast("string")})
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "to", *sets.columns)
    if known is not None:
        ends = known.select(F.least(block_of("a"), block_of("b")).alias("i"), F.greatest(block_of("a"), block_of("b")).alias("j"), F.lit(-1).alias("block"), F.col("b").alias("to"), F.col("a").alias("path"))
        sent = sent.unionByName(ends, allowMissingColumns=True)

    def pair(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        i, j = (k.as_py() for k in key)
        left, right = (rows.filter(pc.equal(rows["block"], k)) for k in (i, j))
        if len(left) and len(right):
            yield from met(left, right, i == j, tau, gate, rows.filter(pc.equal(rows["block"], -1)))

    found = sent.repartition(blocks * (blocks + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(pair, PAIRS)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "score", "overlap", *(["known"] if known is not None else []))


def scored_pairs(index: NoteIndex, tau: float = BARS.orphan) -> DataFrame:
    """(a, b, score), a < b: pairs of notes, excluded ones apart, whose top stems overlap by tau at least."""
    return block_pairs(index, tau).select("a", "b", "score")


def edges(index: NoteIndex, tau: float = BARS.edge, but: DataFrame | None = None) -> DataFrame:
    """(a, b, score): every inferred edge, each once, without the pairs of a table (a, b)."""
    found = block_pairs(index, tau, BARS.template, but)
    return (found if but is None else found.filter("not known")).select("a", "b", "score")


def related_all(index: NoteIndex, path: str, tau: float = BARS.listed) -> DataFrame:
    """(path, score, overlap): notes related to one note, unlimited. An excluded note asks, but never answers."""
    mine = index.top.filter(F.col("path") == path).select("stem", F.col("size").alias("mine"))  # at most 30 rows
    others = index.top.filter((F.col("path") != path) & ~F.col("excluded"))
    met = others.join(F.broadcast(mine), "stem").groupBy("path", "size", "mine").agg(F.count("*").alias("shared"))
    near = met.select("path", jaccard(F.col("shared"), F.col("size"), F.col("mine")).alias("score")).filter(F.col("score") >= tau)
    own = index.disc.filter(F.col("path") == path).select("stem")  # the stems of one note
    mark = F.broadcast(own.withColumn("own", F.lit(1)))
    sizes = index.disc.join(mark, "stem", "left").groupBy("path").agg(F.count("*").alias("n"), F.count("own").alias("k")).filter("k > 0")
    total = own.agg(F.count("*").alias("m"))
    gated = near.join(sizes, "path").join(F.broadcast(total))  # one row: the note's number of stems
    return gated.select("path", "score", jaccard(F.col("k"), F.col("n"), F.col("m")).alias("overlap")).filter(F.col("overlap") >= BARS.template)


def ranked(rows: DataFrame, limit: int | None, score: Column | None = None) -> DataFrame:
    """rows by falling score, then path."""
    ordered = rows.orderBy((score if score is not None else F.col("score")).desc(), "path")
    return ordered if limit is None else ordered.limit(limit)


def related(index: NoteIndex, path: str, limit: int | None = 20, tau: float = BARS.listed) -> DataFrame:
    """(path, score): the notes nearest to one note."""
    return ranked(related_all(index, path, tau).select("path", "score"), limit)


def rank_within(rows: DataFrame, *by: str) -> DataFrame:
    """rows with rn: the place by falling score, then path, in each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "path")))
