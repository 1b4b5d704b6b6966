"""Exact top-k inner products by columnar branch and bound.

Vectors are packed into blocks of integer matrices, one row per dimension (vertical layout). Blocks of
candidates are dealt to cells once and stay there; blocks of queries, far fewer, go to every cell and are
joined by the cell's number. A stated query set against all rows, in blocks: what is moved grows with
queries times cells, not with pairs, and candidates are moved once.

A query block meets the blocks of a cell one after the other and keeps, for each query, the k-th best
score so far, its floor. A candidate block goes whole if the product of norms cannot reach any floor.
Else scores are accumulated group of dimensions by group; after each, a candidate is compacted away if for
none of the queries its score so far plus the product of the remaining norms can reach the floor; a slice
of candidates is done before the next, so that floors rise. The bounds are rounded up. Scores are exact:
products that might pass 2^53 are summed as Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import parallelism, written

#: Vectors of a block; blocks of a cell; queries and candidates that are scored together; dimensions of a group.
BLOCK, CELL, QUERIES, SLICE, GROUP = 4096, 64, 256, 1024, 16
LONG = 2**63 - 1

_BLOCKS = "block long, n long, dims long, ids binary, vectors binary"


def packed(rows: DataFrame, id_col: str, vector_col: str, scale: int, block: int) -> DataFrame:
    """(block, n, dims, ids, vectors): up to `block` valid vectors of a partition, floor(scale * x), dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def pack(part):
            nonlocal number
            dims = max(len(v) for _, v in part)
            matrix = np.zeros((dims, len(part)), np.float64)
            for i, (_, v) in enumerate(part):
                matrix[: len(v), i] = v
            number += 1
            return pa.RecordBatch.from_pylist([{"block": number, "n": len(part), "dims": dims, "ids": np.array([i for i, _ in part], np.int64).tobytes(), "vectors": matrix.astype(np.int32 if np.abs(matrix).max(initial=0) < 2**31 else np.float64).tobytes()}], pa.schema([("block", pa.int64()), ("n", pa.int64()), ("dims", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for b in batches:
            values = b.column(1)
            nulls = values.flatten().is_null().to_numpy(zero_copy_only=False)
            flat = np.floor(scale * values.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            for i, (key, valid) in enumerate(zip(b.column(0).to_pylist(), values.is_valid().to_pylist(), strict=True)):
                lo, hi = int(ends[i - 1]) if i else 0, int(ends[i])
                if key is None or not valid or nulls[lo:hi].any() or not np.isfinite(flat[lo:hi]).all():
                    continue
                held.append((key, flat[lo:hi]))
                if len(held) == block:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return rows.select(id_col, vector_col).mapInArrow(run, _BLOCKS)


def unpacked(raw: bytes, dims: int, n: int) -> np.ndarray:
    kind = np.int32 if len(raw) == 4 * dims * n else np.float64
    return np.frombuffer(raw, kind).reshape(dims, n).astype(np.float64)


class Asked:
    """A block of queries on its way through candidate blocks: each query's best so far and its floor."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.floor = np.full(len(ids), -np.inf)
        self.got = [(np.zeros(0, np.int64),) * 3 for _ in range(0, len(ids), QUERIES)]  # (row, candidate, score)
        self.norms = np.sqrt((vectors * vectors).sum(axis=0))

    def keep(self, part: int, lo: int, n: int, r: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes new (row, candidate, score) of a slice of queries in and raises their floors."""
        rows = tuple(np.concatenate(x) for x in zip(self.got[part], (r, ids, scores), strict=True))
        order = np.lexsort((rows[1], -rows[2], rows[0]))
        r, ids, scores = (x[order] for x in rows)
        start = np.searchsorted(r, np.arange(n))
        stay = np.arange(len(r)) - start[r] < self.k
        r, ids, scores = self.got[part] = r[stay], ids[stay], scores[stay]
        count = np.bincount(r, minlength=n)
        full = count >= self.k
        self.floor[lo : lo + n][full] = scores[(np.cumsum(count) - 1)[full]]

    def meet(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        """Scores a block of candidates, one row per dimension, where it can reach a floor."""
        if not len(c_ids) or not len(self.ids):
            return
        dims = max(len(self.q), len(c))
        q, c = (np.pad(m, ((0, dims - len(m)), (0, 0))) for m in (self.q, c))
        if dims * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) >= 2.0**53:
            return self.exactly(c_ids, q, c)
        mass = np.sqrt((c * c).sum(axis=0))
        if (self.norms * mass.max() * (1 + 1e-9) + 1e-6 < self.floor).all():
            return None
        heavy = np.argsort(-(c * c).sum(axis=1), kind="stable")  # dimensions with most mass first
        by_norm = np.argsort(-mass, kind="stable")
        q, c, c_ids = q[heavy], c[heavy][:, by_norm], c_ids[by_norm]
        cuts = [*range(0, dims, GROUP), dims]
        rest = lambda m: [np.sqrt((m[at:] ** 2).sum(axis=0)) for at in cuts[1:]]
        c_rest = rest(c)
        for part, lo in enumerate(range(0, q.shape[1], QUERIES)):
            qs, ids, floor = q[:, lo : lo + QUERIES], self.ids[lo : lo + QUERIES], self.floor[lo : lo + QUERIES]
            q_rest = rest(qs)
            for at in range(0, c.shape[1], SLICE):
                live = np.arange(at, min(at + SLICE, c.shape[1]))
                score = np.zeros((len(ids), len(live)))
                for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    score += qs[a:b].T @ c[a:b, live]
                    if b < dims:
                        reach = (score + np.outer(q_rest[g], c_rest[g][live]) * (1 + 1e-9) + 1e-6 >= floor[:, None]).any(axis=0)
                        if not reach.all():
                            live, score = live[reach], score[:, reach]
                r, col = np.nonzero((score >= floor[:, None]) & (ids[:, None] != c_ids[live][None, :]))
                self.keep(part, lo, len(ids), r, c_ids[live[col]], score[r, col].astype(np.int64))
        return None

    def exactly(self, c_ids: np.ndarray, q: np.ndarray, c: np.ndarray) -> None:
        """meet() with Python integers; a score beyond a long counts as the greatest or least long."""
        whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
        q, c = whole(q), whole(c)
        for part, lo in enumerate(range(0, q.shape[1], QUERIES)):
            ids = self.ids[lo : lo + QUERIES]
            score = np.array([[max(-LONG - 1, min(LONG, int(x))) for x in row] for row in q[:, lo : lo + QUERIES].T @ c], np.int64).reshape(len(ids), len(c_ids))
            r, col = np.nonzero(ids[:, None] != c_ids[None, :])
            self.keep(part, lo, len(ids), r, c_ids[col], score[r, col])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, candidate id, score) of the best."""
        found = [(self.ids[lo + r], i, s) for lo, (r, i, s) in zip(range(0, len(self.ids), QUERIES), self.got, strict=True)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best candidates; q and c have one row per dimension."""
    asked = Asked(q_ids, q, k)
    asked.meet(c_ids, c)
    return asked.result()


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k highest integer inner products of each query with all rows but its own.

    A component x counts as floor(scale * x), x as double. Ties go to the smaller id; a query has fewer
    rows if there are fewer candidates. Vectors that are null or hold a null or non-finite component, and
    rows without id, take no part. Of vectors of different lengths the missing components count as zero.
    A row is its query's own if the ids are equal. A candidate id that repeats gives its rows one by one,
    a query id that repeats asks once, with its greatest vector. A score beyond a long is cut to its range.
    """
    once = queries.groupBy(id_col).agg(F.max(vector_col).alias(vector_col))
    asked = written(packed(once, id_col, vector_col, scale, block), "queries")
    given = written(packed(rows, id_col, vector_col, scale, block), "candidates")
    blocks = given.count()
    cells = max(1, min(blocks, max(parallelism(rows.sparkSession), -(-blocks // CELL))))
    # both sides are dealt by cell, and AQE must not put these small, slow parts together
    given = given.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")).repartition(cells, "cell")
    asked = asked.select(F.col("block").alias("asked"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("dims").alias("q_dims"))
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).repartition(cells, "cell")
    # a merge join streams its left side: a query block meets all blocks of its cell in a row
    pairs = asked.hint("merge").join(given, "cell").select("cell", "asked", "q_ids", "q_vectors", "q_dims", "ids", "vectors", "dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        send = lambda a: pa.RecordBatch.from_arrays([pa.array(x) for x in a.result()], ["query_id", id_col, "score"])
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names) if not name.startswith("q_")}
                if (r["cell"], r["asked"]) != at:
                    if now is not None:
                        yield send(now)
                    at, ids = (r["cell"], r["asked"]), np.frombuffer(b.column(2)[i].as_py(), np.int64)
                    now = Asked(ids, unpacked(b.column(3)[i].as_py(), b.column(4)[i].as_py(), len(ids)), k)
                c_ids = np.frombuffer(r["ids"], np.int64)
                now.meet(c_ids, unpacked(r["vectors"], r["dims"], len(c_ids)))
        if now is not None:
            yield send(now)

    found = pairs.mapInArrow(run, f"query_id long, {id_col} long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col)))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
