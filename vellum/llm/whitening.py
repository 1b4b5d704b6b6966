"""Whitening of embeddings from an exact scatter matrix in residue arithmetic.

Entries c become whole numbers x = floor(64 c) + 1000000, so the scatter of x, the sum of x x' over the fit
list, is a matrix of integers far beyond 2^53. Each task takes its rows modulo several primes below 2^20:
centred residues are below 2^19, so a product of two matrices of up to 2^15 rows stays below 2^53 and a
floating-point GEMM is exact. Residues of the sums are added over tasks by Spark, a number for each prime
and entry, and Chinese remaindering gives the integers back; a column of ones carries the sums S and the
number n. From them n^2 V = n sum(x x') - S S' is exact, V is rounded once, and its eigenvectors are taken
in double precision. Only matrices of dims x dims reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows of one product, and the bound below which the primes lie.
ROWS, BOUND = 1 << 15, 1 << 20
#: Entries of 64 c beyond this count as this.
FAR = float(1 << 62)


def valid(vector: Column) -> Column:
    """Not null, no null and no non-finite entry."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def whole(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """The rows x of valid vectors; entries that a short vector lacks are those of zero."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(sizes), dims), SHIFT, np.int64)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * flat), -FAR, FAR).astype(np.int64) + SHIFT
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x
    return out


def fit_list(rows: DataFrame, vector_col: str, dims: int) -> DataFrame:
    """(x binary, top long): each distinct row of whole numbers once, in the narrowest of two widths, and its greatest absolute entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b.column(0), dims)
            top = np.abs(x).max(axis=1)
            narrow = [r.tobytes() for r in x.astype(np.int32)]
            raw = [n if t < 2**31 else r.tobytes() for r, n, t in zip(x, narrow, top.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(top)], ["x", "top"])

    return rows.select(vector_col).mapInArrow(run, "x binary, top long").distinct()


def unpacked(raw: list[bytes], dims: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.int32 if len(r) == 4 * dims else np.int64).astype(np.int64) for r in raw])


def primes(bound: int) -> list[int]:
    """The largest primes below BOUND, as many as it takes for their product to pass bound."""
    out, p, product = [], BOUND, 1
    while product <= bound:
        p -= 1
        while any(p % q == 0 for q in range(2, int(p**0.5) + 1)):
            p -= 1
        out.append(p)
        product *= p
    return out


def added_by_cell(rows: DataFrame, matrices, kind: str) -> dict[tuple[int, int], float]:
    """The sums over all tasks of what matrices(batches) yields once per task: (group, flat values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, values in matrices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), group, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["group", "cell", "v"])

    sums = rows.mapInArrow(run, f"group int, cell int, v {kind}").groupBy("group", "cell").agg(F.sum("v").alias("v"))
    return {(r["group"], r["cell"]): r["v"] for r in sums.collect()}  # groups times cells, not rows


def scatter(fit: DataFrame, dims: int, moduli: list[int]) -> list[list[int]]:
    """The exact sum of y y' over the fit list, y being x with a one behind it."""
    upper = np.triu_indices(dims + 1)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros((len(moduli), len(upper[0])), np.int64)
        for b in batches:
            raw = b.column(0).to_pylist()
            for lo in range(0, len(raw), ROWS):
                x = unpacked(raw[lo : lo + ROWS], dims)
                y = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
                for k, p in enumerate(moduli):
                    r = ((y + p // 2) % p - p // 2).astype(np.float64)
                    total[k] = (total[k] + (r.T @ r)[upper].astype(np.int64)) % p
        yield from enumerate(total)

    sums = added_by_cell(fit.select("x"), matrices, "long")
    product = 1
    for p in moduli:
        product *= p
    parts = [(product // p) * pow(product // p, -1, p) for p in moduli]
    out = [[0] * (dims + 1) for _ in range(dims + 1)]
    for cell, (i, j) in enumerate(zip(*(u.tolist() for u in upper), strict=True)):
        v = sum(sums[k, cell] % p * parts[k] for k, p in enumerate(moduli)) % product
        out[i][j] = out[j][i] = v - product if 2 * v > product else v
    return out


def fitted(fit: DataFrame, dims: int, components: int) -> dict | None:
    """n, S, the components as columns, their eigenvalues, explained shares and identity_error; None for an empty list."""
    size = fit.agg(F.count("*").alias("n"), F.max("top").alias("top")).first()
    n = size["n"]
    if not n:
        return None
    sums = scatter(fit, dims, primes(2 * n * max(1, size["top"]) ** 2))
    s = [sums[i][dims] for i in range(dims)]
    spread = [[n * sums[i][j] - s[i] * s[j] for j in range(dims)] for i in range(dims)]
    # whole numbers divide to the nearest double
    values, vectors = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in spread]))
    order = np.argsort(-values, kind="stable")[:components]
    e, u = values[order], vectors[:, order]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    live = e > max(0.0, values.max()) * dims * np.finfo(float).eps
    trace = sum(spread[i][i] for i in range(dims)) / (n * n)
    share = np.where(live, e, 0.0) / trace if trace else np.full(len(e), np.nan)
    model = {"n": n, "s": s, "axes": u / np.sqrt(np.where(live, e, np.nan)), "live": live, "explained": share}
    model["identity_error"] = identity_error(fit, dims, model)
    return model


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S, exact: int64 where that is wide enough, else Python integers."""
    if n * max(1, int(np.abs(x).max(initial=0))) < 2**61 and max(map(abs, s)) < 2**61:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def projected(x: np.ndarray, model: dict) -> np.ndarray:
    return (centred(x, model["n"], model["s"]) / model["n"]).astype(np.float64) @ model["axes"]


def identity_error(fit: DataFrame, dims: int, model: dict) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, over components with variance."""
    k = int(model["live"].sum())
    if not k:
        return None
    upper = np.triu_indices(k + 1)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros(len(upper[0]))
        for b in batches:
            if b.num_rows:
                w = projected(unpacked(b.column(0).to_pylist(), dims), model)[:, model["live"]]
                w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
                total += (w.T @ w)[upper]
        yield 0, total

    sums = added_by_cell(fit.select("x"), matrices, "double")
    full = np.zeros((k + 1, k + 1))
    full[upper] = [sums[0, c] for c in range(len(upper[0]))]
    mean = full[:k, k] / model["n"]  # of values centred already
    cov = np.triu(full[:k, :k]) / model["n"] - np.triu(np.outer(mean, mean))
    return float(np.abs(cov - np.eye(k)).max())


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each valid row and component.

    Rows whose vector is null or holds a null or non-finite entry go; a null or repeated id is an id like
    any other. Of vectors of different lengths the missing entries count as zero. The fit list holds each
    distinct vector of whole numbers once. A component without variance (up to rounding) has no whitened
    value, is null, and explains 0; identity_error is over the others. Components are those of the
    dimensions if these are fewer. A deviation beyond a long is null; 64 c beyond 2^62 counts as 2^62.
    No valid row: no row. Only the two columns named are read, so others may have any name.
    """
    good = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).filter(valid(F.col("_v")))
    dims = good.agg(F.max(F.size("_v")).alias("d")).first()["d"] or 0
    model = fitted(written(fit_list(good, "_v", dims), "fit-list"), dims, components) if dims else None
    id_type = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model["live"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = whole(b.column(1), dims)
            d = centred(x, model["n"], model["s"])
            narrow = d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * dims < 2**63
            deviation = (d * d).sum(axis=1) if narrow else (d.astype(object) ** 2).sum(axis=1)
            deviation = [v if v < 2**63 else None for v in deviation.tolist()]
            every = np.repeat(np.arange(b.num_rows), k)
            tiled = lambda v: pa.array(np.tile(v, b.num_rows), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(every)),
                    tiled(np.arange(1, k + 1, dtype=np.int32)),
                    pa.array(np.full(len(every), model["n"], np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(every)),
                    pa.array(projected(x, model).ravel(), from_pandas=True),
                    tiled(model["explained"]),
                    pa.array([model["identity_error"]] * len(every), pa.float64()),
                ],
                names,
            )

    return good.mapInArrow(run, schema)
