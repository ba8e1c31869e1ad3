"""Whitening of embeddings from an exact scatter matrix (operator 13).

Entries become whole numbers. Each task multiplies its rows, reduced modulo several primes,
by themselves in floating point, where all sums stay exact; residues are summed over tasks,
and Chinese remaindering gives the whole-number scatter. Only its eigenvectors are inexact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Primes are under 2 ** 20, so sums over so many rows of products of residues stay under 2 ** 53.
PRIME_BITS, ROWS_A_PRODUCT = 20, 4096
#: Whole numbers are held to this range.
MOST = 1 << 62
#: Rows of the matrix that travel together, and eigenvalues, in shares of the sum, that count as 0.
BAND, FLAT = 64, 1e-12


def primes(bound: int) -> list[int]:
    """The largest primes under 2 ** 20, as many as make a product over ``bound``."""
    found: list[int] = []
    at = (1 << PRIME_BITS) - 1
    while prod(found) <= bound:
        if all(at % k for k in range(3, 1 << (PRIME_BITS // 2), 2)):
            found.append(at)
        at -= 2
    return found


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of doubles, held to +-2 ** 62."""
    return np.clip(np.floor(values * float(SCALE)), -float(MOST // 2), float(MOST // 2)).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows' whole numbers, a row a vector."""
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows whose vector is not null or empty and holds finite numbers only."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter("size(v) > 0").filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def _residues(dim: int, moduli: list[int]):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = {p: np.zeros((dim + 1, dim + 1), dtype=np.int64) for p in moduli}
        for batch in batches:
            for at in range(0, len(batch), ROWS_A_PRODUCT):
                x = _matrix(batch.column("v").slice(at, ROWS_A_PRODUCT), dim)
                x = np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1)
                for p in moduli:
                    r = np.mod(x, p).astype(np.float64)
                    sums[p] = (sums[p] + (r.T @ r).astype(np.int64)) % p
        task = TaskContext.get().partitionId()
        found = [(p, band, sums[p][band : band + BAND].tobytes()) for p in moduli for band in range(0, dim + 1, BAND)]
        ps, bands, blobs = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(bands, pa.int32()), pa.array([task] * len(ps), pa.int32()), pa.array(blobs, pa.binary())], ["prime", "band", "task", "residues"])

    return multiply


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, band, task = None, 0, 0
    for batch in batches:
        names = batch.schema.names
        for blob in batch.column(names.index("residues")):
            row = np.frombuffer(blob.as_py(), dtype=np.int64)
            total = row if total is None else (total + row) % key[0].as_py()
        band, task = batch.column(names.index("band"))[0].as_py(), batch.column(names.index("task"))[0].as_py()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([band], pa.int32()), pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["prime", "band", "task", "residues"])


_SUMS = "prime long, band int, task int, residues binary"


def scatter(rows: DataFrame, dim: int, bound: int) -> list[list[int]]:
    """Exact sums of products of all pairs of dimensions of ``rows (v)``, a dimension of ones behind the others; none may exceed ``bound``.

    Only residue matrices, whose size the dimension bounds, reach the driver. Tasks' matrices are
    added up in two steps, some hundred in each.
    """
    moduli = primes(2 * bound + 1)
    parts = rows.select("v").mapInArrow(_residues(dim, moduli), _SUMS)
    parts = parts.groupBy("prime", "band", F.expr("task div 64")).applyInArrow(_added, _SUMS)
    parts = parts.groupBy("prime", "band").applyInArrow(_added, _SUMS)
    every = {(r.prime, r.band): np.frombuffer(r.residues, dtype=np.int64).reshape(-1, dim + 1) for r in parts.collect()}
    if not every:
        return [[0] * (dim + 1) for _ in range(dim + 1)]
    whole = prod(moduli)
    weights = [whole // p * pow(whole // p, -1, p) for p in moduli]
    stacked = [np.concatenate([every[p, band] for band in range(0, dim + 1, BAND)]) for p in moduli]
    out = [[0] * (dim + 1) for _ in range(dim + 1)]
    for i in range(dim + 1):
        for j in range(i, dim + 1):
            x = sum(int(m[i, j]) * w for m, w in zip(stacked, weights, strict=True)) % whole
            out[i][j] = out[j][i] = x - whole if x > whole // 2 else x
    return out


class Fit:
    """Exact count and sums, covariance rounded once, and its leading eigenvectors."""

    def __init__(self, sums: list[list[int]], components: int = COMPONENTS):
        dim = len(sums) - 1
        self.n, self.sums = sums[dim][dim], [sums[i][dim] for i in range(dim)]
        square = max(self.n, 1) ** 2
        cov = np.array([[(self.n * sums[i][j] - self.sums[i] * self.sums[j]) / square for j in range(dim)] for i in range(dim)])
        values, vectors = np.linalg.eigh(cov)
        self.trace = float(sum(self.n * sums[i][i] - self.sums[i] ** 2 for i in range(dim)) / square)
        lead = np.argsort(values)[::-1][: min(components, dim)]
        values = np.maximum(values[lead], 0.0)
        self.flat = values <= FLAT * self.trace
        self.explained = [float(e / self.trace) if self.trace else None for e in values]
        self.scaled = np.where(self.flat, 0.0, vectors[:, lead] / np.sqrt(np.where(self.flat, 1.0, values)))


def _projected(fit: Fit, dim: int):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(fit.sums, dtype=object)
        small = max(map(abs, fit.sums)) < 1 << 62
        for batch in batches:
            for at in range(0, len(batch), ROWS_A_PRODUCT):
                piece = batch.slice(at, ROWS_A_PRODUCT)
                x = _matrix(piece.column("v"), dim)
                if not len(x):
                    continue
                exact = small and fit.n * int(np.abs(x).max()) < 1 << 62
                away = fit.n * x - sums.astype(np.int64) if exact else fit.n * x.astype(object) - sums
                if exact and dim * int(np.abs(away).max()) ** 2 < 1 << 63:
                    deviation = pa.array((away * away).sum(axis=1), pa.int64())
                else:
                    squares = (away.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(s) if s < 1 << 63 else None for s in squares], pa.int64())
                white = (away / fit.n).astype(np.float64) @ fit.scaled
                size = white.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * size, pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), deviation, lists], ["vec_id", "deviation", "white"])

    return project


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each vector and leading component.

    Vectors that are null, empty, hold a null or a number that is not finite, or are not of the
    commonest length (ties: the longest) take no part; null and repeated ids do, row by row.
    Whole numbers beyond +-2 ** 61 are held there. ``deviation`` is null where it exceeds a
    long. A component whose eigenvalue is 0 has ``whitened`` 0 and no share in
    ``identity_error``; ``explained`` is null if all vectors are equal. A table without usable
    vectors gives no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"))
    found = lengths.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not found:
        return rows.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error"))).limit(0)
    dim, count, most = found[0]
    same = rows.filter(F.size("v") == dim)
    largest = int(min(most * SCALE, float(MOST))) + OFFSET + 1
    fit = Fit(scatter(same, dim, count * largest**2), components)
    wide = same.mapInArrow(_projected(fit, dim), "vec_id long, deviation long, white array<double>")
    live = [k for k in range(min(components, dim)) if not fit.flat[k]]
    away = [F.abs(F.covar_pop(F.col("white")[i], F.col("white")[j]) - float(i == j)) for i in live for j in live if i <= j]
    error = wide.agg((F.greatest(F.lit(0.0), *away) if away else F.lit(0.0)).alias("identity_error"))
    long = wide.select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened"))
    shares = F.array(*(F.lit(e).cast("double") for e in fit.explained))
    named = long.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("k") + 1).alias("explained"))
    return named.crossJoin(F.broadcast(error))  # one row
