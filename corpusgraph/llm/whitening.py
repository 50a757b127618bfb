"""Embedding whitening with covariances by polarisation.

1. *Entries.* A vector's entry c becomes the long floor(64 * c) + 1,000,000. Each distinct integer vector is one row of the
   fit list, written once; ``n`` and the sums S of the dimensions are exact.
2. *Squares.* y = x - floor(S / n) is centred to less than one unit. One pass over the fit list adds up, exactly, y_i^2 for
   every dimension and (y_i + y_j)^2 for every pair, as integers: d (d + 1) / 2 numbers whatever the rows. What floor left
   over is put back exactly, so these are the squares of n * x - S without rounding.
3. *Polarisation.* cov(i, j) = (Var(i + j) - Var(i) - Var(j)) / 2 on exact integers, rounded once. The matrix is
   assembled for ``eigh``; components are numbered by falling eigenvalue.
4. *Whitening* maps each row on the first components; a pass over the fit list measures the whitened covariance.

Sums and the matrix (d x d) are all that reaches the driver. Integers that 64 bits can't hold go through Python's.

Defined results: a null vector, or one with null or non-finite entries, is dropped. So is one whose length is not the table's
commonest (the longer of equally common ones), since it has no place in the covariance. Rows with a null or repeated id stay;
equal vectors count once in the fit and get equal results. Components without variance (an eigenvalue below 1e-12 of the
largest) are left out; a table of one distinct vector or none gives no rows. A deviation beyond 64 bits is null. An entry
beyond 2^53 / 64 is taken as that bound. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE, SHIFT = 64, 1_000_000
#: Rows of a batch that a worker works on at a time.
ROWS = 4096
_BOUND = float(2**53)
_FLAT = 1e-12


def integer_vectors(table: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``x`` of the rows whose vectors are whole."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def entry(c):
        scaled = F.greatest(F.lit(-_BOUND), F.least(F.lit(_BOUND), c.cast("double") * SCALE))
        return F.floor(scaled).cast("bigint") + SHIFT

    return table.filter(whole).select(*columns, F.transform("embedding", entry).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, len(batch), ROWS):
            part = batch.slice(low, ROWS)
            yield part, part.column(column).flatten().to_numpy().reshape(-1, d)


def _exact(values: np.ndarray, factor: int) -> np.ndarray:
    """The same integers, as Python's where ``factor`` times a product of two would pass 64 bits."""
    largest = max(abs(int(values.max())), abs(int(values.min())), 1) if values.size else 1
    return values if factor * largest * largest < 2**63 else values.astype(object)


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Sums over the rows of (y_i + y_j)^2 for i < j, and of y_i^2 for i = j, row by row of the upper triangle."""
    y = _exact(y, 4 * max(1, len(y)))
    found = []
    for i in range(y.shape[1]):
        pairs = y[:, i:] + y[:, i: i + 1]
        pairs[:, 0] = y[:, i]
        found.append((pairs * pairs).sum(axis=0) if y.dtype == object else np.einsum("ij,ij->j", pairs, pairs))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Whitening:
    """``n`` rows of the fit list, sums of their dimensions, eigenvalues and unit components (columns), total variance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    total: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of integer vectors; the centre is taken off in integers first."""
        middle = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - middle).astype(float) - rest) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exact."""
        middle = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        y = x - middle
        largest = max(abs(int(y.max())), abs(int(y.min())), 1) if y.size else 1
        if len(self.sums) * (self.n * (largest + 1)) ** 2 < 2**63:
            z = self.n * y - rest
            return np.einsum("ij,ij->i", z, z).tolist()
        z = y.astype(object) * self.n - rest.astype(object)
        return [int(s) if s < 2**63 else None for s in (z * z).sum(axis=1)]


def covariance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """The covariance matrix from exact sums: squares of y = x - floor(S / n), as ``pair_squares`` orders them."""
    d = len(sums)
    rest = [s % n for s in sums]

    def centred(square: int, left: int) -> int:
        # n * y - left summed over the rows, squared: sum(y) is exactly ``left``.
        return n * n * square - n * left * left

    own, both, at = [0] * d, {}, 0
    for i in range(d):
        for j in range(i, d):
            if i == j:
                own[i] = centred(squares[at], rest[i])
            else:
                both[i, j] = centred(squares[at], rest[i] + rest[j])
            at += 1
    matrix = np.zeros((d, d))
    for i in range(d):
        matrix[i, i] = own[i] / n**3
    for (i, j), square in both.items():
        matrix[i, j] = matrix[j, i] = (square - own[i] - own[j]) / (2 * n**3)
    return matrix


def _fit_list(scratch: Scratch, vectors: DataFrame) -> tuple[DataFrame, int]:
    """Distinct vectors of the commonest length, and that length (0 for an empty table)."""
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    d = common.d if common else 0
    return scratch.table(vectors.select("x").filter(F.size("x") == d).distinct()), d


def fit_whitening(scratch: Scratch, listed: DataFrame, d: int, k: int) -> Whitening | None:
    """Fit on the distinct integer vectors ``x`` of length ``d``; None without any variance."""
    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _matrices(batches, "x", d):
            n += len(x)
            part = x if len(x) * int(max(abs(int(x.max())), abs(int(x.min())))) < 2**63 else x.astype(object)
            total = [a + int(b) for a, b in zip(total, part.sum(axis=0))]
        yield _numbered([n, *total])

    counted = _added(listed.mapInArrow(sums_of, "place int, value string")) if d else [0]
    n, sums = counted[0], counted[1:]
    if n < 2:
        return None
    middle = np.array([s // n for s in sums], np.int64)

    def squares_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, "x", d):
            part = pair_squares(x - middle)
            total = part.astype(object) if total is None else total + part
        if total is not None:
            yield _numbered([int(v) for v in total])

    matrix = covariance(n, sums, _added(listed.mapInArrow(squares_of, "place int, value string")))
    values, components = np.linalg.eigh(matrix)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    kept = int((values > max(values[0], 0) * _FLAT).sum()) if len(values) else 0
    if not kept:
        return None
    return Whitening(n, tuple(sums), values[:kept].copy(), np.ascontiguousarray(components[:, :kept]), float(np.trace(matrix)))


def _numbered(values: list[int]) -> pa.RecordBatch:
    return pa.record_batch({"place": pa.array(range(len(values)), pa.int32()), "value": pa.array([str(v) for v in values])})


def _added(parts: DataFrame) -> list[int]:
    """Sums of the tasks' exact integers by place; as many rows as places reach the driver."""
    total = F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")
    return [int(r.value) for r in parts.groupBy("place").agg(total).orderBy("place").collect()]


def identity_error(listed: DataFrame, d: int, fit: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(fit.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for _, x in _matrices(batches, "x", d):
            w = fit.project(x)
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.record_batch({"place": pa.array(range(len(total)), pa.int32()), "value": pa.array(total)})

    rows = listed.mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    sums = np.array([r.value for r in rows.orderBy("place").collect()])
    mean, products = sums[:k] / fit.n, sums[k:].reshape(k, k) / fit.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, k: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of the first ``k`` components."""
    scratch = Scratch(table.sparkSession, "whitening")
    vectors = integer_vectors(table, ["vec_id"])
    listed, d = _fit_list(scratch, vectors)
    fit = fit_whitening(scratch, listed, d, k)
    schema = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    if fit is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(listed, d, fit)
    kept = len(fit.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component = np.arange(1, kept + 1, dtype=np.int32)
        explained = fit.values / fit.total
        for part, x in _matrices(batches, "x", d):
            each = pa.array(np.repeat(np.arange(len(x)), kept))
            size = len(x) * kept
            yield pa.record_batch({
                "vec_id": part.column("vec_id").take(each),
                "component": pa.array(np.tile(component, len(x))),
                "n": pa.array(np.full(size, fit.n)),
                "deviation": pa.array(fit.deviations(x), pa.int64()).take(each),
                "whitened": pa.array(fit.project(x).ravel()),
                "explained": pa.array(np.tile(explained, len(x))),
                "identity_error": pa.array(np.full(size, error)),
            })

    whole = vectors.filter(F.size("x") == d).select(F.col("vec_id").cast("bigint"), "x")
    return whole.mapInArrow(rows, schema)
