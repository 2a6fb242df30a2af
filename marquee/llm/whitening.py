"""Whitening of integer vectors by a compensated covariance.

1. Entries become integers, x = floor(scale * c). The fit list is each distinct vector once; its size n and sums S are
   exact integers.
2. A task centres its vectors in double-double (x - S/n with the error of the subtraction and the low part of S/n) and
   splits them, by an error-free transformation, into slices of so few bits that a matrix product of two slices over
   one block is exact. These products are added up in double-double, high and low parts, and the parts of all tasks are
   merged the same way, in two steps of bounded width. The driver gets d(d+1)/2 pairs, whatever the number of rows.
3. numpy's ``eigh`` (LAPACK's syevd: reduction to tridiagonal form, then divide and conquer) gives the components.
4. The same sums over the whitened fit list give the error of their covariance against the identity.

Defined results: rows whose vector is null, or holds a null or a number that is not finite, are dropped. The dimension
is the commonest length among distinct vectors (of equals the longer); rows of another length, and empty vectors, are
dropped too. Scaled entries beyond 2^62 are set to that bound. Components without variance (an eigenvalue of at most
d * 2^-52 of the largest) are left out, so a table of one distinct vector, or an empty one, gives no rows. Repeated rows
and null ids give rows each. ``deviation`` is null where it exceeds 38 digits. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, releasing, saved

#: Vectors in one exact matrix product, the bits of a slice that keep it exact, and slices of a vector.
BLOCK = 2048
SLICE_BITS = (55 - (BLOCK - 1).bit_length()) // 2
SLICES = 5
#: Tasks that merge the parts of all others before the last one does.
MERGERS = 64
BOUND = float(1 << 62)


# ---------------------------------------------------------------- double-double


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(high: np.ndarray, low: np.ndarray, more: np.ndarray, less: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of (high, low) and (more, less)."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, less + np.zeros_like(low))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """(high, low), column by column, as a sum of matrices of SLICE_BITS bits, up to what SLICES of them leave over."""
    out = []
    top = np.frexp(np.abs(high).max(axis=0, initial=0.0))[1]
    for _ in range(SLICES):
        sigma = np.ldexp(1.5, top + 53 - SLICE_BITS)
        q = (high + sigma) - sigma
        out.append(q)
        high, low = two_sum(high - q, low)
        top = top - SLICE_BITS
    return out


def moments(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over at most BLOCK rows of the outer products of (high, low), in double-double."""
    parts = slices(high, low)
    total = less = np.zeros((high.shape[1], high.shape[1]))
    for order in range(SLICES - 1, -1, -1):  # small terms first
        for i in range(order + 1):
            total, less = added(total, less, parts[i].T @ parts[order - i])
    return total, less


def _parts(high: float, low: float, n: int) -> Fraction:
    return (Fraction(high) + Fraction(low)) / n


# ---------------------------------------------------------------- Spark


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows whose vectors are whole."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    bounded = lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c.cast("double") * scale))
    named = rows.select(rows[id_column].alias("vec_id"), rows[vector_column].alias("v")).where(v.isNotNull() & (F.size(v) > 0) & finite)
    return named.select("vec_id", F.transform(v, lambda c: F.floor(bounded(c))).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for part, x in _matrices(batches, 0):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "high": [high], "low": [low]})

    parts = fit.select("x").mapInArrow(releasing(run), "n long, high array<long>, low array<long>")
    by_place = parts.select("n", F.posexplode(F.arrays_zip("high", "low"))).groupBy("pos").agg(
        F.sum("n").alias("n"), *(F.sum(F.col(f"col.{c}").cast("decimal(20,0)")).alias(c) for c in ("high", "low"))
    )
    rows = by_place.orderBy("pos").collect()  # one row for each dimension
    return (int(rows[0].n) if rows else 0), [(int(r.high) << 32) + int(r.low) for r in rows]


def _centred(x: np.ndarray, mean: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x - (mean + rest) in double-double."""
    whole = x.astype(np.float64)
    left = np.where(np.abs(whole) < BOUND, x - np.clip(whole, -BOUND, BOUND).astype(np.int64), 0).astype(np.float64)
    high, low = two_sum(whole, -mean)
    return two_sum(high, low + (left - rest))


def _gathered(fit: DataFrame, split: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the fit list of the outer products of what ``split`` makes of its vectors, as high and low parts."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, 0):
            one = moments(*split(x))
            total = added(*total, *one) if total else one
        if total:
            yield row(*total)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                one = tuple(batch.column(k)[i].values.to_numpy() for k in (0, 1))
                total = added(*total, *one) if total else one
        if total:
            yield row(*total)

    def row(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"high": [high.ravel()], "low": [low.ravel()]})

    schema = "high array<double>, low array<double>"
    parts = fit.select("x").mapInArrow(releasing(summed), schema)
    rows = parts.repartition(MERGERS).mapInArrow(merged, schema).repartition(1).mapInArrow(merged, schema).collect()
    d = int(len(rows[0].high) ** 0.5)
    return np.array(rows[0].high).reshape(d, d), np.array(rows[0].low).reshape(d, d)


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors with sums, eigenvalues by size with their components (columns), and how well it whitens."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors whose largest entry is positive; those without variance left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = values > len(values) * 2.0**-52 * max(values[0], 0.0)
    values, vectors = values[keep], vectors[:, keep]
    largest = np.abs(vectors).argmax(axis=0) if len(values) else []
    return values, vectors * np.sign(vectors[largest, np.arange(len(values))])


def fitted(x_rows: DataFrame, components: int = 4) -> Whitening | None:
    """Fits the first components on the distinct vectors of (vec_id, x); None if there are none."""
    fit = saved(x_rows.select("x").distinct(), "fit-list")
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    own = fit.where(F.size("x") == lengths.d)
    n, sums = _sums(own)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    rest = np.array([float(Fraction(s, n) - Fraction(m)) for s, m in zip(sums, mean.tolist(), strict=True)])
    high, low = _gathered(own, lambda x: _centred(x, mean, rest))
    covariance = np.array([[float(_parts(high[i, j], low[i, j], n)) for j in range(lengths.d)] for i in range(lengths.d)])
    covariance = (covariance + covariance.T) / 2
    values, vectors = eigen(covariance)
    values, vectors = values[:components], vectors[:, :components]
    model = Whitening(n, sums, values, vectors, float(np.trace(covariance)), 0.0)
    if len(values):
        model = Whitening(n, sums, values, vectors, model.trace, _identity_error(own, model))
    dropped(fit)
    return model


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity; a column of ones carries the means."""

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.c_[projected(x, model), np.ones(len(x))]
        return w, np.zeros_like(w)

    high, low = _gathered(fit, split)
    k, n = len(model.values), model.n
    part = lambda i, j: _parts(high[i, j], low[i, j], n)
    return max(abs(float(part(i, j) - part(i, k) * part(k, j) - (i == j))) for i in range(k) for j in range(k))


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs where all fit, else as Python's integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """The whitened coordinates of integer vectors."""
    return (_differences(x, model.n, model.sums) / model.n).astype(np.float64) @ model.weights


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row (vec_id, x) and component."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1):
            m = len(x)
            off = (_differences(x, model.n, model.sums) ** 2).sum(axis=1).tolist()
            off = pa.array([v if v < 10**38 else None for v in off], pa.decimal128(38, 0))
            again = np.repeat(np.arange(m), k)
            columns = [
                part.column(0).cast(pa.int64()).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), off.take(pa.array(again)), pa.array(projected(x, model).ravel()),
                pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return rows.where(F.size("x") == len(model.sums)).mapInArrow(releasing(run), schema)
