"""Whitening of embeddings along their leading principal components, found by slicing the covariance's spectrum.

The covariance is summed up by Spark; its eigenvectors are found on the driver, whose work depends on the number of
dimensions only.  By Sylvester's law the LDLᵀ factors of V - sI have as many positive eigenvalues as V has beyond s.  Such
counts halve intervals until one holds a single eigenvalue, Rayleigh quotient iteration converges to it from there, and
two more counts certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, stash
from .topk_search import _matrix, quantised

#: Rows that are multiplied together.
BLOCK_ROWS = 4096


def positive_pivots(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix, counted on the blocks of its LDLᵀ factors (Bunch and Parlett's pivots)."""
    a, count, ratio = a.astype(np.float64), 0, (1 + 17**0.5) / 8
    while len(a):
        off, diagonal = np.abs(a), np.abs(np.diag(a))
        np.fill_diagonal(off, 0)
        i, j = np.unravel_index(np.argmax(off), off.shape)
        p = int(np.argmax(diagonal))
        if not max(off[i, j], diagonal[p]):
            break  # all that is left is zero
        block = [p] if diagonal[p] >= ratio * off[i, j] else [i, j]
        rest = np.setdiff1d(np.arange(len(a)), block)
        d, side = a[np.ix_(block, block)], a[np.ix_(rest, block)]
        # a block of two has one positive and one negative eigenvalue
        count += 1 if len(block) == 2 else int(d[0, 0] > 0)
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(d, side.T)
        a = (a + a.T) / 2
    return count


class Slicer:
    """The leading eigenpairs of a symmetric positive semidefinite matrix, one after another."""

    def __init__(self, v: np.ndarray):
        self.v, self.vectors = v, np.zeros((len(v), 0))
        self.top = float(np.abs(v).sum(1).max(initial=0))  # no eigenvalue is larger (Gershgorin)
        self.tiny = 4 * np.finfo(np.float64).eps * max(len(v), 1) * self.top
        self.counts: dict[float, int] = {}

    def above(self, s: float) -> int:
        """Eigenvalues larger than s."""
        if s not in self.counts:
            self.counts[s] = positive_pivots(self.v - s * np.eye(len(self.v)))
        return self.counts[s]

    def _interval(self, number: int) -> tuple[float, float]:
        """An interval with the eigenvalue of that number alone, or one too narrow to be halved, which holds a multiple one."""
        low = max([s for s, n in self.counts.items() if n >= number], default=-self.tiny)
        high = min([s for s, n in self.counts.items() if n < number], default=self.top + self.tiny)
        while self.above(low) - self.above(high) > 1 and high - low > self.tiny:
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= number else (low, middle)
        return low, high

    def _free(self, x: np.ndarray) -> np.ndarray:
        """A unit vector without what lies along the vectors found before."""
        for _ in range(2):
            x = x - self.vectors @ (self.vectors.T @ x)
        return x / np.linalg.norm(x)

    def _solved(self, s: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0.0, self.tiny, -2 * self.tiny):
            try:
                y = np.linalg.solve(self.v - (s + nudge) * np.eye(len(self.v)), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all():
                return self._free(y)
        return x

    def next(self) -> tuple[float, np.ndarray] | None:
        """The next eigenvalue and unit vector, the largest entry positive; None once eigenvalues are zero."""
        number = self.vectors.shape[1] + 1
        if number > len(self.v) or self.above(self.tiny * 8) < number:
            return None
        while True:
            low, high = self._interval(number)
            x = self._free(np.random.default_rng(number).standard_normal(len(self.v)))
            for _ in range(3):
                x = self._solved((low + high) / 2, x)
            value, residual = float(x @ self.v @ x), np.inf
            for _ in range(12):
                x2 = self._solved(value, x)
                value2 = float(x2 @ self.v @ x2)
                residual2 = float(np.linalg.norm(self.v @ x2 - value2 * x2))
                if residual2 >= residual:
                    break
                x, value, residual = x2, value2, residual2
            near = max(residual, self.tiny)
            # certified: fewer than ``number`` eigenvalues lie beyond, at least as many with it
            if residual <= 64 * self.tiny and self.above(value + 2 * near) < number <= self.above(value - 2 * near):
                break
            if high - low <= self.tiny:
                raise ArithmeticError(f"eigenvalue {number} can't be certified")
            middle = (low + high) / 2  # it ran to a neighbour: start closer
            self.above(middle)
        x = x * np.sign(x[np.argmax(np.abs(x))])
        self.vectors = np.column_stack([self.vectors, x])
        return value, x


def _summed(rows: DataFrame, name: str, of, width: int) -> np.ndarray:
    """The sum over all rows of a matrix of ``width`` columns that ``of`` makes of blocks of ``name``; tasks give one each, added up by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                own = of(batch.column(0).slice(at, BLOCK_ROWS))
                total = own if total is None else total + own
        if total is not None:
            kind = pa.list_(pa.int64() if total.dtype == np.int64 else pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), kind)], ["i", "v"])

    kind = "long" if of(pa.array([], pa.list_(pa.int64()))).dtype == np.int64 else "double"
    parts = rows.select(name).mapInArrow(run, f"i int, v array<{kind}>")
    sums = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(str(j)) for j in range(width)])
    return np.array([r[1:] for r in sorted(sums.collect())])


class Whitening:
    """What is fitted: n distinct vectors, their sums, the eigenvalues and vectors of their covariance, its trace, and the identity error."""

    def __init__(self, n: int, sums: np.ndarray, trace: float, values: np.ndarray, vectors: np.ndarray, error: float = 0.0):
        self.n, self.sums, self.trace, self.values, self.vectors, self.error = n, sums, trace, values, vectors, error

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double, rounded once: n * x - S is exact."""
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S, exact; None beyond 64 bits."""
        apart = self.n * x - self.sums
        rough = (apart.astype(np.float64) ** 2).sum(1)
        exact = (apart * apart).sum(1)  # right where it fits
        return [int(e) if r < 2**62 else (lambda t: t if t < 2**63 else None)(sum(int(c) ** 2 for c in row)) for e, r, row in zip(exact, rough, apart)]


def fitted(vectors: DataFrame, components: int) -> Whitening | None:
    """Fits on the distinct ``v`` of a table, all of the same length; None without any."""
    distinct = stash(vectors.select("v").distinct(), "distinct")
    n, width, largest = distinct.agg(F.count("*"), F.max(F.size("v")), F.max(F.expr("array_max(transform(v, x -> abs(x)))"))).first()
    if not n or not width:
        return None
    if n * max(largest, 1) >= 2**62:
        raise OverflowError("n times the largest component passes 64 bits")
    sums = _summed(distinct, "v", lambda c: _matrix(c, width).sum(0, keepdims=True), width)[0].astype(np.int64)
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((width, 0)))

    def scatter(c: pa.Array) -> np.ndarray:
        d = model.centred(_matrix(c, width))
        return d.T @ d

    covariance = _summed(distinct, "v", scatter, width) / n
    covariance = (covariance + covariance.T) / 2
    slicer, pairs = Slicer(covariance), []
    while len(pairs) < components and (pair := slicer.next()):
        pairs.append(pair)
    values = np.array([p[0] for p in pairs])
    model = Whitening(n, sums, float(np.trace(covariance)), values, slicer.vectors)
    if pairs:

        def square(c: pa.Array) -> np.ndarray:
            w = model.whitened(_matrix(c, width))
            return w.T @ w

        model.error = float(np.abs(_summed(distinct, "v", square, len(pairs)) / n - np.eye(len(pairs))).max())
    return model


def prepared(rows: DataFrame, embedding: Column, scale: int) -> DataFrame:
    """Rows with ``v``, floor(scale * c) of each entry; those with a null vector or a null or non-finite entry go. Shorter vectors are filled up with zeros."""
    rows = rows.withColumn("v", quantised(embedding, scale)).where("v is not null")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): ``components`` rows for each row of
    ``vectors`` (vec_id and embedding; other columns are ignored).

    Entries are x = floor(scale * c).  The covariance is that of the distinct vectors, divisor n.  Components are numbered
    by falling eigenvalue.  Rows whose vector is null or holds a null, NaN or infinite entry are left out; a shorter vector
    counts as zero beyond its end.  Rows that repeat, also with a null vec_id, each have their own result; equal
    eigenvalues have some orthonormal basis.  Eigenvalues of zero give no component, as nothing can be scaled to one: equal
    vectors alone, or an empty table, give no rows.  ``deviation`` is null beyond 64 bits.
    """
    bounded_batches(vectors.sparkSession, BLOCK_ROWS)
    rows = prepared(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), F.col("embedding"), scale).select("vec_id", "v")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fitted(rows, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    held, width = vectors.sparkSession.sparkContext.broadcast(model), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        k = len(own.values)
        for batch in batches:
            x = _matrix(batch.column(1), width)
            ids, deviation = np.repeat(np.arange(len(x)), k), own.deviations(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(ids), own.n)), pa.array(deviation, pa.int64()).take(pa.array(ids)),
                    pa.array(own.whitened(x).ravel()), pa.array(np.tile(own.values / own.trace, len(x))), pa.array(np.full(len(ids), own.error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
