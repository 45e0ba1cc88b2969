"""Whitened embeddings: leading components of the covariance by slicing its spectrum."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.llm.common import configure, stored

EPS = np.finfo(float).eps
# entries from here on have no exact place on the grid beside others
LARGEST = 2.0**40
_PIVOT = (1 + 17**0.5) / 8


class Factors:
    """``L D Lᵀ`` of a symmetric matrix with diagonal pivoting; ``D`` has blocks of one or two.

    The signs of ``D`` are those of the eigenvalues, whatever the pivots (Sylvester), for a
    matrix that differs from the given one by rounding only. Pivots are chosen as Bunch
    and Kaufman do, so an indefinite matrix does no harm.
    """

    def __init__(self, matrix: np.ndarray):
        a = np.array(matrix, float)
        n = len(a)
        self.lower, self.order, self.blocks = np.eye(n), np.arange(n), []
        k = 0
        while k < n:
            k += self._step(a, k)

    def _swap(self, a: np.ndarray, i: int, j: int, done: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]
            self.lower[[i, j], :done] = self.lower[[j, i], :done]

    def _step(self, a: np.ndarray, k: int) -> int:
        n, width = len(a), 1
        below = np.abs(a[k + 1 :, k])
        if len(below) and below.max() > 0:
            r = k + 1 + int(below.argmax())
            column = below.max()
            if abs(a[k, k]) < _PIVOT * column:
                others = np.abs(a[r, k:])
                others[r - k] = 0
                row = others.max()
                if abs(a[k, k]) * row >= _PIVOT * column**2:
                    pass
                elif abs(a[r, r]) >= _PIVOT * row:
                    self._swap(a, k, r, k)
                else:
                    width = 2
                    self._swap(a, k + 1, r, k)
        rest = slice(k + width, n)
        if width == 1:
            pivot = a[k, k]
            if pivot != 0:
                self.lower[rest, k] = a[rest, k] / pivot
                a[rest, rest] -= np.outer(self.lower[rest, k], a[rest, k])
            self.blocks.append((k, a[k : k + 1, k : k + 1].copy()))
        else:
            block = a[k : k + 2, k : k + 2].copy()
            self.lower[rest, k : k + 2] = np.linalg.solve(block, a[rest, k : k + 2].T).T
            a[rest, rest] -= self.lower[rest, k : k + 2] @ a[rest, k : k + 2].T
            self.blocks.append((k, block))
        return width

    def positive(self) -> int:
        """How many eigenvalues are above zero."""
        count = 0
        for _, block in self.blocks:
            if len(block) == 1:
                count += block[0, 0] > 0
            else:
                determinant = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
                count += 1 if determinant < 0 else 2 * (block[0, 0] > 0)
        return int(count)

    def solve(self, right: np.ndarray, least: float) -> np.ndarray:
        """The matrix's inverse times ``right``; single pivots under ``least`` count as ``least``."""
        x = right[self.order].astype(float)
        for k in range(len(x)):
            x[k + 1 :] -= self.lower[k + 1 :, k] * x[k]
        for k, block in self.blocks:
            if len(block) == 1:
                x[k] /= block[0, 0] if abs(block[0, 0]) > least else least
            else:
                x[k : k + 2] = np.linalg.solve(block, x[k : k + 2])
        for k in range(len(x) - 1, 0, -1):
            x[:k] -= self.lower[k, :k] * x[k]
        out = np.empty_like(x)
        out[self.order] = x
        return out


@dataclass
class Component:
    value: float
    vector: np.ndarray


class Spectrum:
    """The largest eigenvalues of a symmetric matrix, found by counting what lies above a shift.

    ``above(s)`` counts the eigenvalues over ``s`` by the signs of ``L D Lᵀ`` of the matrix less
    ``s``. Bisection by counts isolates the k-th largest one. From there Rayleigh quotient
    iteration converges cubically; two more counts, just above and just below, say that what
    it found is number k, else the slice is halved and it starts again. Eigenvalues closer
    than rounding are one slice; their vectors come from inverse iteration at right angles
    to those found.
    """

    def __init__(self, matrix: np.ndarray):
        self.matrix = np.array(matrix, float)
        self.size = len(matrix)
        radius = np.abs(self.matrix).sum(1).max() if self.size else 0.0
        self.norm = float(radius)
        self.least = 8 * EPS * self.norm * max(1, self.size) ** 0.5
        # shifts with known counts: nothing lies above the radius, all above its negative
        self.counts = {self.norm + 4 * self.least: 0, -self.norm - 4 * self.least: self.size}

    def factors(self, shift: float) -> Factors:
        return Factors(self.matrix - shift * np.eye(self.size))

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = self.factors(shift).positive()
        return self.counts[shift]

    def slice(self, k: int, low: float | None = None, high: float | None = None) -> tuple[float, float]:
        """Shifts around the k-th largest eigenvalue and no other, or as close as rounding allows."""
        low = max(s for s, c in self.counts.items() if c >= k) if low is None else low
        high = min(s for s, c in self.counts.items() if c < k and s > low) if high is None else high
        while (self.counts[low] != k or self.counts[high] != k - 1) and high - low > self.least:
            middle = (low + high) / 2
            if self.above(middle) >= k:
                low = middle
            else:
                high = middle
        return low, high

    def _iterate(self, low: float, high: float, found: np.ndarray, fixed: bool) -> tuple[float, np.ndarray, float]:
        """Eigenvalue, unit vector and residual from inverse iteration that turns to Rayleigh's."""
        x = np.random.default_rng(len(found)).normal(size=self.size)
        shift, best = (low + high) / 2, (0.0, x, np.inf)
        for i in range(24):
            x = self.factors(shift).solve(x, EPS * self.norm)
            for _ in range(2):
                x -= found.T @ (found @ x)
            x /= np.linalg.norm(x)
            value = float(x @ self.matrix @ x)
            residual = float(np.linalg.norm(self.matrix @ x - value * x))
            if residual < best[2]:
                best = (value, x, residual)
            elif best[2] <= self.least:
                break
            # the quotient leads astray while it lies outside the slice
            shift = value if low <= value <= high and not fixed and i else (low + high) / 2
        return best

    def component(self, k: int, earlier: list[Component]) -> Component:
        """The k-th largest eigenvalue and its unit vector, given those before it."""
        found = np.array([c.vector for c in earlier]).reshape(-1, self.size)
        low, high = self.slice(k)
        while True:
            narrow = high - low <= self.least
            value, vector, residual = self._iterate(low, high, found, narrow)
            # an eigenvalue lies within the residual of the quotient; the counts say which
            margin = residual + self.least
            if residual <= 4 * self.least and self.above(value + margin) < k <= self.above(value - margin):
                break
            if narrow:
                raise ArithmeticError(f"eigenvalue {k} was not found to double precision")
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
            low, high = self.slice(k, low, high)
        # either sign would do; the largest entry is positive, so that reruns agree
        return Component(value, vector * np.sign(vector[np.abs(vector).argmax()]))

    def leading(self, most: int) -> list[Component]:
        """Up to ``most`` components by falling eigenvalue, those that are zero by rounding left out."""
        out: list[Component] = []
        if self.norm > 0:
            for k in range(1, min(most, self.above(4 * self.least)) + 1):
                out.append(self.component(k, out))
        return out


Batches = Iterator[pa.RecordBatch]


def _grid(vectors: pa.Array, size: int) -> np.ndarray:
    """``floor(1024 c) + 100000`` of every entry."""
    return np.floor(1024 * vectors.flatten().to_numpy().reshape(-1, size)).astype(np.int64) + 100_000


def _total(rows: DataFrame, part: Callable[[pa.Array], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part`` over all batches as whole numbers of any size, exact in any order."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(shape, object)
        for batch in batches:
            if batch.num_rows:
                total = total + part(batch.column(1))
        values = [Decimal(int(x)) for x in total.ravel()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(values)), pa.int64()), pa.array(values, pa.decimal128(38, 0))], ["cell", "value"]
        )

    # as many rows as the result has cells, whatever the input
    sums = rows.mapInArrow(run, "cell bigint, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(int(np.prod(shape)), object)
    for row in sums.collect():
        out[row["cell"]] = int(row["value"])
    return out.reshape(shape)


def _products(z: np.ndarray) -> np.ndarray:
    """``zᵀ z`` exactly: in doubles while every sum fits their 53 bits."""
    largest = int(np.abs(z).max()) if z.size else 0
    if largest * largest * len(z) < 2**53:
        return (z.T.astype(float) @ z.astype(float)).astype(np.int64).astype(object)
    return z.T.astype(object) @ z.astype(object)


@dataclass
class Fit:
    """Count, sums and covariance of the grid vectors; ``centre`` is the mean in whole numbers."""

    n: int
    centre: np.ndarray
    rest: np.ndarray  # sums of what lies above the centre
    covariance: np.ndarray


def fit(rows: DataFrame, n: int, size: int) -> Fit:
    """Sums first, then the products of what is left after subtracting the mean.

    Both are sums of whole numbers: the mean's own fraction is taken off the products at the
    end, so every entry of the covariance is its exact value, rounded once, in any order
    of the rows. Tasks send as many numbers as the covariance has.
    """
    sums = _total(rows, lambda v: _grid(v, size).sum(0).astype(object), (size,))
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], object)
    products = _total(rows, lambda v: _products(_grid(v, size) - centre), (size, size))
    exact = n * products - np.outer(rest, rest)
    covariance = np.array([[x / (n * n) for x in row] for row in exact])
    return Fit(n, centre, rest, covariance)


def _deviations(z: np.ndarray, fitted: Fit) -> tuple[np.ndarray, list[int | None]]:
    """``x - S/n`` of each entry, rounded once, and the exact sum of ``(n x - S)^2`` per row."""
    n = fitted.n
    bound = n * int(np.abs(z).max()) + max(abs(int(r)) for r in fitted.rest)
    if bound * bound * z.shape[1] < 2**63:
        t = n * z - fitted.rest.astype(np.int64)
        return t / n, (t * t).sum(1).tolist()
    t = n * z.astype(object) - fitted.rest
    sums = [int(s) for s in (t * t).sum(1)]
    return np.array([[x / n for x in row] for row in t]), [s if s < 2**63 else None for s in sums]


OUTPUT = """vec_id bigint, component int, n bigint, deviation bigint, whitened double,
    explained double, identity_error double"""


def whitened(
    vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Each vector's whitened coordinates: a row per vector and component (``OUTPUT``).

    Entries go to whole numbers ``x = floor(1024 c) + 100000``. Components are the leading
    unit eigenvectors of the covariance of all vectors, numbered by falling eigenvalue
    (``Spectrum``); ``whitened`` is the centred vector along the component, over the root of
    the eigenvalue, ``explained`` the eigenvalue's share of the trace. ``deviation`` is the sum
    of ``(n x - S)^2``, null should a long not hold it. ``identity_error`` is measured on the
    rows returned: how far the covariance of their coordinates is from the identity at most.

    The matrix on the driver is as large as the dimension says, whatever the rows.

    Null vectors and those with null or non-finite entries are left out; entries of 2^40
    or more, which have no exact place on the grid, count as non-finite. So are empty vectors and those
    of another length than most (of the larger one among equals), which have no place in the
    covariance. Null ids and repeated rows count and get rows each. Components without variance
    are left out: one vector, or equal ones, give no rows, and so does an empty table.
    Further columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    configure(spark)
    entries = f"transform(`{embedding}`, c -> cast(c AS DOUBLE))"
    # a null entry makes the comparison null, NaN is larger than any number
    rows = vectors.selectExpr(f"cast(`{vec_id}` AS BIGINT) AS vec_id", f"{entries} AS entries").where(
        f"size(entries) > 0 AND NOT exists(entries, c -> coalesce(abs(c) >= {LARGEST}D, true))"
    )
    sizes = rows.groupBy(F.size("entries").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    chosen = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if chosen is None:
        return spark.createDataFrame([], OUTPUT)
    n, size = chosen["n"], chosen["size"]
    rows = rows.where(f"size(entries) = {size}")
    fitted = fit(rows, n, size)
    found = Spectrum(fitted.covariance).leading(components)
    if not found:
        return spark.createDataFrame([], OUTPUT)
    axes = np.array([c.vector / np.sqrt(c.value) for c in found]).T

    def project(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                centred, deviations = _deviations(_grid(batch.column(1), size) - fitted.centre, fitted)
                scores = centred @ axes
                offsets = pa.array(np.arange(len(scores) + 1, dtype=np.int32) * axes.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(deviations, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(scores.ravel())),
                    ],
                    ["vec_id", "deviation", "scores"],
                )

    scored = stored(rows.mapInArrow(project, "vec_id bigint, deviation bigint, scores array<double>"), "whitened")
    error = identity_error(scored, len(found))
    trace = float(np.trace(fitted.covariance))
    explained = F.array(*[F.lit(c.value / trace) for c in found])
    return scored.select("vec_id", "deviation", F.posexplode("scores").alias("place", "whitened")).select(
        "vec_id",
        F.expr("place + 1").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.expr("place + 1")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def identity_error(scored: DataFrame, k: int) -> float:
    """The largest entry of the covariance of ``scores``, less the identity; divisor n."""
    means = scored.select(*[F.avg(F.col("scores")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.col("scores")[i] - F.lit(means[i]) for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = scored.select(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(cells, row, strict=True))
