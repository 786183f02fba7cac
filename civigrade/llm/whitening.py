"""Embedding whitening: leading eigenvectors of the covariance by Jacobi-Davidson, without forming the covariance.

Entries are put on a lattice, x = floor(256 * c). The fit list holds each distinct vector once; its covariance V is only ever applied
to vectors: one Spark job computes C'(C u) / n for a block of vectors u, where C are the centred rows of the fit list. What comes to
the driver are as many numbers as the block has entries; the search space, the Rayleigh-Ritz problem in it and the correction
equations hold vectors of one entry per dimension and live there.

Each round takes the Ritz vectors of the search space. Those whose residual has reached double precision are locked, in order; for
each of the others the correction equation (I - QQ')(V - theta I)(I - QQ') t = -r, Q being all locked and wanted Ritz vectors, is
solved by a few steps of MINRES. The equations run in step, so that one distributed product serves them all. Corrections extend the
search space, which is cut back to its leading Ritz vectors when it has grown too large. At the end the residuals are measured again
with fresh products.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are left out, as are those whose number of
entries is not the most frequent one (of equal frequent numbers the smallest counts); repeated rows come once each, null ids stay
null; a component exists only where its eigenvalue is positive, so a fit list of one vector or of rank under four gives fewer or no
rows; entries of 2**31 or more on the lattice are refused; a deviation beyond a long is null; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civigrade.session import materialise

COMPONENTS = 4
LATTICE = 256
#: Rows of the fit list in one packed block.
BLOCK_ROWS = 8_192
#: Largest number of search vectors, as a multiple of the wanted ones; beyond it the space is cut back.
SPACE = 12
KEPT = 4
#: Ritz vectors beyond the wanted ones that are corrected too: a cluster of eigenvalues is then split from outside.
GUARDS = 4
#: Steps of MINRES in a round.
INNER = 3
MAX_ROUNDS = 200
#: A residual is at double precision when it is this many units of rounding of the largest eigenvalue, times sqrt(dimensions).
ROUNDINGS = 8
LARGEST = 1 << 31
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def lattice(vectors: DataFrame) -> DataFrame:
    """vec_id and x of every row with a whole vector."""
    number = lambda c: F.floor(c.cast("double") * LATTICE).cast("long")
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(usable)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", number).alias("x"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dimensions)


@dataclass(frozen=True)
class FitList:
    """Packed blocks of the distinct vectors, their number, and sums and sums of squares of each dimension, as whole numbers."""

    blocks: DataFrame
    n: int
    sums: list[int]
    squares: list[int]

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        """Sum of the variances, from exact sums."""
        return sum((self.n * q - s * s) / self.n**2 for s, q in zip(self.sums, self.squares))

    def reduced(self, function: Callable[[np.ndarray], np.ndarray], count: int) -> np.ndarray:
        """Sum over all blocks of the ``count`` numbers that ``function`` makes of a block's centred rows."""
        dimensions, mean = self.dimensions, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(count)
            for batch in batches:
                for packed in batch.column("packed").to_pylist():
                    total += function(np.frombuffer(packed, np.int64).reshape(-1, dimensions) - mean).ravel()
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(count, dtype=np.int64)), "value": pa.array(total)})

        rows = self.blocks.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        result = np.zeros(count)
        for place, value in rows:
            result[place] = value
        return result

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``vectors``."""
        return self.reduced(lambda rows: rows.T @ (rows @ vectors), vectors.size).reshape(vectors.shape) / self.n


def fit_list(rows: DataFrame, dimensions: int) -> FitList:
    """Each distinct x of ``rows`` once, written in blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch.column("x").slice(start, BLOCK_ROWS), dimensions)
                exact = x if len(x) * int(np.abs(x).max()) ** 2 < 1 << 62 else x.astype(object)
                texts = [[str(v) for v in (exact**power).sum(axis=0).tolist()] for power in (1, 2)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "n": pa.array([len(x)], pa.int64()), "largest": pa.array([int(np.abs(x).max())], pa.int64()),
                        "sums": pa.array([texts[0]], pa.list_(pa.string())), "squares": pa.array([texts[1]], pa.list_(pa.string())),
                        "packed": pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary()),
                    }
                )

    distinct = rows.select("x").groupBy("x").agg(F.lit(1)).select("x")
    blocks = materialise(distinct.mapInArrow(pack, "n long, largest long, sums array<string>, squares array<string>, packed binary"), "fit-list")
    n, largest = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("largest")).first()
    if n and largest >= LARGEST:
        raise ValueError(f"an entry is {largest} on the lattice; {LARGEST} is the limit")
    each = blocks.select(F.posexplode(F.arrays_zip("sums", "squares")).alias("place", "own"))
    whole = lambda name: F.sum(F.col(f"own.{name}").cast("decimal(38,0)"))
    totals = each.groupBy("place").agg(whole("sums").alias("s"), whole("squares").alias("q")).orderBy("place").collect()
    return FitList(blocks.select("packed"), n, [int(t["s"]) for t in totals], [int(t["q"]) for t in totals])


def minres(theta: float, outside: Callable[[np.ndarray], np.ndarray], residual: np.ndarray, steps: int, reduction: float):
    """Solve the projected correction equation; yields the vectors whose products with V it is sent, and returns the solution.

    ``outside`` projects to the complement of the Ritz vectors.
    """
    right = -outside(residual)
    size = np.linalg.norm(right)
    solution = np.zeros_like(right)
    if size == 0:
        return solution
    before, now = np.zeros_like(right), right / size
    older, old = np.zeros_like(right), np.zeros_like(right)
    beta, eta = 0.0, size
    c_old, c, s_old, s = 1.0, 1.0, 0.0, 0.0
    for _ in range(steps):
        product = yield now
        following = outside(product - theta * now)
        alpha = now @ following
        following = following - alpha * now - beta * before
        length = np.linalg.norm(following)
        first, second, third = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        pivot = math.hypot(first, length)
        if pivot == 0:
            break
        c_old, s_old, c, s = c, s, first / pivot, length / pivot
        direction = (now - third * older - second * old) / pivot
        solution = solution + c * eta * direction
        eta *= -s
        older, old = old, direction
        if abs(eta) <= reduction * size or length <= np.finfo(float).eps * abs(theta):
            break
        before, now, beta = now, following / length, length
    return solution


def in_step(product: Callable[[np.ndarray], np.ndarray], equations: list) -> list[np.ndarray]:
    """Run the generators ``equations`` together, one product of a block of vectors for all of them at a time."""
    solutions: list[np.ndarray | None] = [None] * len(equations)
    waiting: dict[int, np.ndarray] = {}

    def advance(i: int, sent: np.ndarray | None) -> None:
        try:
            waiting[i] = equations[i].send(sent)
        except StopIteration as end:
            solutions[i] = end.value
            waiting.pop(i, None)

    for i in range(len(equations)):
        advance(i, None)
    while waiting:
        numbers = sorted(waiting)
        products = product(np.stack([waiting[i] for i in numbers], axis=1))
        for column, i in enumerate(numbers):
            advance(i, products[:, column])
    return solutions


def orthonormal(basis: np.ndarray, vectors: list[np.ndarray], chance: np.random.Generator) -> np.ndarray:
    """The parts of ``vectors`` outside ``basis``, orthonormal; one that lies inside is replaced by a random one while there is room."""
    new = np.zeros((basis.shape[0], 0))
    for vector in vectors:
        if basis.shape[1] + new.shape[1] == basis.shape[0]:
            break
        for attempt in range(9):
            candidate = vector if attempt == 0 else chance.standard_normal(len(vector))
            size = np.linalg.norm(candidate)
            for _ in range(3):
                candidate = candidate - basis @ (basis.T @ candidate) - new @ (new.T @ candidate)
            rest = np.linalg.norm(candidate)
            if size > 0 and rest > 1e-10 * size:
                candidate = candidate / rest
                candidate = candidate - basis @ (basis.T @ candidate) - new @ (new.T @ candidate)
                new = np.column_stack([new, candidate / np.linalg.norm(candidate)])
                break
    return new


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, falling, and their unit eigenvectors as columns."""
    wanted = min(wanted, dimensions)
    chance = np.random.default_rng(seed)
    basis = orthonormal(np.zeros((dimensions, 0)), list(chance.standard_normal((min(2 * wanted, dimensions), dimensions))), chance)
    images = product(basis)
    precision = ROUNDINGS * np.finfo(float).eps * math.sqrt(dimensions)
    locked = 0
    for number in range(MAX_ROUNDS):
        projected = basis.T @ images
        values, inner = np.linalg.eigh((projected + projected.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        basis, images = basis @ inner, images @ inner
        residuals = images - basis * values
        sizes = np.linalg.norm(residuals, axis=0)
        limit = precision * abs(values[0])
        locked = 0
        while locked < wanted and sizes[locked] <= limit:
            locked += 1
        if locked == wanted or basis.shape[1] == dimensions:
            fresh = product(basis[:, :wanted])
            residuals[:, :wanted] = fresh - basis[:, :wanted] * values[:wanted]
            sizes[:wanted] = np.linalg.norm(residuals[:, :wanted], axis=0)
            images[:, :wanted] = fresh
            if (sizes[:wanted] <= 2 * limit).all() or basis.shape[1] == dimensions:
                return values[:wanted], basis[:, :wanted]
            locked = 0
        if basis.shape[1] > SPACE * wanted:
            basis, images = basis[:, : KEPT * wanted], images[:, : KEPT * wanted]
        led = min(wanted + GUARDS, basis.shape[1])
        ritz = basis[:, :led].copy()

        def outside(vector: np.ndarray, ritz: np.ndarray = ritz) -> np.ndarray:
            return vector - ritz @ (ritz.T @ vector)

        open_ones = [i for i in range(locked, led) if sizes[i] > limit]
        reduction = max(2.0 ** -(number + 1), 1e-4)
        equations = [minres(values[i], outside, residuals[:, i], INNER, reduction) for i in open_ones]
        new = orthonormal(basis, in_step(product, equations), chance)
        if new.shape[1] == 0:
            new = orthonormal(basis, [chance.standard_normal(dimensions)], chance)
        basis, images = np.column_stack([basis, new]), np.column_stack([images, product(new)])
    raise RuntimeError(f"residuals {sizes.tolist()} after {MAX_ROUNDS} rounds; {limit} is asked for")


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: unit ``vectors`` (columns) with ``values`` falling, and how far the whitened fit list is from white."""

    fit: FitList
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fitted(rows: DataFrame, dimensions: int, components: int = COMPONENTS) -> Whitening:
    """The transform of the distinct x of ``rows``."""
    fit = fit_list(rows, dimensions)
    trace = fit.trace if fit.n else 0.0
    if trace == 0:
        return Whitening(fit, np.zeros(0), np.zeros((dimensions, 0)), 0.0)
    values, vectors = jacobi_davidson(fit.product, dimensions, components)
    positive = values > dimensions * 64 * np.finfo(float).eps * values[0]
    values, vectors = values[positive], vectors[:, positive]
    scaled, k = vectors / np.sqrt(values), len(values)

    def moments(rows: np.ndarray) -> np.ndarray:
        white = rows @ scaled
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    found = fit.reduced(moments, k + k * k) / fit.n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return Whitening(fit, values, vectors, float(np.abs(covariance - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None] | np.ndarray:
    """Sum of (n * x - S)**2 of every row, exactly; None beyond a long."""
    far = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)
    if far < 1 << 31 and len(sums) * far * far < 1 << 63:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1)
    if len(sums) * far * far < 1 << 84:  # in two halves of 31 bits, each exact in 64
        parts = np.abs(n * x - np.array(sums, dtype=np.int64))
        high, low = parts >> 31, parts & ((1 << 31) - 1)
        exact = [(int(a) << 62) + (int(b) << 32) + int(c) for a, b, c in zip((high * high).sum(axis=1), (high * low).sum(axis=1), halved(low))]
    else:
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def halved(low: np.ndarray) -> list[int]:
    """Sums of squares of numbers under 2**31, exactly."""
    squares = low.astype(np.uint64) ** 2
    return [(int(a) << 32) + int(b) for a, b in zip((squares >> np.uint64(32)).sum(axis=1), (squares & np.uint64(0xFFFFFFFF)).sum(axis=1))]


def applied(rows: DataFrame, white: Whitening) -> DataFrame:
    """One row for each of ``rows`` and component."""
    fit, scaled, k = white.fit, white.scaled, len(white.values)
    n, sums, mean, dimensions, error = fit.n, fit.sums, fit.mean, fit.dimensions, white.identity_error
    explained = white.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dimensions)
            size = len(x) * k
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(size, n, dtype=np.int64)),
                    "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    "whitened": pa.array(((x - mean) @ scaled).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(size, error)),
                }
            )

    return rows.mapInArrow(run, OUT)


def usual_length(rows: DataFrame) -> int | None:
    """The most frequent number of entries; None without rows."""
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("least")))).first()[0]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of ``vectors`` (vec_id, embedding)."""
    rows = lattice(vectors)
    dimensions = usual_length(rows)
    empty = vectors.sparkSession.createDataFrame([], OUT)
    if dimensions is None:
        return empty
    rows = rows.filter(F.size("x") == dimensions)
    white = fitted(rows, dimensions, components)
    return applied(rows, white) if len(white.values) else empty
