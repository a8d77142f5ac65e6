"""Operator 12: embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. One *pass* is one Spark job that multiplies a block of vectors: every
task sums x_c (x_cᵀ Q) over its rows, x_c centred in exact integers first, and the tasks' sums are added by a shuffle
(dimension by dimension), so the driver gets dims x block numbers, whatever the table.

1. Exact sums: rows, S per dimension, then the trace.
2. A few Lanczos passes bound the lower end of the spectrum.
3. Each round applies a Chebyshev polynomial of the covariance to the block, by its three-term recurrence, one pass a
   degree: it damps everything between that lower end and the block's least Ritz value. Then QR, and Rayleigh-Ritz with
   one more pass.
4. The rounds end when the wanted pairs are certified: each has a residual |Vq - eq| below ``PROVEN`` times the largest
   eigenvalue, so each eigenvalue is that near to a true one; and the block's other Ritz values, with their residuals,
   stand below them, so none of the wanted ones was missed.

The table is read again in each pass and nothing of it is kept: a lost executor costs its tasks alone. All that is
random is the start block, which has a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from herald.llm.common import small_batches, table

COMPONENTS = 8
#: Vectors of the block beyond the wanted ones, degree of a round's polynomial, Lanczos passes, rounds at most.
SPARE, DEGREE, LANCZOS, ROUNDS = 32, 8, 6, 60
#: Residual of a certified pair, and residual at which rounding ends all progress, as shares of the largest eigenvalue.
PROVEN, FLOOR = 2e-14, 1e-12
SCALE, SHIFT = 1024, 100_000
#: Largest x whose square sums are taken in 64 bits; rows beyond are summed as Python integers.
EXACT = 1 << 62


@dataclass(frozen=True)
class Fit:
    """n rows, sums per dimension, eigenvalues and unit eigenvectors (columns) by falling eigenvalue, trace of V, residuals."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def _rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and the integers x of those."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (sizes == dims)
    flat = column.filter(pa.array(whole)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # null entries become NaN
    fine = np.isfinite(values).all(axis=1)
    whole[np.flatnonzero(whole)[~fine]] = False
    return whole, np.floor(SCALE * values[fine]).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact, over n."""
    return (n * x - sums) / n


def dimensions(embeddings: DataFrame, column: str) -> int:
    """The commonest length of a vector (of several the largest); 0 where there is none."""
    sizes = embeddings.select(F.size(column).alias("size")).where("size > 0").groupBy("size").count()
    first = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def _summed(embeddings: DataFrame, column: str, dims: int, work, width: int, whole: bool = False) -> np.ndarray:
    """The sums over all rows of what ``work`` makes of a task's integers x (arrays of this width), doubles or whole numbers."""
    names = [f"c{k}" for k in range(width)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            _, x = _rows(b.column(0), dims)
            if len(x):
                part = work(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *map(pa.array, total.T)], ["place", *names])

    kind = LongType() if whole else DoubleType()
    shape = StructType([StructField("place", IntegerType()), *[StructField(n, kind) for n in names]])
    parts = embeddings.select(column).mapInArrow(task, shape)
    added = parts.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).orderBy("place").collect()
    return np.array([r[1:] for r in added], np.int64 if whole else np.float64).reshape(-1, width)


class Covariance:
    """Products of the covariance with blocks, each one pass over the table."""

    def __init__(self, embeddings: DataFrame, column: str) -> None:
        self.embeddings, self.column, self.dims, self.passes = embeddings, column, dimensions(embeddings, column), 0
        small_batches(embeddings.sparkSession)
        # per dimension: the sum, and the rows (the same in each)
        counted = _summed(embeddings, column, self.dims, lambda x: np.stack([x.sum(axis=0), np.full(x.shape[1], len(x))], axis=1), 2, whole=True) if self.dims else np.zeros((0, 2), np.int64)
        self.sums, self.n = counted[:, 0], int(counted[0, 1]) if len(counted) else 0

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float(_summed(self.embeddings, self.column, self.dims, lambda x: (_centred(x, n, sums) ** 2).sum(axis=0)[:, None], 1).sum()) / n

    def times(self, block: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums
        self.passes += 1
        session = self.embeddings.sparkSession
        sent = session.sparkContext.broadcast(block)

        def work(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ sent.value)

        return _summed(self.embeddings, self.column, self.dims, work, block.shape[1]) / n


def lower_end(v: Covariance, steps: int = LANCZOS) -> float:
    """A bound below (nearly) all eigenvalues, from a few Lanczos steps: the least Ritz value less its residual; 0 at least."""
    q = np.random.default_rng(12).standard_normal(v.dims)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, v.dims)):
        w = v.times(basis[-1][:, None])[:, 0]
        alphas.append(basis[-1] @ w)
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        betas.append(np.linalg.norm(w))
        if betas[-1] <= FLOOR * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) + np.diag(betas[: len(alphas) - 1], -1))
    return max(0.0, float(ritz[0] - betas[-1]))


def filtered(v: Covariance, block: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A scaled Chebyshev polynomial of V times the block: small between low and high, about 1 at top."""
    centre, half = (low + high) / 2, (high - low) / 2
    scale = first = half / (top - centre)
    before, now = block, scale / half * (v.times(block) - centre * block)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, 2 * following / half * (v.times(now) - centre * now) - scale * following * before
        scale = following
    return now


def fit(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS, spare: int = SPARE, degree: int = DEGREE) -> Fit:
    """The leading components of the covariance. Those whose eigenvalue is 0 (within rounding) are left out."""
    v = Covariance(embeddings, column)
    none = Fit(v.n, tuple(map(int, v.sums)), np.zeros(0), np.zeros((v.dims, 0)), 0.0, np.zeros(0), 0)
    trace = v.trace() if v.n else 0.0
    if trace <= 0:
        return none
    wanted, width = min(components, v.dims), min(components + spare, v.dims)
    block = np.linalg.qr(np.random.default_rng(8).standard_normal((v.dims, width)))[0]
    low = lower_end(v) if width < v.dims else 0.0
    least = np.inf
    for _ in range(ROUNDS):
        image = v.times(block)
        projected = block.T @ image
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        residuals = np.linalg.norm(image - block * values, axis=0)
        worst = residuals[:wanted].max() / values[0]
        # none was missed: the guard pairs stand below; where the spectrum is level, no pair is better than another
        apart = width == v.dims or values[wanted] - residuals[wanted] <= values[wanted - 1] + residuals[wanted - 1]
        if apart and (worst <= PROVEN or worst <= FLOOR and worst >= least / 2):
            break
        least = min(least, worst)
        if width < v.dims and values[-1] > low:
            block = np.linalg.qr(filtered(v, block, low, values[-1], values[0], degree))[0]
        else:
            block = np.linalg.qr(image)[0]
    else:
        raise ArithmeticError(f"no certified components in {ROUNDS} rounds: residual {worst:.1e} of the largest eigenvalue")
    some = values[:wanted] > 1e-12 * values[0]
    return Fit(v.n, none.sums, values[:wanted][some], block[:, :wanted][:, some], trace, residuals[:wanted][some], v.passes)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n * x - S)², exact; null where one does not fit a long."""
    off = n * x - sums
    if off.size and float(np.abs(off).max()) ** 2 * off.shape[1] < EXACT:
        return (off**2).sum(axis=1).tolist()
    totals = (sum(int(a) ** 2 for a in row) for row in off.tolist())
    return [t if t < 1 << 63 else None for t in totals]


def projected(embeddings: DataFrame, model: Fit, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, n, deviation and whitened (one number for each component) of the remaining rows."""
    n, sums, dims = model.n, np.array(model.sums, np.int64), len(model.sums)
    scaled = model.vectors / np.sqrt(model.values)
    sent = embeddings.sparkSession.sparkContext.broadcast(scaled)
    shape = StructType([StructField(key, embeddings.schema[key].dataType), *StructType.fromDDL("n bigint, deviation bigint, whitened array<double>").fields])
    small_batches(embeddings.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, x = _rows(b.column(1), dims)
            w = _centred(x, n, sums) @ sent.value
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(whole)), pa.array(np.full(len(x), n)), pa.array(deviations(x, n, sums), pa.int64()), lists], [key, "n", "deviation", "whitened"])

    return embeddings.select(key, column).mapInArrow(work, shape)


def identity_error(embeddings: DataFrame, model: Fit, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, from their own mean and products."""
    n, sums, k = model.n, np.array(model.sums, np.int64), len(model.values)
    dims = len(sums)
    sent = embeddings.sparkSession.sparkContext.broadcast(model.vectors / np.sqrt(model.values))
    mean = _summed(embeddings, column, dims, lambda x: (_centred(x, n, sums) @ sent.value).sum(axis=0)[:, None], 1)[:, 0] / n

    def products(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ sent.value - mean
        return w.T @ w

    return float(np.abs(_summed(embeddings, column, dims, products, k) / n - np.eye(k)).max())


def whitened(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, holds null or non-finite entries, or has another length than most vectors (of
    lengths that are as common, the largest counts), are left out. A null key stays null; rows that repeat have rows each;
    level eigenvalues have some orthonormal components, the same for all rows; vectors without any variance (one row, all
    the same) have no components and so no rows, as has an empty table; entries beyond 2**53 / 1024 are exact as doubles
    only; other columns are not used, whatever their names.
    """
    model = fit(embeddings, column, components)
    shape = StructType([StructField(key, embeddings.schema[key].dataType), *StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    if not len(model.values):
        return embeddings.sparkSession.createDataFrame([], shape)
    error = identity_error(embeddings, model, column)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = projected(embeddings, model, key, column).select(key, "n", "deviation", F.posexplode("whitened").alias("place", "w"))
    return rows.select(key, (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("w").alias("whitened"), F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
