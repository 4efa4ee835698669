"""Whitening of embeddings by their leading principal components, found by LOBPCG.

Rows never leave the executors. An iteration sends an orthonormal basis (of the iterate, its residual and the direction of
the step before: at most 3 (k + GUARD) columns) to all tasks; each centres its rows and adds up its share of the product
of the covariance with the basis; shares are summed by matrix entry. The driver solves the small projected problem
(Rayleigh-Ritz) and stops when a fresh product certifies the residuals of all wanted components. What it holds has the
size of the dimension times the basis, whatever the number of rows.

Entries become integers: x = floor(64 c) + 1000000. Products use x less an integer next to its mean, so the mean's
fraction is all that rounds; sums and squared deviations are exact.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are dropped, and so are vectors of another
length than the most common one (of equally common ones the longest); entries beyond 2^40 in size are held at 2^40;
repeated rows and rows of equal or null vec_id stay, each on its own; components whose variance is nothing but rounding
aren't returned, so neither a single row nor equal rows have any; equal variances have any basis of their space; a
deviation beyond a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import clip_columns, staged, table

COMPONENTS = 32
#: Vectors iterated besides the wanted ones: they carry what lies close behind the last of these.
GUARD = 8
#: Fixed by the contract of the integers: how fine they are, where zero lies, and the most that an entry may be.
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 40
#: Certified residuals, and the least variance of a component, as shares of the largest variance.
TOLERANCE, NOTHING = 1e-13, 1e-11
#: Residuals that no longer fall count as certified up to here; rounding keeps them from the other bound.
STALLED = 1e-10
ITERATIONS = 500


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector can be used, with x as an array of longs in its place."""
    c = F.col(column)
    usable = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = float(MOST)
    return vectors.where(usable).withColumn(column, F.transform(c, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(bound)), F.lit(-bound))).cast("long") + SHIFT))


@dataclass(frozen=True)
class Fit:
    """What the rows have in common: their number, the integers next to the means, and what the sums have beyond these."""

    n: int
    near: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest / self.n


def matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int], column: str = "x") -> np.ndarray:
    """The sum over all rows of a matrix that ``part`` makes of a batch; shares of tasks meet by entry, not in one place."""
    high, wide = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += part(b)
        i, j = np.divmod(np.arange(high * wide, dtype=np.int32), wide)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros(shape)
    found = rows.select(column).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return out


def orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """A basis of what the blocks span, block by block; directions that earlier ones hold already are left out."""
    basis = np.zeros((blocks[0].shape[0], 0))
    for block in blocks:
        for _ in range(2):  # twice, as one pass leaves what rounding brings back
            block = block - basis @ (basis.T @ block)
            size = np.linalg.norm(block, axis=0)
            block = block[:, size > 1e-300] / size[size > 1e-300]
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            u = u[:, s > 1e-10 * max(1.0, s[0])]
            u = u - basis @ (basis.T @ u)
            basis = np.linalg.qr(np.hstack([basis, u]))[0][:, : min(basis.shape[0], basis.shape[1] + u.shape[1])]
    return basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors, of the symmetric matrix that ``product`` multiplies by.

    Every iteration is one product with an orthonormal basis of iterate, residual and last direction.
    """
    k = min(k, d)
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(42).standard_normal((d, m)))[0]
    last, best, stalled = np.zeros((d, 0)), np.inf, 0
    ax = product(x)
    for _ in range(iterations):
        e, c = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        e, c = e[::-1], c[:, ::-1]
        x, ax = x @ c, ax @ c
        residual = ax - x * e
        most = np.linalg.norm(residual[:, :k], axis=0).max()
        bound = max(e[0], 0.0)
        stalled = 0 if most < 0.5 * best else stalled + 1
        best = min(best, most)
        if most <= TOLERANCE * bound or (stalled >= 3 and most <= STALLED * bound):
            return e[:k], x[:, :k]
        basis = orthonormal(x, residual, last)
        a = product(basis)
        _, c = np.linalg.eigh((basis.T @ a + a.T @ basis) / 2)
        c = c[:, ::-1][:, :m]
        own = x.shape[1]
        last = basis[:, own:] @ c[own:]
        # the basis holds the product of the new iterate, so no other is needed
        x, ax = basis @ c, a @ c
    raise RuntimeError(f"no certified residuals after {iterations} iterations: {most / bound:.1e} of the largest variance")


@dataclass(frozen=True)
class Whitening:
    """Unit components as columns, their variances, and the total variance."""

    fit: Fit
    components: np.ndarray
    variances: np.ndarray
    total: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.fit.centred(x) @ (self.components / np.sqrt(self.variances))


def prepare(spark: SparkSession, vectors: DataFrame) -> tuple[DataFrame, int]:
    """The usable rows (vec_id, x), written, and their dimension; vectors: vec_id, embedding."""
    ship(spark)
    rows = staged(spark, integers(vectors).withColumnRenamed("embedding", "x"), "integers")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    return rows.where(F.size("x") == d), d


def fitted(rows: DataFrame, d: int) -> Fit:
    """Counts and exact sums by dimension."""
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).toPandas().sort_values("i")
    n, totals = int(sums["n"].iloc[0]), [int(s) for s in sums["s"]]
    near = [s // n for s in totals]
    return Fit(n, np.array(near, np.int64), np.array([s - n * m for s, m in zip(totals, near, strict=True)], np.int64))


def learn(rows: DataFrame, d: int, k: int = COMPONENTS) -> Whitening | None:
    """The leading components of the rows' covariance; None if there is no variance."""
    if not d:
        return None
    fit = fitted(rows, d)

    def product(basis: np.ndarray) -> np.ndarray:
        def part(b: pa.RecordBatch) -> np.ndarray:
            x = fit.centred(matrix(b, "x", d))
            return x.T @ (x @ basis)

        return summed(rows, part, basis.shape) / fit.n

    total = float(summed(rows, lambda b: np.square(fit.centred(matrix(b, "x", d))).sum(keepdims=True), (1, 1))[0, 0]) / fit.n
    if not total:
        return None
    e, u = lobpcg(product, d, k)
    kept = e > NOTHING * e[0]
    return Whitening(fit, u[:, kept], e[kept], total)


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""
    k = len(model.variances)

    def part(b: pa.RecordBatch) -> np.ndarray:
        w = model.whiten(matrix(b, "x", d))
        return np.vstack([w.T @ w, w.sum(0)])

    found = summed(rows, part, (k + 1, k)) / model.fit.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null where a long can't hold it."""
    y = x - fit.near
    size = float(np.abs(y).max(initial=0) + 1) * fit.n
    if size * size * x.shape[1] < 2.0**62:
        return np.square(y * fit.n - fit.rest).sum(1).tolist()
    exact = [sum((v * fit.n - r) ** 2 for v, r in zip(row, fit.rest.tolist(), strict=True)) for row in y.tolist()]
    return [v if v < 2**63 else None for v in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, d: int, model: Whitening, error: float) -> DataFrame:
    """A row for each vector and component."""
    k, share = len(model.variances), model.variances / model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096)):
                x = matrix(b, "x", d)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch(
                    [
                        b.column("vec_id").cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.fit.n)),
                        pa.array(deviations(x, model.fit), pa.int64()).take(each), pa.array(model.whiten(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, SCHEMA)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = prepare(spark, clip_columns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    model = learn(rows, d)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    return whitened(rows, d, model, identity_error(rows, d, model))
