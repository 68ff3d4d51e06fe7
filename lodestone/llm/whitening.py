"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed. A Spark pass gives ``Xc'(Xc Q)`` for a block
``Q`` of a few columns and the centred rows ``Xc``: every task adds up its own
rows, and Spark adds up the tasks. Between passes the driver holds matrices of
``dimensions x block`` only: QR, the Rayleigh-Ritz problem of the block, and the
residuals that certify the components. Between two Rayleigh-Ritz steps the block
goes through a Chebyshev polynomial of the covariance instead of a power of it,
as the spectra of embeddings are flat: the passes then grow with the root of
what plain powers would take.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, releasing

#: Columns of the block beyond the components asked for.
OVERSAMPLE = 12
#: Passes between two Rayleigh-Ritz steps, and such steps before the block doubles.
DEGREE, PATIENCE = 6, 12
#: A residual, relative to the greatest eigenvalue, that certifies; and one that does if it no longer falls.
CERTIFIED, STALLED = 2e-13, 1e-9
#: Eigenvalues below this share of the greatest are rounding: there is nothing to divide by.
RANK = 1e-12


@dataclass
class Whitening:
    """``n`` distinct vectors with exact ``sums``; unit ``components`` in rows, their ``eigenvalues`` falling."""

    dim: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        return (x - self.mean) @ self.components.T / np.sqrt(self.eigenvalues)


def scaled(vector: Column, scale: int) -> Column:
    """``floor(scale * c)`` of every entry as long; null unless all entries are finite numbers."""
    c = vector.cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine, F.transform(c, lambda v: F.floor(v * float(scale)).cast("bigint")))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _summed(fit: DataFrame, f, size: int) -> np.ndarray:
    """The sum over all batches of ``fit(x)`` of what ``f`` gives for the rows of one: ``size`` numbers, added up in each task and then by Spark."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += f(batch.column(0)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size)
    for r in fit.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # bounded: dimensions x block
        out[r["at"]] = r["value"]
    return out


def _exact_sums(fit: DataFrame, dim: int) -> list[int]:
    """Sums by dimension in whole numbers: the halves of each entry apart, so that none overflows."""

    def run(batches):
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _rows(batch.column(0), dim)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low)], names=["at", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "at int, high long, low long").groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")])
    out = [0] * dim
    for r in parts.collect():  # bounded: a row for each dimension
        out[r["at"]] = (int(r["high"]) << 32) + int(r["low"])
    return out


def subspace_iteration(product, dim: int, k: int, block: int, seed: int = 1):
    """The first ``k`` eigenpairs of a positive semidefinite matrix known by ``product(Q)`` alone.

    Returns eigenvalues, vectors in columns, residuals and the number of
    products. A block that hasn't converged after ``PATIENCE`` Rayleigh-Ritz
    steps doubles; one as wide as the matrix is exact, so this always ends.
    """
    draw = np.random.default_rng(seed)
    q = np.linalg.qr(draw.standard_normal((dim, block)))[0]
    passes, steps, before = 0, 0, np.inf
    while True:
        vq = product(q)
        passes, steps = passes + 1, steps + 1
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, vq @ turn
        residuals = np.linalg.norm(image[:, :k] - ritz[:, :k] * values[:k], axis=0)
        worst, top = residuals.max(initial=0.0), max(values[0], 0.0)
        if q.shape[1] == dim or worst <= CERTIFIED * top or (worst <= STALLED * top and worst > 0.7 * before):
            return values[:k], ritz[:, :k], residuals, passes
        before = worst
        if steps % PATIENCE == 0:
            wider = min(dim, 2 * q.shape[1]) - q.shape[1]
            q, before = np.linalg.qr(np.hstack([ritz, draw.standard_normal((dim, wider))]))[0], np.inf
            continue
        # what isn't wanted lies between 0 and the least value of the block: the polynomial stays within 1 there and grows fastest above
        half = values[-1] / 2
        if half <= RANK * top:
            q = np.linalg.qr(image)[0]
            continue
        earlier, q = ritz, (image - half * ritz) / half
        for _ in range(DEGREE - 1):
            vq = product(q)
            passes += 1
            earlier, q = q, 2 * (vq - half * q) / half - earlier
        q = np.linalg.qr(q)[0]


def fit_whitening(vectors: DataFrame, vector: str = "embedding", *, k: int = 4, scale: int = 256) -> Whitening | None:
    """The whitening of the distinct vectors ``floor(scale * c)``.

    Vectors that are null or hold null or non-finite entries don't count. Of
    several lengths the commonest counts (of equally common ones the longest).
    None if nothing is left or no direction varies; fewer than ``k`` components
    if fewer vary. Repeated vectors count once, so copies weigh nothing.
    """
    fit = materialize(vectors.select(scaled(F.col(vector), scale).alias("x")).where("x is not null").distinct(), "whitening-fit")
    common = fit.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None or not common["dim"]:
        forget(fit)
        return None
    dim, n = common["dim"], common["count"]
    mine = fit.where(F.size("x") == dim)
    sums = _exact_sums(mine, dim)
    mean = np.array([s / n for s in sums])

    def product(q: np.ndarray) -> np.ndarray:
        def part(column):
            x = _rows(column, dim) - mean
            return x.T @ (x @ q)

        return _summed(mine, part, q.size).reshape(q.shape) / n

    trace = float(_summed(mine, lambda column: ((_rows(column, dim) - mean) ** 2).sum(0), dim).sum()) / n
    if not trace > 0:
        forget(fit)
        return None
    values, columns, residuals, passes = subspace_iteration(product, dim, min(k, dim), min(dim, k + OVERSAMPLE))
    some = values > RANK * values[0]
    made = Whitening(dim, n, sums, columns.T[some], values[some], trace, passes, residuals[some])

    def second_moments(column):
        y = made.project(_rows(column, dim))
        return np.vstack([y.T @ y, y.sum(0)])

    width = len(made.eigenvalues)
    moments = _summed(mine, second_moments, width * (width + 1)).reshape(width + 1, width) / n
    made.identity_error = float(np.abs(moments[:width] - np.outer(moments[width], moments[width]) - np.eye(width)).max())
    forget(fit)
    return made


def whiten(vectors: DataFrame, fitted: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding", *, scale: int = 256) -> DataFrame:
    """A row for each remaining vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is the exact sum over dimensions of ``(n*x - S)**2``; null if
    it doesn't fit in a long. Rows whose vector is null or holds null or
    non-finite entries are dropped; of those of another length than the fitted
    one, ``deviation`` and ``whitened`` are null. Entries too large for a long
    after scaling count as the largest one. Repeated rows, ties and null
    identifiers are rows like any other; an empty table, or one where nothing
    varies, gives an empty result; further columns, with whatever names, are
    ignored.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    m, width = fitted, len(fitted.eigenvalues)
    sums, explained = np.array(m.sums, dtype=object), m.eigenvalues / m.trace

    def deviations(x: np.ndarray) -> pa.Array:
        most = m.n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in m.sums)
        if most**2 * m.dim < 1 << 63:
            off = x * m.n - sums.astype(np.int64)
            return pa.array((off * off).sum(1))
        off = x.astype(object) * m.n - sums
        return pa.array([v if v < 1 << 63 else None for v in (off * off).sum(1).tolist()], pa.int64())

    def run(batches):
        for batch in batches:
            fits = pc.equal(pc.list_value_length(batch.column(1)), m.dim)
            for part, same in ((batch.filter(fits), True), (batch.filter(pc.invert(fits)), False)):
                rows = part.num_rows
                if not rows:
                    continue
                x = _rows(part.column(1), m.dim) if same else None
                of = pa.array(np.repeat(np.arange(rows), width))
                columns = {
                    "vec_id": part.column(0).take(of),
                    "component": pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * width, m.n, np.int64)),
                    "deviation": (deviations(x) if same else pa.nulls(rows, pa.int64())).take(of),
                    "whitened": pa.array(m.project(x).ravel()) if same else pa.nulls(rows * width, pa.float64()),
                    "explained": pa.array(np.tile(explained, rows)),
                    "identity_error": pa.array(np.full(rows * width, m.identity_error)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = vectors.select(F.col(vec_id).alias("vec_id"), scaled(F.col(vector), scale).alias("x")).where("x is not null")
    return rows.mapInArrow(releasing(run), schema)


def embedding_whitening(vectors: DataFrame, *, k: int = 4, scale: int = 256) -> DataFrame:
    """Fit on all distinct vectors of ``vectors(vec_id, embedding)`` and project every row; see ``fit_whitening`` and ``whiten``."""
    return whiten(vectors, fit_whitening(vectors, k=k, scale=scale), scale=scale)
