"""Whitening of embeddings: components of the covariance by QDWH spectral divide-and-conquer, then one narrow pass.

1. Vectors become whole numbers (256 steps a unit). The fit list holds each distinct one once, so copies weigh nothing.
2. Tasks sum the fit list to its mean, and then sum centred products: one matrix of dimension x dimension per task,
   combined row by row. That matrix, and nothing of the corpus, reaches the driver: dimension squared numbers.
3. The matrix is split there. The polar factor of V - shift x I, by QR-based dynamically weighted Halley steps, has
   eigenvalues 1 and -1, and (factor + I) / 2 projects onto the eigenvectors above the shift. Both invariant subspaces
   are split again until each holds one component (or equal eigenvalues, where any basis serves).
4. Mean and components travel with the tasks: each row is whitened where it lies.

Defined cases: rows with a null vector, or null, NaN or infinite entries, are dropped. Vectors must have one length: that
of most rows counts (of the longest on a tie), rows of other lengths, and empty vectors, are dropped. Entries beyond the
range of a long saturate. A null vec_id is an id like any other; rows that repeat an id are all answered. A component
without variance (an eigenvalue not above 1e-12 of the largest, as with one distinct vector) has `whitened` null,
`explained` as computed (0 without any variance), and no part in `identity_error`, which is null without any component.
A table without usable rows gives an empty result. `deviation` is null beyond 38 digits. Other columns play no part.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import held

STEPS = 256
#: Share of the largest eigenvalue up to which a component counts as without variance.
FLAT = 1e-12
_EPS = np.finfo(float).eps


def lattice(vectors: DataFrame) -> DataFrame:
    """vec_id and whole-number vector x of the rows that stay."""
    c = F.col("embedding").cast("array<double>")
    usable = c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(usable).select("vec_id", F.transform(c, lambda v: F.floor(v * STEPS).cast("long")).alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (length["d"] if length else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Count and exact sum per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            safe = not len(x) or float(np.abs(x.astype(float)).max()) * len(x) < 2**62
            n, total = n + len(x), total + x.sum(axis=0, dtype=np.int64 if safe else object)
        if n:
            sums = pa.array([decimal.Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), sums], ["i", "n", "s"])

    rows = fit.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if not rows:
        return 0, []
    return rows[0]["n"], [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


def _products(fit: DataFrame, d: int, width: int, project) -> np.ndarray:
    """Sum over the fit list of the outer product of project(x) with itself, width x width: one matrix per task, combined by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = project(_matrix(batch.column(0), d))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, total = None, np.zeros(width)
        for batch in batches:
            i = batch.column(0)[0]
            total = total + _matrix(batch.column(1), width).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["i", "row"])

    rows = fit.mapInArrow(run, "i int, row array<double>").groupBy("i").applyInArrow(add, "i int, row array<double>").collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]).reshape(width, width)


# --- spectral divide-and-conquer ---------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray | None:
    """Orthogonal polar factor of a symmetric matrix by QDWH; None where the matrix is singular to working precision."""
    n = len(a)
    scale = np.linalg.norm(a)
    x = a / scale
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        return None
    if not low > 1e-13:
        return None
    for _ in range(40):
        q = low * low
        d = np.cbrt(4 * (1 - q) / q**2)
        u = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - q) / (q * np.sqrt(1 + d))))
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        basis = np.linalg.qr(np.vstack([np.sqrt(w) * x, np.eye(n)]))[0]
        new = v / w * x + (u - v / w) / np.sqrt(w) * basis[:n] @ basis[n:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (u + v * q) / (1 + w * q))
        moved, x = np.linalg.norm(new - x), new
        if moved < np.cbrt(_EPS) and 1 - low < 10 * _EPS:
            break
    return x


def _range(projector: np.ndarray, k: int, start: np.ndarray) -> np.ndarray:
    basis = start
    for _ in range(3):
        basis = np.linalg.qr(projector @ basis)[0]
    return basis[:, :k]


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix, by recursive splitting."""
    size = np.linalg.norm(v)
    rng = np.random.Generator(np.random.PCG64(20240301))
    found, open_ = [], [((v + v.T) / 2, np.eye(len(v)))]
    while open_:
        a, basis = open_.pop()
        n = len(a)
        mean = np.trace(a) / n
        spread = np.linalg.norm(a - mean * np.eye(n))
        if n == 1 or spread <= 4 * n * _EPS * size:
            found += list(basis.T)
            continue
        for step in (0, 0.11, -0.13, 0.029, -0.031, 0.0071, -0.0073, 0.23, -0.29):
            # the mean lies within the eigenvalues; where one equals it, a shift aside does too
            factor = polar(a - (mean + step * spread / n) * np.eye(n))
            k = 0 if factor is None else round((n + np.trace(factor)) / 2)
            if 0 < k < n:
                break
        else:
            raise ArithmeticError("no shift splits the covariance")
        projector = (np.eye(n) + factor) / 2
        start = rng.standard_normal((n, n))
        above = _range(projector, k, start[:, :k])
        below = _range(np.eye(n) - projector, n - k, start[:, k:])
        below = np.linalg.qr(below - above @ (above.T @ below))[0]
        for part in (above, below):
            inner = part.T @ a @ part
            open_.append(((inner + inner.T) / 2, basis @ part))
    vectors = np.array(found).T
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- whitening ----------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """n, exact sums per dimension, eigenvalues (falling) with unit vectors as columns, trace, and the error on the fit list."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None

    @property
    def live(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > FLAT * max(self.values[0], 0) if len(self.values) else np.zeros(0, bool)


def fit(rows: DataFrame, count: int | None = None) -> Whitening | None:
    """Mean and the first count components (all without it) of the distinct vectors; None without any row."""
    distinct = held(rows.select("x").distinct())
    first = distinct.first()
    if first is None:
        return None
    d = len(first["x"])
    n, sums = _sums(distinct, d)
    mean = np.array([s / n for s in sums])
    v = _products(distinct, d, d, lambda x: x - mean) / n
    values, vectors = components(v)
    model = Whitening(n, sums, values[:count], vectors[:, :count], float(np.trace(v)), None)
    live = model.live
    if live.any():
        weights = model.vectors[:, live] / np.sqrt(model.values[live])
        # a column of ones beside the whitened columns gives their sums along with their products
        total = _products(distinct, d, int(live.sum()) + 1, lambda x: np.hstack([(x - mean) @ weights, np.ones((len(x), 1))]))
        centre = total[-1, :-1] / n
        model.error = float(np.abs(total[:-1, :-1] / n - np.outer(centre, centre) - np.eye(int(live.sum()))).max())
    return model


SCHEMA = "vec_id long, deviation decimal(38,0), whitened array<double>"


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, exact deviation, and the whitened coordinates (null for components without variance)."""
    n, sums, live = model.n, model.sums, model.live
    mean = np.array([s / n for s in sums])
    weights = model.vectors / np.sqrt(np.where(live, model.values, 1))
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, object)
        near = np.array([s if abs(s) < 2**62 else 0 for s in sums], np.int64)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            rough = ((n * x.astype(float) - total.astype(float)) ** 2).sum(axis=1)
            exact = ((n * x - near) ** 2).sum(axis=1).astype(object)
            for i in np.flatnonzero(rough > 2.0**62):
                exact[i] = int(((n * x[i].astype(object) - total) ** 2).sum())
            deviation = [decimal.Decimal(int(v)) if v < 10**38 else None for v in exact]
            z = (x - mean) @ weights
            values = pa.ListArray.from_arrays(
                np.arange(len(x) + 1, dtype=np.int32) * z.shape[1], pa.array(z.ravel(), mask=np.tile(~live, len(x)))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.decimal128(38, 0)), values], ["vec_id", "deviation", "whitened"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, SCHEMA)
