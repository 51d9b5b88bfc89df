"""Whitening of embeddings by block subspace iteration; the covariance matrix is never formed.

Entries become whole numbers, so sums and centring are exact. Each pass over the distinct vectors computes Xᵀ(XQ) of the
centred rows for a block Q of directions: partial products of each task, added up in Spark, a D x block matrix to the driver.
There the block is made orthogonal (QR) to those of earlier passes, which stay in the basis (at most ``kept`` blocks, then the best
directions alone go on), and a Rayleigh-Ritz step over the basis gives eigenvalues, components and their residuals, until
the residuals of all k components are down to rounding. With earlier blocks kept, D / block passes span everything, also
where eigenvalues lie close together and plain powers of the matrix would take hundreds of passes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import written

SCALE, SHIFT = 64, 1_000_000
#: Groups of partial sums that reach the driver.
FAN = 32
#: Eigenvalues below this share of the largest are rounding, and their components are left out.
RANK = 1e-11


def whole_entries(vector: str | Column) -> Column:
    """``floor(64 * c)`` of each entry as a double (the constant shift of x is added where x itself is asked for).

    Null if the vector is null or empty, or holds an entry that is null, not finite or, times 64, beyond 64-bit numbers.
    """
    v = F.transform(vector, lambda c: F.floor(F.when((F.abs(c.cast("double")) < 2.0**56), c.cast("double")) * SCALE))
    return F.when((F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull()), v)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _total(df: DataFrame, start: Callable[[], list], step: Callable[[list, np.ndarray], list]) -> list | None:
    """Folds the matrices of column ``x`` batch by batch in each task; the tasks' results (lists to be added up) meet in ``FAN`` groups, then on the driver.

    Always added in order of partitions, so that another run gives the same. None if there is no row.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, seen = start(), False
        for b in batches:
            if len(b):
                acc, seen = step(acc, _matrix(b.column("x"))), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(acc)], pa.binary())], names=["part", "acc"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        accs = [pickle.loads(v) for v in pdf.sort_values("part")["acc"]]
        return pd.DataFrame({"part": [int(pdf["part"].min())], "acc": [pickle.dumps(_sum(accs))]})

    groups = df.select("x").mapInArrow(partial, "part int, acc binary").groupBy(F.col("part") % FAN).applyInPandas(added, "part int, acc binary").collect()
    return _sum([pickle.loads(r.acc) for r in sorted(groups, key=lambda r: r.part)]) if groups else None


def _sum(accs: list[list]) -> list:
    out = accs[0]
    for a in accs[1:]:
        out = [x + y for x, y in zip(out, a, strict=True)]
    return out


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """``x`` as 64-bit numbers where ``most``, a bound of what is computed, fits them, else as Python's whole numbers."""
    return x if most < 1 << 62 else x.astype(object)


@dataclass
class Whitening:
    """``n`` distinct vectors, their sums ``s`` and trace, the components (columns, unit length) and eigenvalues in falling order."""

    n: int
    s: np.ndarray
    trace: float
    values: np.ndarray
    components: np.ndarray
    residual: float
    passes: int
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max((abs(int(v)) for v in self.s), default=0)) * 2
        return _exact(x, most) * self.n - (_exact(np.array(self.s, object), most) if most >= 1 << 62 else np.array([int(v) for v in self.s], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def _orthogonal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``basis``; directions that are rounding only are dropped."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(3):
        block = block - basis @ (basis.T @ block)
        if not block.size:
            return np.zeros((len(basis), 0))
        q, r = np.linalg.qr(block)
        u, w, _ = np.linalg.svd(r)
        block = (q @ u)[:, w > 1e-10 * max(1.0, w.max(initial=0))]
    return block


def fit_whitening(vectors: DataFrame, k: int = 16, block: int = 32, kept: int = 8, tolerance: float = 1e-13, most_passes: int = 500, seed: int = 0) -> Whitening | None:
    """``vectors``: distinct rows ``x`` of whole numbers, all of one length, read several times. None if there is no row.

    Iterates until |Vq - eq| <= tolerance * e1 for each of the k components, until the basis holds every direction that the
    matrix has, or until residuals no longer fall (rounding). Raises after ``most_passes`` otherwise.
    """

    def moments(acc: list, x: np.ndarray) -> list:
        most = int(np.abs(x).max(initial=0)) + 1
        y, z = _exact(x, most * len(x)), _exact(x, most * most * len(x))
        return [acc[0] + len(x), acc[1] + np.array([int(v) for v in y.sum(0)], object), acc[2] + sum(int(v) for v in (z * z).sum(0))]

    got = _total(vectors, lambda: [0, 0, 0], moments)
    if got is None:
        return None
    n, s, squares = got
    dims = len(s)
    trace = (n * squares - sum(int(v) ** 2 for v in s)) / n / n
    fit = Whitening(n, s, trace, np.zeros(0), np.zeros((dims, 0)), 0.0, 0)
    if trace <= 0:
        return fit

    def times(q: np.ndarray) -> np.ndarray:
        def step(acc: list, x: np.ndarray) -> list:
            c = fit.centred(x)
            return [acc[0] + c.T @ (c @ q)]

        return _total(vectors, lambda: [np.zeros(q.shape)], step)[0] / n

    k = min(k, dims)
    new = _orthogonal(np.random.default_rng(seed).standard_normal((dims, min(block, dims))), np.zeros((dims, 0)))
    basis, products, best = np.zeros((dims, 0)), np.zeros((dims, 0)), np.inf
    stalled = 0
    for done in range(1, most_passes + 1):
        image = times(new)
        basis, products = np.concatenate([basis, new], 1), np.concatenate([products, image], 1)
        small = basis.T @ products
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors_, images = basis @ turn, products @ turn
        rest = images[:, :k] - vectors_[:, :k] * values[:k]
        residual = float(np.linalg.norm(rest, axis=0).max()) / values[0]
        stalled = stalled + 1 if residual > best / 2 else 0
        best = min(best, residual)
        whole = basis.shape[1] == dims
        if basis.shape[1] >= k and (residual <= tolerance or whole or (stalled >= 3 and residual <= 1e-10)):
            break
        # the residuals, where they are many, point where the basis lacks most; the block's image holds them
        new = _orthogonal(np.concatenate([rest, image], 1), basis)[:, :block]
        if not new.shape[1]:  # nothing is left: the basis holds all that the matrix has
            break
        if basis.shape[1] + new.shape[1] > max(kept * block, 2 * k + block):
            keep = max(k, block)
            basis, products = vectors_[:, :keep], images[:, :keep]
            new = _orthogonal(np.concatenate([rest, image], 1), basis)[:, :block]
    else:
        raise ArithmeticError(f"{most_passes} passes left a residual of {residual:.2g}")
    k = int((values[:k] > RANK * values[0]).sum())
    unit = vectors_[:, :k] / np.linalg.norm(vectors_[:, :k], axis=0)
    fit = Whitening(n, s, trace, values[:k], unit, residual, done)

    def spread(acc: list, x: np.ndarray) -> list:
        w = fit.whitened(x)
        return [acc[0] + w.sum(0), acc[1] + w.T @ w]

    total, products = _total(vectors, lambda: [0, 0], spread)
    fit.identity_error = float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(k)).max())
    return fit


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """A row for each vector and component (from 1, by falling eigenvalue): ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, empty or hold an entry that is null or not finite have no row, nor do those of another length than
    most have (of two lengths as frequent, the longer counts). Repeated rows each have theirs; the fit has each
    vector once. Components whose eigenvalue is only rounding are left out, so a table of one vector gives no rows. ``deviation``
    is null where it is beyond 64-bit numbers.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), whole_entries(vector_col).alias("x")).where("x is not null")
    rows = written(rows, "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    spark = embeddings.sparkSession
    kind = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = rows.where(F.size("x") == (sizes.d if sizes else 0))
    fit = fit_whitening(written(rows.select("x").distinct(), "distinct"), **how) if sizes else None
    if fit is None:
        return spark.createDataFrame([], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        for b in batches:
            x = _matrix(b.column("x"))
            d, w = fit.deviations(x), fit.whitened(x)
            most = int(np.abs(d).max(initial=0))
            d = _exact(d, (most + 1) ** 2 * d.shape[1])
            square = (d * d).sum(1)
            square = [int(v) if int(v) < 1 << 63 else None for v in square]
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, fit.n)), pa.array(square, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(w.ravel()), pa.array(np.tile(fit.values / fit.trace, len(x))), pa.array(np.full(len(x) * k, fit.identity_error)),
            ], schema=_OUT)

    return rows.mapInArrow(run, kind)
