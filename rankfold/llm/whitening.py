"""Whitening of embeddings by principal components of a covariance recovered by polarisation.

Entries become whole numbers, so every sum below is exact and does not depend on the order of the rows:

1. Distinct vectors (the fit list) are counted and summed per dimension: ``n`` and ``S``.
2. Every vector is centred as ``y = n * x - S``. One pass adds up ``y_i ** 2`` for every dimension and
   ``(y_i + y_j) ** 2`` for every pair of dimensions. Tasks send one row per sum, whatever they read.
3. The difference of variances ``var(i + j) - var(i) - var(j)`` is twice the covariance of i and j. The
   matrix (dimensions squared, the only thing that reaches the driver) goes to ``eigh``.
4. All rows are projected on the components; the covariance of the whitened fit list is measured and
   compared with the identity.

Defined cases: rows with a null vector or null or non-finite entries are left out, and so are vectors of
another length than the commonest (the shortest of several such); null ids and repeated rows give rows
of their own; an entry beyond 2**60 counts as 2**60; components whose eigenvalue is zero up to rounding are not
returned; a deviation beyond a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankfold.llm.common import extended, stage

TOP = 1 << 60
LIMB = 40  # sums leave a task in three limbs of this many bits, the highest signed
ROWS = 1024  # rows squared at once
SUMS = "i int, j int, high long, middle long, low long"


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x) of the usable rows; x holds ``floor(scale * c) + shift`` as longs."""
    usable = F.forall(vec_col, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    bounded = lambda c: F.least(F.greatest(c.cast("double") * scale, F.lit(-float(TOP))), F.lit(float(TOP)))
    x = F.transform(vec_col, lambda c: F.floor(bounded(c)).cast("long") + F.lit(shift).cast("long"))
    return df.where(F.col(vec_col).isNotNull()).where(usable).select(F.col(id_col).alias("id"), x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` as whole numbers: int64 where they fit, else Python's."""
    top = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if top < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(z: np.ndarray) -> list[int]:
    """Exact sum of squares of every column."""
    if z.dtype != object:
        bits = int(np.abs(z).max(initial=0)).bit_length()
        if 2 * bits + len(z).bit_length() < 63:
            return (z * z).sum(axis=0).tolist()
        if bits <= 50 and len(z) <= ROWS:
            high, low = z >> 25, z & ((1 << 25) - 1)
            sums = [(a * b).sum(axis=0).tolist() for a, b in ((high, high), (high, low), (low, low))]
            return [(hh << 50) + (hl << 26) + ll for hh, hl, ll in zip(*sums)]
        z = z.astype(object)
    return list((z * z).sum(axis=0)) if len(z) else [0] * z.shape[1]


def limbs(value: int) -> tuple[int, int, int]:
    mask = (1 << LIMB) - 1
    return value >> 2 * LIMB, value >> LIMB & mask, value & mask


def summed(rows: DataFrame, *keys: str) -> dict[tuple, int]:
    """Exact totals of limbs by key (as many rows as there are sums)."""
    total = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("high", "middle", "low")])
    return {tuple(r[k] for k in keys): (r["high"] << 2 * LIMB) + (r["middle"] << LIMB) + r["low"] for r in total.collect()}


def sums_table(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys, parts = list(totals), [limbs(v) for v in totals.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
         *[pa.array([p[c] for p in parts], pa.int64()) for c in range(3)]], names=["i", "j", "high", "middle", "low"])


def dimension_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by dimension."""
    def add(batches):
        totals, count = {}, 0
        for batch in batches:
            x = matrix(batch.column(0))
            count += len(x)
            wide = x.sum(axis=0).tolist() if int(np.abs(x).max(initial=0)).bit_length() + len(x).bit_length() < 63 \
                else list(x.astype(object).sum(axis=0))
            for i, v in enumerate(wide):
                totals[i, 0] = totals.get((i, 0), 0) + v
        if count:
            yield sums_table(totals | {(-1, 0): count})

    found = summed(fit.select("x").mapInArrow(add, SUMS), "i")
    n = found.pop((-1,), 0)
    return n, [found[i,] for i in range(len(found))]


def polarised_sums(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums over the fit list: (i, i) of ``y_i ** 2`` and (i, j) of ``(y_i + y_j) ** 2`` for i < j."""
    d = len(sums)

    def add(batches):
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            whole = matrix(batch.column(0))
            for a in range(0, len(whole), ROWS):
                y = centred(whole[a: a + ROWS], n, sums)
                for i, v in enumerate(square_sums(y)):
                    totals[i, i] = totals.get((i, i), 0) + v
                for i in range(d - 1):
                    for j, v in enumerate(square_sums(y[:, i: i + 1] + y[:, i + 1:]), i + 1):
                        totals[i, j] = totals.get((i, j), 0) + v
        if totals:
            yield sums_table(totals)

    return summed(fit.select("x").mapInArrow(add, SUMS), "i", "j")


def covariance(sums: dict[tuple[int, int], int], n: int, d: int) -> np.ndarray:
    """Covariances from differences of variances; each entry is one exact quotient of whole numbers."""
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = sums[i, i] / n ** 3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (sums[i, j] - sums[i, i] - sums[j, j]) / (2 * n ** 3)
    return v


class Whitening:
    """Fitted whitening: ``n``, ``sums``, ``eigenvalues`` (falling), ``components`` (columns), ``trace``, ``identity_error``."""

    def __init__(self, fit: DataFrame, most: int | None = None):
        self.n, self.sums = dimension_sums(fit)
        d = len(self.sums)
        self.eigenvalues, self.components, self.trace, self.identity_error = np.empty(0), np.empty((d, 0)), 0.0, 0.0
        if not self.n or not d:
            return
        v = covariance(polarised_sums(fit, self.n, self.sums), self.n, d)
        self.trace = float(np.trace(v))
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        whole = values > max(values[0], 0.0) * d * np.finfo(float).eps
        k = min(int(whole.sum()), most or d)
        # The sign makes each component's largest entry positive, so that equal tables give equal results.
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
        self.eigenvalues, self.components = values[:k].copy(), vectors[:, :k].copy()
        self.identity_error = self._identity_error(fit)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows of centred vectors."""
        return (y.astype(np.float64) / self.n) @ self.components / np.sqrt(self.eigenvalues)

    def _identity_error(self, fit: DataFrame) -> float:
        """Largest absolute entry of the covariance of the whitened fit list minus the identity. The rows are centred by
        construction; what rounding leaves of their mean is taken off."""
        k = len(self.eigenvalues)
        n, sums, project = self.n, self.sums, self.project
        if not k:
            return 0.0

        def add(batches):
            outer, total, seen = np.zeros((k, k)), np.zeros(k), False
            for batch in batches:
                w = project(centred(matrix(batch.column(0)), n, sums))
                outer, total, seen = outer + w.T @ w, total + w.sum(axis=0), True
            if seen:
                i, j = np.meshgrid(np.arange(-1, k), np.arange(k), indexing="ij")
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                                  pa.array(np.concatenate([total, outer.ravel()]))], names=["i", "j", "s"])

        table = np.zeros((k + 1, k))
        for r in fit.select("x").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            table[r["i"] + 1, r["j"]] = r["s"]
        mean = table[0] / n
        return float(np.abs(table[1:] / n - np.outer(mean, mean) - np.eye(k)).max())

    def transform(self, vectors: DataFrame) -> DataFrame:
        """One row per vector and component: (id, component, n, deviation, whitened, explained, identity_error)."""
        out = extended(vectors.select("id").schema, "component int, n long, deviation long, whitened double, explained double, identity_error double")
        n, sums, k, error, project = self.n, self.sums, len(self.eigenvalues), self.identity_error, self.project
        share = self.eigenvalues / self.trace if self.trace else self.eigenvalues

        def rows(batches):
            for batch in batches:
                y = centred(matrix(batch.column(1)), n, sums)
                m = len(y)
                if not m or not k:
                    continue
                deviation = square_sums(np.ascontiguousarray(y.T[:, :ROWS])) if m <= ROWS else \
                    [v for a in range(0, m, ROWS) for v in square_sums(np.ascontiguousarray(y[a: a + ROWS].T))]
                fits = [v if v < 1 << 63 else None for v in deviation]
                turn = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(turn), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     pa.array(fits, pa.int64()).take(turn), pa.array(project(y).ravel()), pa.array(np.tile(share, m)),
                     pa.array(np.full(m * k, error))], names=out.names)

        return vectors.select("id", "x").mapInArrow(rows, out)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, scale: int = 64,
           shift: int = 1_000_000) -> DataFrame:
    """Fit on the distinct vectors of ``df`` and whiten all its usable rows."""
    vectors = whole_vectors(df, id_col, vec_col, scale, shift)
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").limit(1).collect()
    vectors = vectors.where(F.size("x") == (lengths[0]["d"] if lengths else 0))
    fit = stage(vectors.select("x").dropDuplicates(["x"]), "fit-list")
    return Whitening(fit, components).transform(vectors).withColumnRenamed("id", id_col)
