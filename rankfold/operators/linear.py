"""Linear learners cross-fitted for all folds at once: one aggregate per step, one projection for all scores.

* ``oof_gram_features``: the sums of products of every pair of columns per fold, once; every target is solved from
  its part of the matrix.
* ``glm_crossfit``: reweighted least squares. A step reads the rows once, gives each row to the models that may learn from
  it (all but its own fold's) inside the task, and adds up one weighted matrix per model; only those sums leave it.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9  # share of its own sum of squares that the columns before it must leave of a column
TOP = 30.0  # linear predictors of exponential families are held within this bound


def sweep_solve(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve the normal equations by Gauss-Jordan steps; a column that the ones before it explain gets weight 0."""
    p = len(left)
    a, scale = np.hstack([left, right.reshape(p, -1)]).astype(float), np.diag(left).copy()
    for i in range(p):
        row = a[i] / a[i, i] if a[i, i] > TOLERANCE * scale[i] else np.zeros(a.shape[1])
        column = a[:, i].copy()
        a -= np.outer(column, row)
        a[i] = row
    return a[:, p:].reshape(right.shape)


def moments(df: DataFrame, xs: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 for a constant) of every column."""
    r = df.agg(*[f(F.col(x).cast("double")).alias(f"{n}_{x}") for x in xs for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {x: (r[f"m_{x}"] or 0.0, r[f"s_{x}"] or 1.0) for x in xs}


def _products(terms: Sequence[Column], weight: Column | None = None) -> list[Column]:
    """Sums of the products of every pair of terms."""
    return [F.sum((terms[i] if weight is None else weight * terms[i]) * terms[j]).alias(f"s_{i}_{j}")
            for i in range(len(terms)) for j in range(i, len(terms))]


def _matrix(row, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            m[i, j] = m[j, i] = row[f"s_{i}_{j}"] or 0.0
    return m


# ---------------------------------------------------------------- out-of-fold features from one Gram matrix

def oof_gram_features(df: DataFrame, predictors: dict[str, Sequence[str]], fold: str = "fold", fmt: str = "oof_{}") -> DataFrame:
    """Every target regressed on its predictors by least squares, cross-fitted; adds the held-out prediction of each.

    All sums of products of all columns come from one aggregate with a row per fold; a fit uses the sums of the other folds.
    Rows with a missing value in any column are in no fit; a missing predictor gives NULL.
    """
    columns = list(dict.fromkeys([*predictors, *[x for xs in predictors.values() for x in xs]]))
    at = {c: i + 1 for i, c in enumerate(columns)}
    means = moments(df, columns)
    shifted = {c: F.col(c).cast("double") - F.lit(means[c][0]) for c in columns}
    whole = df
    for c in columns:
        whole = whole.where(F.col(c).isNotNull())
    size = len(columns) + 1
    sums = {r[fold]: _matrix(r, size) for r in
            whole.groupBy(fold).agg(*_products([F.lit(1.0), *[shifted[c] for c in columns]])).collect()}
    total = sum(sums.values(), np.zeros((size, size)))
    # Targets with the same predictors are solved together.
    families: dict[tuple, list[str]] = {}
    for y, xs in predictors.items():
        families.setdefault(tuple(xs), []).append(y)
    rows = []
    for f in [r[0] for r in df.select(fold).distinct().collect()]:
        m, weights = total - sums.get(f, 0.0), {}
        for xs, ys in families.items():
            i, j = [0, *[at[x] for x in xs]], [at[y] for y in ys]
            solved = sweep_solve(m[np.ix_(i, i)], m[np.ix_(i, j)])
            for k, y in enumerate(ys):
                weights |= {(y, x): float(w) for x, w in zip(["", *xs], solved[:, k])}
        rows.append((f, weights))
    names = {key: f"_w{n}" for n, key in enumerate(rows[0][1])} if rows else {}
    kind = df.schema[fold].dataType.simpleString()
    model = df.sparkSession.createDataFrame([(f, *w.values()) for f, w in rows], ", ".join([f"{fold} {kind}", *[f"{n} double" for n in names.values()]]))
    new = []
    for y, xs in predictors.items():
        guess = F.lit(None).cast("double")
        if rows:
            guess = F.col(names[y, ""]) + F.lit(means[y][0])
            for x in xs:
                guess = guess + F.col(names[y, x]) * shifted[x]
        new.append(guess.alias(fmt.format(y)))
    # One row per fold.
    return df.join(F.broadcast(model), fold).select(*df.columns, *new)


# ---------------------------------------------------------------- reweighted least squares

def _held(eta: Column) -> Column:
    return F.when(eta > TOP, F.lit(TOP)).when(eta < -TOP, F.lit(-TOP)).otherwise(eta)


def _working(family: str, eta: Column, y: Column, c: float) -> tuple[Column, Column]:
    """Weight of a row and its weighted working response."""
    if family == "fair":  # loss c**2 * (abs(r) / c - log(1 + abs(r) / c))
        w = F.lit(1.0) / (F.lit(1.0) + F.abs(y - eta) / F.lit(c))
        return w, w * y
    held = _held(eta)
    mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-held)) if family == "binomial" else F.exp(held)
    w = mu * (F.lit(1.0) - mu) if family == "binomial" else mu
    return w, w * held + (y - mu)


def _response(family: str, eta: Column) -> Column:
    if family == "fair":
        return eta
    held = _held(eta)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-held)) if family == "binomial" else F.exp(held)


def _eta(terms: Sequence[Column], weights) -> Column:
    total = weights(0) * terms[0]
    for i in range(1, len(terms)):
        total = total + weights(i) * terms[i]
    return total


def glm_crossfit(train: DataFrame, xs: Sequence[str], y: str = "target", family: str = "binomial", steps: int = 8, l2: float = 0.0,
                 c: float = 1.0, fold: str = "fold", test: DataFrame | None = None, key: str = "id", seed: int = 0,
                 models: Sequence[int] | None = None) -> DataFrame:
    """Cross-fit a linear learner on the standardised columns ``xs`` with an intercept: key, split, fold, seed, score.

    ``family``: ``binomial`` (log odds), ``poisson`` (log link) or ``fair`` (robust loss with scale ``c``). ``l2`` is the
    penalty of half the squared weights, the intercept's excepted. Every one of ``steps`` steps is one job over the training rows for
    all folds; the folds' small matrices are solved on the driver. Scales come from all training rows, as in the reference's
    order of work. Rows with a missing column are in no fit and get no score. A model learns from all folds but its own; ``models``
    names them (by default the folds), so one that is no fold learns from all rows.
    """
    if family not in ("binomial", "poisson", "fair"):
        raise ValueError(f"unknown family {family!r}")
    scales = moments(train, xs)

    def terms() -> list[Column]:
        return [F.lit(1.0), *[(F.col(x).cast("double") - F.lit(scales[x][0])) / F.lit(scales[x][1]) for x in xs]]

    size, folds = len(xs) + 1, list(models) if models is not None else sorted(r[0] for r in train.select(fold).distinct().collect())
    beta = {f: np.zeros(size) for f in folds}
    fit = train.select(F.col(fold).alias("_f"), F.col(y).cast("double").alias("_y"), *[t.alias(f"_x{i}") for i, t in enumerate(terms())])
    for i in range(size):
        fit = fit.where(F.col(f"_x{i}").isNotNull())
    fit, x = fit.where(F.col("_y").isNotNull()), [F.col(f"_x{i}") for i in range(size)]

    def fitted() -> Column:
        return F.inline(F.array(*[F.struct(F.lit(f).alias("_m"), F.array(*[F.lit(float(b)) for b in beta[f]]).alias("_b")) for f in folds]))

    for _ in range(steps if folds else 0):
        each = fit.select("*", fitted()).where(F.col("_m") != F.col("_f"))
        each = each.select("*", _eta(x, lambda i: F.col("_b")[i]).alias("_e"))
        w, z = _working(family, F.col("_e"), F.col("_y"), c)
        each = each.select("_m", *x, w.alias("_w"), z.alias("_z"))
        found = each.groupBy("_m").agg(*_products(x, F.col("_w")), *[F.sum(F.col("_z") * x[i]).alias(f"r_{i}") for i in range(size)]).collect()
        for r in found:
            left = _matrix(r, size) + l2 * np.diag([0.0, *[1.0] * len(xs)])
            beta[r["_m"]] = sweep_solve(left, np.array([r[f"r_{i}"] for i in range(size)], float))

    def scored(df: DataFrame, split: str) -> DataFrame:
        rows = df.select("*", fitted())
        rows = rows.where(F.col("_m") == F.col(fold)) if split == "train" else rows
        eta = _eta(terms(), lambda i: F.col("_b")[i])
        return rows.select(key, F.lit(split).alias("split"), F.col("_m").cast("int").alias("fold"), F.lit(seed).alias("seed"),
                           _response(family, eta).alias("score"))

    if not folds:
        return train.select(key, F.lit("train").alias("split"), F.col(fold).cast("int").alias("fold"), F.lit(seed).alias("seed"),
                            F.lit(None).cast("double").alias("score"))
    out = scored(train, "train")
    return out if test is None else out.unionByName(scored(test, "test"))
