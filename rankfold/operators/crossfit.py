"""Folds, cross-fitting (out-of-fold predictions), test averaging and seed bagging.

Folds are deterministic and hash-ordered: within each label class rows are put in
``md5(id:seed)`` order and dealt round-robin into k folds, which preserves the label
share per fold (stratification) and is the same on every engine and every re-run.
The position inside the hash order comes from the bucketed prefix sum of
``rankfold.operators.order`` (buckets = hash prefixes), never from a global sort.

Scores leave every cross-fit in one long layout:
``id, split ('train' = out-of-fold, 'test'), fold, seed, score``.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.operators.order import gini, hash_order_position
from rankfold.session import materialize

FOLD_SEED = 218
# Fits that a driver pool submits at a time; each holds its own rows in the executors' storage.
FITS = 8


def fold_hash(key: str = "id", seed: int = FOLD_SEED) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def assign_folds(df: DataFrame, k: int = 5, seed: int = FOLD_SEED, by: Sequence[str] = (), key: str = "id",
                 out: str = "fold", prefix_len: int | None = None) -> DataFrame:
    """``fold = position in (md5(key:seed), key) order within ``by`` mod k``."""
    h = df.withColumn("_h", fold_hash(key, seed))
    pos = hash_order_position(h, "_h", key, by=by, prefix_len=prefix_len, out="_pos")
    return pos.withColumn(out, (F.col("_pos") % k).cast("int")).drop("_h", "_pos")


def stratified_folds(df: DataFrame, label: str = "target", k: int = 5, seed: int = FOLD_SEED,
                     key: str = "id") -> DataFrame:
    """StratifiedKFold equivalent: folds dealt separately inside each label class."""
    return assign_folds(df, k=k, seed=seed, by=[label], key=key)


def kfold(df: DataFrame, k: int = 5, seed: int = FOLD_SEED, key: str = "id") -> DataFrame:
    """Shuffled unstratified KFold equivalent."""
    return assign_folds(df, k=k, seed=seed, key=key)


# ---------------------------------------------------------------- deterministic subsampling

def subsample_flag(frac: float | None, seed: int, key: str = "id") -> Column:
    """Row-level bagging mask: the first eight hex digits of ``md5(key:bag:seed)`` below ``frac * 16**8``."""
    if frac is None or frac >= 1.0:
        return F.lit(True)
    cut = f"{int(frac * 16 ** 8):08x}"
    return F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":bag:{seed}"))), 1, 8) < F.lit(cut)


# ---------------------------------------------------------------- OLS learner, fused cross-fit

def ols_crossfit(train: DataFrame, x: str, y: str, fold: str = "fold", test: DataFrame | None = None,
                 subsample: float | None = None, seed: int = 0, key: str = "id") -> DataFrame:
    """Cross-fit a one-variable least-squares learner ``y ~ a + b*x``.

    For every fold f the model is fitted on the training rows outside f (optionally a
    seeded hash subsample of them) and predicts the rows of f (out-of-fold) and all
    test rows. All k fits come from one pass: per-fold sufficient statistics
    (n, sum x, sum y, sum xy, sum xx) minus the fold's own share; the k-row model table
    is broadcast (its size is the fold count).
    Output: key, split, fold, seed, score.
    """
    use = subsample_flag(subsample, seed, key)
    fit_rows = train.where(use & F.col(x).isNotNull() & F.col(y).isNotNull())
    # Shift by the training means (two numbers read on the driver) so the sums of squares
    # and products below do not cancel; the slope is shift-invariant.
    c = fit_rows.agg(F.avg(F.col(x).cast("double")).alias("cx"), F.avg(F.col(y).cast("double")).alias("cy")).first()
    cx, cy = (c["cx"] or 0.0), (c["cy"] or 0.0)
    xd, yd = F.col(x).cast("double") - F.lit(cx), F.col(y).cast("double") - F.lit(cy)
    per = fit_rows.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), F.sum(xd).alias("sx"), F.sum(yd).alias("sy"),
        F.sum(xd * yd).alias("sxy"), F.sum(xd * xd).alias("sxx"))
    tot = per.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxy", "sxx")])
    # The fold list comes from the training rows, so a fold without fitting rows still gets a model.
    folds = train.select(fold).distinct()
    m = _with_totals(folds.join(per, fold, "left"), tot)
    n = F.col("t_n") - F.coalesce(F.col("n"), F.lit(0))
    sx = F.col("t_sx") - F.coalesce(F.col("sx"), F.lit(0.0))
    sy = F.col("t_sy") - F.coalesce(F.col("sy"), F.lit(0.0))
    sxy = F.col("t_sxy") - F.coalesce(F.col("sxy"), F.lit(0.0))
    sxx = F.col("t_sxx") - F.coalesce(F.col("sxx"), F.lit(0.0))
    cov = sxy - sx * sy / n
    var = sxx - sx * sx / n
    slope = F.try_divide(cov, var)
    # Intercept in the original units: y = cy + sy/n + b * (x - cx - sx/n).
    intercept = F.lit(cy) + sy / n - slope * (F.lit(cx) + sx / n)
    model = m.select(fold, slope.alias("_b"), intercept.alias("_a"))
    oof = train.join(F.broadcast(model), fold).select(
        key, F.lit("train").alias("split"), F.col(fold).cast("int").alias("fold"),
        (F.col("_a") + F.col("_b") * F.col(x).cast("double")).alias("score"))
    out = oof
    if test is not None:
        out = out.unionByName(_per_model(test, model, x, key, fold))
    return out.withColumn("seed", F.lit(seed))


def ols_crossfit_seeds(train: DataFrame, x: str, y: str, seeds: Sequence[int], fold: str = "fold", test: DataFrame | None = None,
                       subsample: float | None = None, key: str = "id") -> DataFrame:
    """``ols_crossfit`` for many seeds at once: the sums of all (fold, seed) pairs come from one aggregate over the training rows and
    all scores from one projection per table. Output: key, split, fold, seed, score."""
    whole = train.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    c = whole.agg(F.avg(F.col(x).cast("double")).alias("cx"), F.avg(F.col(y).cast("double")).alias("cy")).first()
    cx, cy = (c["cx"] or 0.0), (c["cy"] or 0.0)
    xd, yd = F.col(x).cast("double") - F.lit(cx), F.col(y).cast("double") - F.lit(cy)
    used = whole.select(fold, xd.alias("_x"), yd.alias("_y"), *[subsample_flag(subsample, s, key).alias(f"_u{i}") for i, s in enumerate(seeds)])
    terms = (F.lit(1.0), F.col("_x"), F.col("_y"), F.col("_x") * F.col("_y"), F.col("_x") * F.col("_x"))
    sums = [F.coalesce(F.sum(F.when(F.col(f"_u{i}"), t)), F.lit(0.0)).alias(f"s{i}_{j}") for i in range(len(seeds)) for j, t in enumerate(terms)]
    own = {r[fold]: r for r in used.groupBy(fold).agg(*sums).collect()}
    folds = sorted(r[0] for r in train.select(fold).distinct().collect())
    models = []
    for f in folds:
        for i, s in enumerate(seeds):
            n, sx, sy, sxy, sxx = (sum(r[f"s{i}_{j}"] for g, r in own.items() if g != f) for j in range(5))
            var = sxx - sx * sx / n if n else 0.0
            if var:
                b = (sxy - sx * sy / n) / var
                models.append((int(f), int(s), cy + sy / n - b * (cx + sx / n), b))
            else:  # no line through fewer than two points
                models.append((int(f), int(s), None, None))
    if not models:
        return train.select(key, F.lit("train").alias("split"), F.col(fold).cast("int").alias("fold"), F.lit(0).alias("seed"),
                            F.lit(None).cast("double").alias("score")).limit(0)
    shape = "array<struct<_f:int,seed:int,_a:double,_b:double>>"
    table = F.from_json(F.lit(json.dumps([dict(zip(("_f", "seed", "_a", "_b"), m)) for m in models])), shape)

    def scored(df: DataFrame, split: str, which: Column) -> DataFrame:
        rows = df.select(key, F.col(x).cast("double").alias("_x"), F.inline(which))
        return rows.select(key, F.lit(split).alias("split"), F.col("_f").alias("fold"), "seed", (F.col("_a") + F.col("_b") * F.col("_x")).alias("score"))

    out = scored(train, "train", F.filter(table, lambda m: m["_f"] == F.col(fold)))
    return out if test is None else out.unionByName(scored(test, "test", table))


def _with_totals(per: DataFrame, tot: DataFrame) -> DataFrame:
    """Attach the one-row totals as literal columns (read on the driver: five numbers)."""
    r = tot.first()
    return per.select("*", *[F.lit(r[c]).alias(c) for c in tot.columns])


def _per_model(test: DataFrame, model: DataFrame, x: str, key: str, fold: str) -> DataFrame:
    """Score every test row with each of the k fold models (k read on the driver: k <= fold count)."""
    rows = model.collect()
    models = F.array(*[F.struct(F.lit(int(r[fold])).alias("fold"), F.lit(r["_a"]).cast("double").alias("_a"),
                                F.lit(r["_b"]).cast("double").alias("_b")) for r in rows])
    # One scan of the test rows; each row is scored by every fold model.
    t = test.select(key, F.col(x).cast("double").alias("_x"), F.inline(models))
    return t.select(key, F.lit("test").alias("split"), "fold", (F.col("_a") + F.col("_b") * F.col("_x")).alias("score"))


# ---------------------------------------------------------------- generic spark.ml cross-fit

def positive_probability(col: str = "probability") -> Column:
    """Probability of class 1 from a spark.ml probability vector."""
    return vector_to_array(col)[1]


def ml_crossfit(train: DataFrame, estimator: Estimator | Callable[[DataFrame], Estimator], fold: str = "fold", k: int | None = None,
                test: DataFrame | None = None, key: str = "id", seed: int = 0,
                score: Callable[[], Column] | None = None, parallelism: int | None = None) -> DataFrame:
    """Fit ``estimator`` on all folds but f, predict fold f and the test rows, for every fold.

    Each fit is a row of distributed jobs; a small driver pool submits ``parallelism`` fits at a time, by default all of them, so that
    none is left to run alone after the others.
    ``estimator`` may be a function of the fitting rows, for settings that depend on them.
    ``train``/``test`` should be materialised (``rankfold.session.materialize``) first
    so every fit rescans a written table instead of the whole feature plan.
    Output: key, split, fold, seed, score.
    """
    score = score or (lambda: positive_probability())
    folds = list(range(k)) if k is not None else sorted(r[0] for r in train.select(fold).distinct().collect())

    def one(f: int) -> list[DataFrame]:
        rows = train.where(F.col(fold) != f)
        model = (estimator(rows) if callable(estimator) else estimator).fit(rows)
        parts = [model.transform(train.where(F.col(fold) == f)).select(key, F.lit("train").alias("split"), F.lit(f).alias("fold"),
                                                                       score().alias("score"))]
        if test is not None:
            parts.append(model.transform(test).select(key, F.lit("test").alias("split"), F.lit(f).alias("fold"), score().alias("score")))
        return parts

    with ThreadPoolExecutor(max_workers=parallelism or max(len(folds), 1)) as pool:
        parts = [p for found in pool.map(one, folds) for p in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("seed", F.lit(seed))


# ---------------------------------------------------------------- out-of-fold target features

def oof_learned_features(df: DataFrame, predictors: dict[str, Sequence[str]], learner: Callable[[str, str], Estimator], k: int = 5,
                         fold: str = "fold", key: str = "id", fmt: str = "oof_{}", parallelism: int = FITS) -> DataFrame:
    """``linear.oof_gram_features`` with any ``pyspark.ml`` regressor: ``learner(features, label)`` makes one per target.

    Targets with the same predictors share a vector, and all vectors are written once, in one table. The fits of all targets and folds
    depend on nothing else, so one pool submits them, ``parallelism`` at a time. A fold's rows pass through the models of
    all targets in one scan: no table of scores is joined to another.
    """
    vectors: dict[tuple[str, ...], str] = {}
    for xs in predictors.values():
        vectors.setdefault(tuple(xs), f"_x{len(vectors)}")
    rows = df.select(key, fold, *dict.fromkeys([*predictors, *[c for xs in vectors for c in xs]]))
    for xs, name in vectors.items():
        rows = VectorAssembler(inputCols=list(xs), outputCol=name).transform(rows)
    rows = materialize(rows.select(key, fold, *predictors, *vectors.values()), "oof_rows")

    def fit(job: tuple[str, int]):
        y, f = job
        x = vectors[tuple(predictors[y])]
        return learner(x, y).fit(rows.where(F.col(fold) != f).select(x, y))

    jobs = [(y, f) for y in predictors for f in range(k)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        models = dict(zip(jobs, pool.map(fit, jobs)))
    out = None
    for f in range(k):
        part = rows.where(F.col(fold) == f)
        for y in predictors:
            part = models[y, f].transform(part).select(*part.columns, F.col("prediction").cast("double").alias(fmt.format(y)))
        part = part.select(key, fold, *[fmt.format(y) for y in predictors])
        out = part if out is None else out.unionByName(part)
    return materialize(out, "oof_scores")


# ---------------------------------------------------------------- combining fold / seed scores

def test_average(scores: DataFrame, key: str = "id") -> DataFrame:
    """Mean over folds of the test predictions: one score per (key, seed)."""
    return scores.where(F.col("split") == "test").groupBy(key, "seed").agg(F.avg("score").alias("score"))


def add_scores(total: DataFrame | None, part: DataFrame, key: str = "id") -> DataFrame:
    """Running sum of (key, score) tables, written once per step so no step repeats its predecessors."""
    if total is not None:
        part = total.unionByName(part).groupBy(key).agg(F.sum("score").alias("score"))
    return materialize(part, "running_scores")


def seed_average(scores: DataFrame, key: str = "id") -> DataFrame:
    """Mean over seeds per (key, split) (test scores first averaged over folds)."""
    oof = scores.where(F.col("split") == "train").select(key, "split", "seed", "score")
    tst = test_average(scores, key).select(key, F.lit("test").alias("split"), "seed", "score")
    return oof.unionByName(tst).groupBy(key, "split").agg(F.avg("score").alias("score"))


def running_seed_gini(oof: DataFrame, labels: DataFrame, label: str = "target", key: str = "id") -> DataFrame:
    """Gini of the running mean of out-of-fold scores after each seed: (seed, gini).

    The running mean is a per-key window over seeds (a handful of rows per key).
    """
    w = Window.partitionBy(key).orderBy("seed").rowsBetween(Window.unboundedPreceding, 0)
    run = oof.select(key, "seed", F.avg("score").over(w).alias("run_score"))
    # As long as the training rows, though its files may look small enough for a broadcast.
    j = run.join(labels.select(key, label).hint("merge"), key)
    return gini(j, label, "run_score", by=["seed"]).select("seed", "gini")
