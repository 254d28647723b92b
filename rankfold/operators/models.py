"""Member learners as ``pyspark.ml`` estimators. Boosting that stops early and its metrics are in ``boosting``.

Each recipe maps one family of the reference's model zoo onto the closest Spark ML
learner; parameters default to the reference's values where Spark has the knob.
Quality parity with the original boosting/neural libraries is not claimed.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.operators.crossfit import FITS, positive_probability


def gbt_binary(features: str = "features", label: str = "target", max_iter: int = 100, step: float = 0.1,
               max_depth: int = 4, feature_fraction: float = 0.6, subsample: float = 0.9,
               min_instances: int = 1, seed: int = 0) -> GBTClassifier:
    """Boosted trees with logistic loss (lgbm3 / lgbm1 / lgbm8 / xgb0 members)."""
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, stepSize=step, maxDepth=max_depth,
                         maxBins=256, featureSubsetStrategy=str(feature_fraction), subsamplingRate=subsample,
                         minInstancesPerNode=min_instances, seed=seed)


def gbt_regressor(features: str = "features", label: str = "y", max_iter: int = 500, step: float = 0.1,
                  max_depth: int = 6, subsample: float = 0.9, feature_fraction: float = 0.85,
                  loss: str = "squared", seed: int = 0) -> GBTRegressor:
    """Squared-error boosted trees (OOF feature targets); ``loss='absolute'`` is the robust member."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=max_iter, stepSize=step, maxDepth=max_depth,
                        subsamplingRate=subsample, featureSubsetStrategy=str(feature_fraction), lossType=loss, seed=seed)


def count_loss(features: str = "features", label: str = "target", max_iter: int = 25) -> GeneralizedLinearRegression:
    """Poisson-loss member on the 0/1 label (log link); its prediction is only used through its rank."""
    return GeneralizedLinearRegression(featuresCol=features, labelCol=label, family="poisson", link="log",
                                       maxIter=max_iter, regParam=1e-6)


def gbt_sampled(seed: int = 0, **kw) -> GBTClassifier:
    """Gradient-sampled boosting member re-aimed to stochastic row subsampling."""
    kw.setdefault("subsample", 0.7)
    return gbt_binary(seed=seed, **kw)


def gbt_scaled(seed: int = 0, **kw) -> GBTClassifier:
    """Boosted trees on the standard-scaled wide matrix (the "linear"-named member, tree booster)."""
    kw.setdefault("max_depth", 5)
    return gbt_binary(seed=seed, **kw)


def logistic(features: str = "features", label: str = "target", C: float = 25.0, n_rows: int = 1,
             max_iter: int = 100) -> LogisticRegression:
    """L2 logistic regression with sklearn's C: regParam = 1 / (C * n)."""
    return LogisticRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0,
                              regParam=1.0 / (C * max(n_rows, 1)), standardization=False, maxIter=max_iter)


def mlp(n_inputs: int, features: str = "features", label: str = "target", hidden=(512, 64), max_iter: int = 35,
        block: int = 512, seed: int = 0) -> MultilayerPerceptronClassifier:
    """Two hidden layers (512 -> 64) and a 2-way softmax output; full-batch L-BFGS in blocks of 512 rows."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                          layers=[n_inputs, *hidden, 2], maxIter=max_iter, blockSize=block, seed=seed)


def predict_positive(model, df: DataFrame, key: str = "id") -> DataFrame:
    """(key, score) with the probability of class 1 (or the raw prediction for regressors)."""
    out = model.transform(df)
    if "probability" in out.columns:
        return out.select(key, positive_probability().alias("score"))
    return out.select(key, F.col("prediction").cast("double").alias("score"))


def bagged_scores(make: Callable[[int], Estimator], seeds: Sequence[int], train: DataFrame, test: DataFrame, key: str = "id",
                  parallelism: int = FITS) -> DataFrame:
    """(key, score): mean over ``seeds`` of the test scores of ``make(seed)`` fitted on all of ``train``. The fits do not depend on each
    other; a small driver pool submits ``parallelism`` of them at a time."""
    with ThreadPoolExecutor(max_workers=max(min(len(seeds), parallelism), 1)) as pool:
        parts = list(pool.map(lambda s: predict_positive(make(s).fit(train), test, key), seeds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.avg("score").alias("score"))


def staged_scores(model, df: DataFrame, key: str = "id", keep=("fold",)) -> DataFrame:
    """(key, keep..., round, score): the margin of every prefix of a boosted model's trees, in one pass over ``df``."""
    columns = [c for c in keep if c in df.columns]
    staged, prefix = df, []
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        tree = tree.copy()
        tree.setPredictionCol(f"_t{i}")
        staged = tree.transform(staged)
        step = F.lit(float(weight)) * F.col(f"_t{i}")
        prefix.append(step if i == 0 else F.col(f"_m{i - 1}") + step)
        staged = staged.withColumn(f"_m{i}", prefix[-1])
    rounds = F.array(*[F.struct(F.lit(i + 1).alias("round"), F.col(f"_m{i}").alias("score")) for i in range(len(prefix))])
    return staged.select(key, *columns, F.inline(rounds))


def predict_prefix(model, df: DataFrame, rounds: int, key: str = "id") -> DataFrame:
    """(key, score) of the first ``rounds`` trees: the probability of class 1 under the logistic loss."""
    staged = staged_scores(model, df, key, keep=()).where(F.col("round") == rounds)
    return staged.select(key, (1 / (1 + F.exp(-2 * F.col("score")))).alias("score"))
