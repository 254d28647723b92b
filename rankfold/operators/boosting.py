"""Boosting that goes on round by round and stops when a metric on validation rows has not improved for some rounds.

The rows of all models (one per fold, say) are one table with a ``model``, a ``role`` (``fit``, ``valid`` or ``score``) and a
persisted ``margin``. A round fits a weak learner to the gradients of the fit rows of all running models, adds its step to
the margins, and asks the metric for one value per model. A model whose best value is ``patience`` rounds old
is finished; its later rounds are never fitted. Each row also keeps the margin of its model's best round, so the same
round scores out-of-fold and test rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Protocol, Sequence

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.operators.linear import moments
from rankfold.operators.order import gini
from rankfold.session import materialize

FIT, VALID, SCORE = "fit", "valid", "score"
BLOCK = 4  # rounds between two writes of the margins


# ---------------------------------------------------------------- metrics

class GiniEvaluator(Evaluator):
    """Normalized Gini of ``scoreCol`` against ``labelCol``; larger is better. ``values`` gives one per group in one job."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "score column", TypeConverters.toString)

    def __init__(self, labelCol: str = "target", scoreCol: str = "score"):
        super().__init__()
        self._setDefault(labelCol="target", scoreCol="score")
        self._set(labelCol=labelCol, scoreCol=scoreCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        value = gini(dataset, self.getOrDefault(self.labelCol), self.getOrDefault(self.scoreCol)).first()
        return float(value["gini"]) if value is not None and value["gini"] is not None else 0.0

    def values(self, dataset: DataFrame, by: Sequence[str]) -> DataFrame:
        found = gini(dataset, self.getOrDefault(self.labelCol), self.getOrDefault(self.scoreCol), by=by)
        return found.select(*by, F.col("gini").alias("value"))

    def isLargerBetter(self) -> bool:
        return True


class LossEvaluator(GiniEvaluator):
    """Mean absolute difference of label and probability, the score being a margin in log odds; smaller is better."""

    def values(self, dataset: DataFrame, by: Sequence[str]) -> DataFrame:
        label, score = self.getOrDefault(self.labelCol), self.getOrDefault(self.scoreCol)
        return dataset.groupBy(*by).agg(F.avg(F.abs(F.col(label) - probability(F.col(score)))).alias("value"))

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(self.values(dataset, []).first()["value"] or 0.0)

    def isLargerBetter(self) -> bool:
        return False


def probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


# ---------------------------------------------------------------- weak learners

class WeakLearner(Protocol):
    def start(self, rows: DataFrame) -> DataFrame: ...

    def step(self, fit_rows: DataFrame, gradient: str, models: Sequence) -> Callable[[DataFrame], DataFrame]: ...


@dataclass
class BestStump:
    """One split per model and round: of all columns and cuts (mean plus ``at`` deviations) the one that lowers the squared
    error of the gradients most, the first of several. The sums for all models come from one aggregate."""

    columns: Sequence[str]
    at: Sequence[float] = (-1.0, -0.5, 0.0, 0.5, 1.0)

    def start(self, rows: DataFrame) -> DataFrame:
        scale = moments(rows, self.columns)
        self.cuts = [(c, scale[c][0] + t * scale[c][1]) for c in self.columns for t in self.at]
        return rows

    def above(self, i: int) -> Column:
        c, cut = self.cuts[i]
        return F.col(c).cast("double") > F.lit(cut)

    def step(self, fit_rows: DataFrame, gradient: str, models: Sequence) -> Callable[[DataFrame], DataFrame]:
        g, n = F.col(gradient), len(self.cuts)
        sums = [F.count(F.lit(1)).alias("n"), F.sum(g).alias("s")]
        sums += [c for i in range(n) for c in (F.count(F.when(self.above(i), 1)).alias(f"n{i}"),
                                               F.coalesce(F.sum(F.when(self.above(i), g)), F.lit(0.0)).alias(f"s{i}"))]
        chosen = {}
        for r in fit_rows.groupBy("model").agg(*sums).collect():
            best = None
            for i in range(n):
                high, low = r[f"n{i}"], r["n"] - r[f"n{i}"]
                if high and low:
                    gain = r[f"s{i}"] ** 2 / high + (r["s"] - r[f"s{i}"]) ** 2 / low
                    if best is None or gain > best[0]:
                        best = (gain, i, r[f"s{i}"] / high, (r["s"] - r[f"s{i}"]) / low)
            chosen[r["model"]] = best

        def add(df: DataFrame) -> DataFrame:
            value = F.lit(0.0)
            for m, best in chosen.items():
                if best is not None:
                    _, i, high, low = best
                    value = F.when(F.col("model") == m, F.when(self.above(i), high).otherwise(low)).otherwise(value)
            return df.withColumn("_step", value)
        return add


@dataclass
class TreeStep:
    """A ``pyspark.ml`` regression tree per model and round."""

    features: str = "features"
    depth: int = 4
    seed: int = 0

    def start(self, rows: DataFrame) -> DataFrame:
        return rows

    def step(self, fit_rows: DataFrame, gradient: str, models: Sequence) -> Callable[[DataFrame], DataFrame]:
        tree = DecisionTreeRegressor(featuresCol=self.features, labelCol=gradient, predictionCol="_step", maxDepth=self.depth, seed=self.seed)
        fitted = {m: tree.fit(fit_rows.where(F.col("model") == m)) for m in models}

        def add(df: DataFrame) -> DataFrame:
            out = None
            for m, t in fitted.items():
                part = t.transform(df.where(F.col("model") == m))
                out = part if out is None else out.unionByName(part)
            return out
        return add


# ---------------------------------------------------------------- the loop

@dataclass
class Boosted:
    """``scores``: all rows with the margin of their model's best round as ``score``; ``history``: (model, round, value, best, stop)."""

    scores: DataFrame
    history: list[tuple]


def with_roles(rows: DataFrame, k: int, fold: str = "fold", seed: int = 0, share: float = 0.1875, key: str = "id") -> DataFrame:
    """Every row once per model: of model f the rows of fold f are scored, a seeded share of the others validates, the rest is fitted."""
    cut = f"{int(share * 16 ** 8):08x}"
    valid = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":valid:{seed}"))), 1, 8) < F.lit(cut)
    each = rows.select("*", F.explode(F.array(*[F.lit(f) for f in range(k)])).alias("model"))
    return each.withColumn("role", F.when(F.col("model") == F.col(fold), SCORE).when(valid, VALID).otherwise(FIT))


def boost(rows: DataFrame, learner: WeakLearner, metric: GiniEvaluator | None = None, label: str = "target", rounds: int = 100, rate: float = 0.1,
          patience: int = 10, digits: int = 6, block: int = BLOCK) -> Boosted:
    """Boost the logistic loss of all models of ``rows`` (``model``, ``role``, ``label`` and the learner's columns).

    ``metric`` is the hook: anything with ``values(df, by)`` and ``isLargerBetter()``. Its values are compared after rounding to ``digits``, so
    the last bits of a sum cannot pass for progress. Rounds and models bound what reaches the driver.
    """
    metric = metric or GiniEvaluator(label, "margin")
    sign = 1.0 if metric.isLargerBetter() else -1.0
    state = materialize(learner.start(rows).withColumn("margin", F.lit(0.0)).withColumn("score", F.lit(0.0)), "boost")
    running, done, history = sorted(r[0] for r in state.select("model").distinct().collect()), [], {}
    best = {m: (0, None) for m in running}
    for turn in range(1, rounds + 1):
        if not running:
            break
        gradient = state.where(F.col("role") == FIT).withColumn("_gradient", F.col(label) - probability(F.col("margin")))
        state = learner.step(gradient, "_gradient", running)(state)
        state = state.withColumn("margin", F.col("margin") + F.lit(rate) * F.col("_step")).drop("_step")
        if turn % block == 0:
            state = materialize(state, "boost")
        seen = {r["model"]: r["value"] for r in metric.values(state.where(F.col("role") == VALID), ["model"]).collect()}
        better, ended = [], []
        for m in running:
            value = seen.get(m)
            value = None if value is None else round(value, digits)
            history.setdefault(m, []).append(value)
            if value is not None and (best[m][1] is None or sign * value > sign * best[m][1]):
                best[m] = (turn, value)
                better.append(m)
            elif turn - max(best[m][0], 1) >= patience:
                ended.append(m)
        if better:
            state = state.withColumn("score", F.when(F.col("model").isin(better), F.col("margin")).otherwise(F.col("score")))
        if ended:
            state = materialize(state, "boost")
            done.append(state.where(F.col("model").isin(ended)))
            running = [m for m in running if m not in ended]
            state = state.where(F.col("model").isin(running))
    out = state
    for d in done:
        out = out.unionByName(d)
    table = [(m, i, v, max(best[m][0], 1), len(values)) for m, values in sorted(history.items()) for i, v in enumerate(values, 1)]
    return Boosted(materialize(out.drop("margin"), "boosted"), table)
