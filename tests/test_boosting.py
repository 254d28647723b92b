"""Boosting that stops: the loop against a plain one, the patience rule, the metric hook, other learners."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from rankfold.operators import boosting as BO
from rankfold.operators import order as OR


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.8 * rng.normal(size=300) > 0.7).astype(int)
    return pd.DataFrame(x, columns=list("abc")).assign(id=range(300), fold=np.arange(300) % 2, target=y)


@pytest.fixture(scope="module")
def roles(spark, pdf):
    return BO.with_roles(spark.createDataFrame(pdf).coalesce(2), 2, share=0.25)


def slow_boost(pdf, rounds, rate):
    """Margins after every round of one model's rows (column ``role`` given)."""
    cuts = [(c, pdf[c].mean() + t * pdf[c].std(ddof=0)) for c in "abc" for t in (-1.0, -0.5, 0.0, 0.5, 1.0)]
    margin, out = np.zeros(len(pdf)), []
    fit = (pdf["role"] == "fit").to_numpy()
    for _ in range(rounds):
        g = pdf["target"].to_numpy() - 1 / (1 + np.exp(-margin))
        best = None
        for c, cut in cuts:
            z = (pdf[c] > cut).to_numpy()
            hi, lo = g[fit & z], g[fit & ~z]
            if len(hi) and len(lo):
                gain = hi.sum() ** 2 / len(hi) + lo.sum() ** 2 / len(lo)
                if best is None or gain > best[0]:
                    best = (gain, np.where(z, hi.mean(), lo.mean()))
        margin = margin + rate * best[1]
        out.append(margin)
    return out


def test_rounds_follow_a_plain_loop(roles, pdf):
    got = BO.boost(roles, BO.BestStump(list("abc")), rounds=7, rate=0.5, patience=3)
    scores = got.scores.toPandas()
    assert len(scores) == 600 and set(scores["role"]) == {"fit", "valid", "score"}
    for m in range(2):
        mine = scores[scores["model"] == m].sort_values("id").reset_index(drop=True)
        assert ((mine["role"] == "score") == (mine["fold"] == m)).all()
        # Cuts come from all rows, which hold every id once per model.
        margins = slow_boost(mine, 7, 0.5)
        history = [h for h in got.history if h[0] == m]
        best, stop = history[0][3], history[0][4]
        assert [h[1] for h in history] == list(range(1, stop + 1)) and (stop == 7 or stop - best == 3)
        assert mine["score"].to_numpy() == pytest.approx(margins[best - 1])
        valid = (mine["role"] == "valid").to_numpy()
        y = mine["target"].to_numpy()[valid]
        for _, r, value, _, _ in history:
            s = margins[r - 1][valid]
            d = s[y == 1][:, None] - s[y == 0][None, :]
            assert value == pytest.approx((d > 0).mean() - (d < 0).mean(), abs=1e-6)
        values = [h[2] for h in history]
        assert values.index(max(values)) + 1 == best


class Told:
    """A metric that gives prepared values and counts how often it is asked."""

    def __init__(self, values, larger=True):
        self.told, self.larger, self.asked = values, larger, 0

    def values(self, df, by):
        self.asked += 1
        return df.groupBy(*by).agg(F.lit(self.told[self.asked - 1]).cast("double").alias("value"))

    def isLargerBetter(self):
        return self.larger


@pytest.mark.parametrize("values,larger,patience,best,stop", [
    ([.1, .3, .2, .25, .4], True, 3, 5, 5), ([None] * 2, True, 5, 1, 2), ([.2, .2 + 1e-9, .2, .3], True, 2, 1, 3), ([.5, .4, .45, .44, .1], False, 2, 2, 4)])
def test_patience_rule(roles, values, larger, patience, best, stop):
    metric = Told(values, larger)
    got = BO.boost(roles, BO.BestStump(["a"]), metric=metric, rounds=len(values), patience=patience)
    assert {(h[3], h[4]) for h in got.history} == {(best, stop)}
    assert metric.asked == stop  # later rounds are never fitted


def test_another_metric_changes_the_round(roles):
    how = dict(rounds=6, rate=0.5, patience=2)
    by_gini = BO.boost(roles, BO.BestStump(list("abc")), metric=BO.GiniEvaluator("target", "margin"), **how)
    by_loss = BO.boost(roles, BO.BestStump(list("abc")), metric=BO.LossEvaluator("target", "margin"), **how)
    assert {h[:1] + h[3:] for h in by_gini.history} != {h[:1] + h[3:] for h in by_loss.history}


def test_trees_boost_too(spark, pdf):
    df = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(pdf))
    got = BO.boost(BO.with_roles(df.select("id", "fold", "target", "features"), 2), BO.TreeStep(depth=3), rounds=2, rate=0.5, patience=2)
    oof = got.scores.where("role = 'score'")
    assert oof.count() == oof.select("id").distinct().count() == 300
    assert OR.gini(oof, "target", "score").first()["gini"] > 0.3


def test_no_rows(spark, roles):
    got = BO.boost(roles.limit(0), BO.BestStump(["a"]), rounds=3)
    assert got.history == [] and got.scores.count() == 0


def test_evaluator_steers_cross_validation(spark, pdf):
    df = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(pdf))
    df = df.withColumn("label", F.col("target"))

    class Positive(BO.GiniEvaluator):
        def _evaluate(self, dataset):
            return super()._evaluate(dataset.withColumn("score", vector_to_array("probability")[1]))

    hook = Positive("target", "score")
    assert hook.copy().getOrDefault("labelCol") == "target" and hook.isLargerBetter()
    lr = LogisticRegression(maxIter=20)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 100.0]).addGrid(lr.elasticNetParam, [1.0]).build()
    fitted = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=hook, numFolds=2, seed=1).fit(df)
    assert fitted.avgMetrics[0] > fitted.avgMetrics[1] and fitted.bestModel.getRegParam() == 0.01
