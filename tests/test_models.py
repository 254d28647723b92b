"""Learners: score range, one score per id, repeatability, planted label, early stopping."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rankfold.operators import crossfit as CF
from rankfold.operators import models as MD
from rankfold.operators import order as OR
from rankfold.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=range(600), target=(x[:, 0] + 0.7 * rng.normal(size=600) > 0).astype(int))
    df = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(pdf))
    return materialize(CF.stratified_folds(df.select("id", "target", "features"), k=3), "model_rows")


@pytest.mark.parametrize("make", [
    lambda r: MD.gbt_binary(max_iter=5), lambda r: MD.gbt_sampled(max_iter=5), lambda r: MD.gbt_scaled(max_iter=5),
    lambda r: MD.logistic(n_rows=r.count(), max_iter=20), lambda r: MD.mlp(3, hidden=(8, 4), max_iter=20)])
def test_classifiers(rows, make):
    got = [CF.ml_crossfit(rows, make, k=3).toPandas().sort_values("id") for _ in range(2)]
    assert got[0]["id"].is_unique and len(got[0]) == 600 and got[0]["score"].between(0, 1).all()
    assert got[0]["score"].tolist() == pytest.approx(got[1]["score"].tolist())
    oof = CF.ml_crossfit(rows, make, k=3).join(rows.select("id", "target"), "id")
    assert OR.gini(oof, "target", "score").first()["gini"] > 0.3


@pytest.mark.parametrize("make", [MD.count_loss, lambda: MD.gbt_regressor(label="target", max_iter=5),
                                  lambda: MD.gbt_regressor(label="target", loss="absolute", max_iter=5)])
def test_regressors_rank_the_label(rows, make):
    oof = CF.ml_crossfit(rows, make(), k=3, score=lambda: F.col("prediction").cast("double")).join(rows.select("id", "target"), "id")
    assert OR.gini(oof, "target", "score").first()["gini"] > 0.3


def test_staged_margin_ends_at_the_models_own_score(rows):
    model = MD.gbt_binary(max_iter=4).fit(rows)
    own = MD.predict_positive(model, rows).withColumnRenamed("score", "own")
    last = MD.predict_prefix(model, rows, 4).join(own, "id").toPandas()
    assert last["score"].tolist() == pytest.approx(last["own"].tolist())


def test_boosted_oof_features_of_every_column():
    from rankfold.plans import catalog_fit as C

    assert sorted(C._OOF_ALL) == sorted(c for cols in C.FAMILIES.values() for c in cols)
    assert all(set(xs) == set(C.O.FEATURES) - set(cols) for cols in C.FAMILIES.values() for y, xs in C._OOF_ALL.items() if y in cols)


def test_all_folds_are_fitted_side_by_side(rows):
    meet = threading.Barrier(5, timeout=60)
    five = materialize(rows.withColumn("fold", (F.col("id") % 5).cast("int")), "five_folds")

    def make(r):
        meet.wait()
        return MD.gbt_binary(max_iter=1)
    assert CF.ml_crossfit(five, make, k=5).count() == 600


def test_bagged_seeds_are_fitted_side_by_side_and_averaged(rows):
    meet = threading.Barrier(3, timeout=60)

    def make(seed):
        meet.wait()
        return MD.gbt_binary(max_iter=2, seed=seed)
    test = rows.where("id < 40")
    got = MD.bagged_scores(make, (0, 1, 2), rows, test.unionByName(test.where("id = 3"))).toPandas().set_index("id")["score"]
    own = [MD.predict_positive(MD.gbt_binary(max_iter=2, seed=s).fit(rows), test).toPandas().set_index("id")["score"] for s in (0, 1, 2)]
    assert got.index.is_unique and got.sort_index().tolist() == pytest.approx((sum(own) / 3).sort_index().tolist())


@pytest.mark.parametrize("name, rounds", [("mdl_gbt_regressor", 500), ("mdl_gbt_scaled", 100), ("mdl_mlp", 35)])
def test_members_are_fitted_for_all_rounds_of_their_recipe(spark, monkeypatch, name, rounds):
    from rankfold.plans import catalog_fit as C

    met = []

    def crossfit(train, make, **kw):
        met.append(make(train).getMaxIter())
        raise InterruptedError
    monkeypatch.setattr(C, "member_frame", lambda *a: (None, None))
    monkeypatch.setattr(C, "_width", lambda rows: 3)
    monkeypatch.setattr(C.CF, "ml_crossfit", crossfit)
    with pytest.raises(InterruptedError):
        catalog_queries()[name](spark, "")
    assert met == [rounds]


def catalog_queries():
    from rankfold.plans import catalog

    return catalog.QUERIES


def test_the_bag_has_all_seeds_and_rounds(spark, monkeypatch):
    from rankfold.plans import catalog_fit as C

    monkeypatch.setattr(C, "member_frame", lambda *a: (None, None))
    monkeypatch.setattr(C.MD, "bagged_scores", lambda make, seeds, tr, te: [(make(s).getSeed(), make(s).getMaxIter()) for s in seeds])
    assert catalog_queries()["fit_full_bagged"](spark, "") == [(s, 100) for s in range(32)]


def test_bagged_fits_at_a_time_are_bounded(rows):
    running, most, lock = [], [], threading.Lock()

    class Fit:
        def fit(self, df):
            with lock:
                running.append(1)
                most.append(len(running))
            model = MD.gbt_binary(max_iter=1).fit(df)
            with lock:
                running.pop()
            return model
    assert MD.bagged_scores(lambda s: Fit(), range(4), rows, rows, parallelism=2).count() == 600
    assert max(most) <= 2


def test_learned_features_of_all_targets_without_joins(spark, rows):
    """As from one cross-fit per target; ids that come twice keep one row each; all fits are submitted side by side."""
    pdf = rows.select("id", "fold").toPandas().sort_values("id").reset_index(drop=True)
    rng = np.random.default_rng(4)
    for c in "abcd":
        pdf[c] = np.round(rng.normal(size=len(pdf)), 2)
    pdf["c"] += pdf["a"]
    pdf.loc[1, "id"] = pdf.loc[0, "id"]
    df = materialize(spark.createDataFrame(pdf).coalesce(1), "learned_rows")
    meet = threading.Barrier(6, timeout=60)

    class Learner:
        def __init__(self, x, y):
            self.own = MD.gbt_regressor(x, y, max_iter=2, subsample=1.0, feature_fraction=1.0)

        def fit(self, part):
            meet.wait()
            return self.own.fit(part)
    got = CF.oof_learned_features(df, {"c": ["a", "b"], "d": ["a", "b"]}, Learner, k=3)
    assert got.columns == ["id", "fold", "oof_c", "oof_d"] and got.count() == len(pdf)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    for y in "cd":
        one = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(df)
        own = CF.ml_crossfit(one, MD.gbt_regressor("_x", y, max_iter=2, subsample=1.0, feature_fraction=1.0), k=3, score=lambda: F.col("prediction").cast("double"))
        order = ["id", "fold"]
        want = own.toPandas().sort_values([*order, "score"])["score"].tolist()
        assert got.toPandas().sort_values([*order, f"oof_{y}"])[f"oof_{y}"].tolist() == pytest.approx(want)
