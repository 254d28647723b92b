"""Folds, cross-fitting, bagging and blending properties."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankfold.operators import blend as BL
from rankfold.operators import crossfit as CF


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(11)
    n = 1000
    x = rng.normal(size=n)
    y = (x + rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x, "target": y}))


def test_each_id_in_one_fold_and_stratified(labelled):
    f = CF.stratified_folds(labelled).toPandas()
    assert f["id"].is_unique and set(f["fold"]) == {0, 1, 2, 3, 4}
    share = f.groupby("fold")["target"].agg(["sum", "count"])
    pos = f["target"].sum()
    assert (share["sum"] - pos / 5).abs().max() <= 1
    assert (share["count"] - len(f) / 5).abs().max() <= 2


def test_ols_crossfit_matches_numpy_and_covers_every_row(labelled):
    f = CF.stratified_folds(labelled)
    oof = CF.ols_crossfit(f, "x", "target").toPandas().merge(f.toPandas(), on=["id", "fold"])
    assert oof["id"].is_unique and len(oof) == 1000
    for k, part in oof.groupby("fold"):
        rest = oof[oof.fold != k]
        b, a = np.polyfit(rest.x, rest.target, 1)
        assert part["score"].to_numpy() == pytest.approx((a + b * part.x).to_numpy(), rel=1e-9)


def test_blend_invariant_to_monotone_member_transform(spark):
    rng = np.random.default_rng(2)
    ids = np.arange(50)
    a, b = rng.random(50), rng.random(50)
    def scores(tr):
        rows = [(int(i), "m1", "test", float(tr(x))) for i, x in zip(ids, a)]
        rows += [(int(i), "m2", "test", float(x)) for i, x in zip(ids, b)]
        return spark.createDataFrame(rows, "id long, model string, split string, score double")
    w = {"m1": 0.7, "m2": -0.2}
    one = BL.blend(scores(lambda v: v), w).orderBy("id").toPandas()
    two = BL.blend(scores(lambda v: np.exp(3 * v)), w).orderBy("id").toPandas()
    assert one["score"].tolist() == pytest.approx(two["score"].tolist())
    exp = 0.7 * pd.Series(a).rank(pct=True) - 0.2 * pd.Series(b).rank(pct=True)
    assert one["score"].tolist() == pytest.approx(exp.tolist())


def test_rerank_mean_is_n_plus_one_over_two_n(spark):
    rows = [(i, "m", "test", float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, model string, split string, score double")
    out = BL.blend(df, {"m": 1.0}, rerank=True).toPandas()
    assert out["target"].mean() == pytest.approx((40 + 1) / (2 * 40))


def test_seed_average_and_running_gini(labelled):
    f = CF.stratified_folds(labelled)
    sc = [CF.ols_crossfit(f, "x", "target", subsample=0.8, seed=s) for s in (0, 1)]
    both = sc[0].unionByName(sc[1])
    avg = CF.seed_average(both).toPandas().set_index("id")["score"]
    p = both.toPandas().pivot_table(index="id", columns="seed", values="score")
    assert avg.sort_index().to_numpy() == pytest.approx(p.mean(axis=1).sort_index().to_numpy())
    g = CF.running_seed_gini(both.where(F.col("split") == "train"), f).orderBy("seed").toPandas()
    assert list(g["seed"]) == [0, 1] and (g["gini"] > 0.3).all()


def test_members_side_by_side_in_one_aggregate(spark):
    rows = [(i, m, "test", float(i) if m == "a" else None if i == 1 else -float(i)) for i in range(4) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "id long, model string, split string, score double")
    df.createOrReplaceTempView("_members")
    wide = BL.join_members(df, ["b", "a"], missing="null")
    got = [tuple(r) for r in wide.orderBy("id").collect()]
    assert wide.columns == ["id", "split", "b", "a"]
    assert got == [(0, "test", 0.0, 0.0), (1, "test", None, 1.0), (2, "test", -2.0, 2.0), (3, "test", -3.0, 3.0)]
    # No aggregate on (id, split, member), which would hold a row per id and member.
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", wide._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("model" in k for k in keys)


def test_blend_brings_ids_together_before_the_aggregate(spark):
    rows = [(i, m, "test", float((i * 7) % 11)) for i in range(30) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "id long, model string, split string, score double")
    plan = BL.blend(df, {"a": 0.5, "b": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Aggregate[^\n]*\n[^\n]*Aggregate[^\n]*\n[^\n]*Exchange hashpartitioning\(id", plan), plan
