"""Linear learners fitted for all folds at once, against numpy."""

import numpy as np
import pandas as pd
import pytest

from rankfold.operators import crossfit as CF
from rankfold.operators import linear as LI


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1.0, 50.0, 0.01] + [0.0, 900.0, 5.0]
    odds = x[:, 0] + (x[:, 1] - 900) / 60
    out = pd.DataFrame(x, columns=list("abc")).assign(id=range(400), fold=np.arange(400) % 4)
    return out.assign(target=(rng.random(400) < 1 / (1 + np.exp(-odds))).astype(int), twice=2 * out["a"])


def newton(x, y, family, steps, l2, c):
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        e = x @ b
        if family == "fair":
            w = 1 / (1 + np.abs(y - e) / c)
            z = w * y
        else:
            mu = 1 / (1 + np.exp(-e)) if family == "binomial" else np.exp(e)
            w = mu * (1 - mu) if family == "binomial" else mu
            z = w * e + y - mu
        ridge = l2 * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
        b = np.linalg.solve(x.T @ (w[:, None] * x) + ridge, x.T @ z)
    return b


@pytest.mark.parametrize("family,l2,c", [("binomial", 0.04, 1.0), ("poisson", 0.0, 1.0), ("fair", 0.0, 0.5)])
def test_glm_crossfit(spark, pdf, family, l2, c):
    train = spark.createDataFrame(pdf).repartition(3)
    test = spark.createDataFrame(pdf.assign(id=pdf["id"] + 1000))
    got = LI.glm_crossfit(train, ["a", "b", "c"], family=family, steps=5, l2=l2, c=c, test=test).toPandas()
    assert len(got) == 400 + 4 * 400 and set(got["split"]) == {"train", "test"}
    x = pdf[["a", "b", "c"]].to_numpy()
    x = np.hstack([np.ones((400, 1)), (x - x.mean(axis=0)) / x.std(axis=0)])
    y = pdf["target"].to_numpy(float)
    for f in range(4):
        out = (pdf["fold"] != f).to_numpy()
        e = x @ newton(x[out], y[out], family, 5, l2, c)
        want = e if family == "fair" else 1 / (1 + np.exp(-e)) if family == "binomial" else np.exp(e)
        mine = got[(got["fold"] == f) & (got["split"] == "test")].sort_values("id")["score"].to_numpy()
        assert mine == pytest.approx(want, abs=1e-9)
        oof = got[(got["fold"] == f) & (got["split"] == "train")].sort_values("id")["score"].to_numpy()
        assert oof == pytest.approx(want[~out], abs=1e-9)


def test_glm_edges(spark, pdf):
    df = spark.createDataFrame(pdf)
    # A column that another one explains, a constant, and rows with a missing value.
    same = LI.glm_crossfit(df, ["a", "twice"], steps=4).toPandas().sort_values("id")["score"].to_numpy()
    alone = LI.glm_crossfit(df, ["a"], steps=4).toPandas().sort_values("id")["score"].to_numpy()
    assert same == pytest.approx(alone)
    flat = LI.glm_crossfit(df.selectExpr("*", "1.0 as one"), ["a", "one"], steps=4).toPandas().sort_values("id")["score"].to_numpy()
    assert flat == pytest.approx(alone)
    gaps = df.selectExpr("id", "fold", "target", "case when id = 7 then null else a end as a")
    got = {r["id"]: r["score"] for r in LI.glm_crossfit(gaps, ["a"], steps=2).collect()}
    assert got[7] is None and sum(v is None for v in got.values()) == 1
    assert LI.glm_crossfit(df.limit(0), ["a"]).count() == 0
    whole = LI.glm_crossfit(df, ["a"], steps=4, models=[-1], test=df).where("split = 'test'")
    assert whole.count() == 400 and whole.select("fold").distinct().first()["fold"] == -1
    with pytest.raises(ValueError):
        LI.glm_crossfit(df, ["a"], family="probit")


def test_a_separable_label_stays_finite(spark):
    df = spark.createDataFrame([(i, i % 3, int(i > 50), float(i)) for i in range(100)], "id long, fold int, target int, a double")
    got = LI.glm_crossfit(df, ["a"], steps=12, l2=1e-6).toPandas()
    assert got["score"].between(0, 1).all()
    for _, part in got.sort_values("id").groupby("fold"):
        assert (part["score"].diff().dropna() >= -1e-9).all()


def test_residuals_of_oof_features_are_orthogonal(spark, pdf):
    df = spark.createDataFrame(pdf)
    got = LI.oof_gram_features(df, {"a": ["b", "c"], "target": ["b", "c"], "b": ["a"]}).toPandas()
    for y, xs in {"a": ["b", "c"], "target": ["b", "c"], "b": ["a"]}.items():
        for f in range(4):
            out, x = got["fold"] != f, np.hstack([np.ones((400, 1)), pdf.set_index("id").loc[got["id"], xs].to_numpy()])
            w = np.linalg.lstsq(x[out], got[y][out].to_numpy(float), rcond=None)[0]
            assert got[f"oof_{y}"][~out].to_numpy() == pytest.approx(x[~out] @ w, rel=1e-6, abs=1e-6)


def test_seeds_at_once_equal_one_seed_at_a_time(spark, pdf):
    df = spark.createDataFrame(pdf)
    got = CF.ols_crossfit_seeds(df, "b", "target", [3, 8], subsample=0.7, test=df).toPandas()
    for s in (3, 8):
        want = CF.ols_crossfit(df, "b", "target", test=df, subsample=0.7, seed=s).toPandas()
        key = ["split", "fold", "id"]
        a, b = (t.sort_values(key).reset_index(drop=True) for t in (got[got["seed"] == s], want))
        assert a[key].equals(b[key]) and a["score"].to_numpy() == pytest.approx(b["score"].to_numpy())
    assert CF.ols_crossfit_seeds(df.limit(0), "b", "target", [1]).count() == 0
    few = CF.ols_crossfit_seeds(df.where("id < 2"), "b", "target", [1]).toPandas()
    assert len(few) == 2 and few["score"].isna().all()


def test_seeds_take_few_jobs(spark, pdf):
    df = spark.createDataFrame(pdf)
    sc = spark.sparkContext
    sc.setJobGroup("seeds", "seeds")
    CF.seed_average(CF.ols_crossfit_seeds(df, "b", "target", range(16), subsample=0.9, test=df)).collect()
    jobs = sc.statusTracker().getJobIdsForGroup("seeds")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20
