"""Encoders, scaling and univariate selection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankfold.operators import encode as EN


def test_label_codes_numeric_order_not_text(spark):
    df = spark.createDataFrame([(0, 10), (1, -1), (2, 2), (3, 10)], "id long, c int")
    out = EN.label_encode(df, ["c"]).orderBy("id").toPandas()
    assert out["c"].tolist() == [2, 0, 1, 2]


def test_unseen_category_keep_and_error(spark):
    fit = spark.createDataFrame([(0, "a"), (1, "b")], "id long, c string")
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z")], "id long, c string")
    out = EN.label_encode(df, ["c"], fit_df=fit, unseen="keep").orderBy("id").toPandas()
    assert out["c"].tolist() == [0, 1, 2]
    with pytest.raises(Exception):
        EN.label_encode(df, ["c"], fit_df=fit, unseen="error").collect()


def test_onehot_slots(spark):
    df = spark.createDataFrame([(0, "b", 5), (1, "a", 7)], "id long, s string, n int")
    v = EN.onehot(df, ["s", "n"], unseen="error")
    slots = EN.vector_slots(v, "onehot").orderBy("id", "slot").toPandas()
    assert slots.groupby("id")["slot"].apply(list).to_dict() == {0: [1, 2], 1: [0, 3]}


def test_standard_scale_population_std_and_constant_column(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0], "c": [5.0] * 4})
    out = EN.standard_scale(spark.createDataFrame(pdf), ["x", "c"]).toPandas()
    assert out["x"].tolist() == pytest.approx(((pdf.x - pdf.x.mean()) / pdf.x.std(ddof=0)).tolist())
    assert out["c"].tolist() == [0.0] * 4


def test_scaler_of_many_columns_is_one_short_aggregate(spark, monkeypatch):
    asked, real = [], F.stddev_pop
    monkeypatch.setattr(EN.F, "stddev_pop", lambda c: asked.append(c) or real(c))
    x = np.random.default_rng(2).normal(size=(50, 120))
    x[:, 7] = 3.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(120)])
    df = spark.createDataFrame(pdf).withColumn("c9", F.when(F.col("c8") > 0, F.col("c9"))).withColumn("c5", F.lit(None).cast("double"))
    got = EN.fit_scaler(df, list(pdf.columns))
    assert len(asked) == 1
    pdf.loc[~(pdf.c8 > 0), "c9"] = np.nan
    assert (got.means["c5"], got.stds["c5"], got.stds["c7"]) == (0.0, 1.0, 1.0)
    for c in set(pdf.columns) - {"c5", "c7"}:
        assert (got.means[c], got.stds[c]) == pytest.approx((pdf[c].mean(), pdf[c].std(ddof=0)))
    assert EN.fit_scaler(df.limit(0), ["c1"]).stds == {"c1": 1.0} and EN.fit_scaler(df, []).means == {}


def test_f_classif_matches_anova_and_constant_ranks_last(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    pdf = pd.DataFrame({"target": y, "a": rng.normal(size=200) + y, "b": rng.normal(size=200), "k": 1.0})
    sc = EN.select_percentile(EN.f_classif(spark.createDataFrame(pdf), "target", ["a", "b", "k"]), 67.0)
    got = {r["feature"]: r for r in sc.collect()}
    for c in ("a", "b"):
        groups = [pdf[c][pdf.target == v] for v in (0, 1)]
        grand = pdf[c].mean()
        ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
        ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert got[c]["f_value"] == pytest.approx(ssb / (ssw / (len(pdf) - 2)), rel=1e-9)
    assert got["k"]["f_value"] is None and not got["k"]["keep"]
    assert got["a"]["keep"] and got["b"]["keep"]
