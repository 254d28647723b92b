"""Global-order operators: exact average-tie ranks, Gini, Lorenz, row numbers."""

import numpy as np
import pandas as pd
import pytest

from rankfold.operators import order as OR


def _ranks(spark, scores, by=None, num_buckets=None):
    rows = [(i, s) if by is None else (i, s, by[i]) for i, s in enumerate(scores)]
    cols = "id long, s double" + ("" if by is None else ", g string")
    df = spark.createDataFrame(rows, cols)
    out = OR.pct_rank(df, "s", by=[] if by is None else ["g"], num_buckets=num_buckets).orderBy("id").toPandas()
    return out["pct_rank"].tolist()


def test_average_tie_pct_rank(spark):
    assert _ranks(spark, [.2, .2, .5, .5, .9]) == pytest.approx([.3, .3, .7, .7, 1.0])


def test_pct_rank_matches_pandas_with_many_buckets(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.normal(size=500), 1)  # heavy ties
    got = _ranks(spark, s.tolist(), num_buckets=37)
    assert got == pytest.approx(pd.Series(s).rank(pct=True).tolist())


def test_pct_rank_by_group(spark):
    s = [3.0, 1.0, 2.0, 1.0, 5.0, 5.0]
    g = ["a", "a", "a", "b", "b", "b"]
    got = _ranks(spark, s, by=g, num_buckets=3)
    exp = pd.DataFrame({"s": s, "g": g}).groupby("g")["s"].rank(pct=True).tolist()
    assert got == pytest.approx(exp)


def test_null_score_keeps_null_rank(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "id long, s double")
    r = OR.pct_rank(df, "s").orderBy("id").toPandas()["pct_rank"].tolist()
    assert r[0] == pytest.approx(0.5) and r[2] == pytest.approx(1.0) and (r[1] is None or np.isnan(r[1]))


def _gini_ref(y, p):
    """Reference Gini (area between diagonal and Lorenz curve, normalized), untied scores, true division."""
    y, p = np.asarray(y, float), np.asarray(p, float)
    n = len(y)

    def g(order):
        srt = y[np.argsort(-order, kind="stable")]
        lor = np.cumsum(srt) / srt.sum()
        return np.sum(np.linspace(1 / n, 1, n) - lor)
    return g(p) / g(y)


def test_gini_matches_reference_formula_untied(spark):
    rng = np.random.default_rng(7)
    p = rng.random(400)
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    got = OR.gini(df, "y", "p", num_buckets=16).first()["gini"]
    assert got == pytest.approx(_gini_ref(y, p), abs=1e-12)


def test_gini_is_two_auc_minus_one_with_ties_and_antisymmetric(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(300), 1)
    y = (rng.random(300) < p).astype(int)
    pdf = pd.DataFrame({"y": y, "p": p, "q": -p})
    df = spark.createDataFrame(pdf)
    g = OR.gini(df, "y", "p").first()["gini"]
    r = pd.Series(p).rank()
    P, N = y.sum(), len(y) - y.sum()
    auc = (r[y == 1].sum() - P * (P + 1) / 2) / (P * N)
    assert g == pytest.approx(2 * auc - 1, abs=1e-12)
    assert OR.gini(df, "y", "q").first()["gini"] == pytest.approx(-g, abs=1e-12)


def test_gini_by_group(spark):
    pdf = pd.DataFrame({"k": [0] * 4 + [1] * 4, "y": [1, 0, 1, 0, 0, 1, 0, 1], "p": [4, 3, 2, 1, 4, 3, 2, 1.0]})
    out = {r["k"]: r["gini"] for r in OR.gini(spark.createDataFrame(pdf), "y", "p", by=["k"]).collect()}
    for k, sub in pdf.groupby("k"):
        assert out[k] == pytest.approx(_gini_ref(sub.y.values, sub.p.values), abs=1e-12)


def test_lorenz_endpoints(spark):
    pdf = pd.DataFrame({"y": [1, 0, 1, 1, 0], "s": [5.0, 4.0, 4.0, 2.0, 1.0]})
    lz = OR.lorenz(spark.createDataFrame(pdf), "y", "s").orderBy(OR.F.col("s").desc()).toPandas()
    assert lz["cum_share_rows"].tolist() == pytest.approx([0.2, 0.6, 0.8, 1.0])
    assert lz["cum_share_label"].tolist() == pytest.approx([1 / 3, 2 / 3, 1.0, 1.0])


def test_row_number_is_dense_and_ordered(spark):
    ids = [17, 3, 99, 42, 5, 8]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    out = OR.row_number_by(df, "id", num_buckets=3).orderBy("id").toPandas()
    assert out["row_id"].tolist() == list(range(len(ids)))


def test_rows_of_a_hot_value_are_dealt_to_parts(spark):
    s = [0.0] * 300 + [1.0] * 40 + [float(i) for i in range(2, 60)] + [None, float("nan"), -0.0]
    g = ["a" if i % 3 else "b" for i in range(len(s))]
    df = spark.createDataFrame(list(zip(range(len(s)), s, g)), "id long, s double, g string")
    got = OR.pct_rank(df, "s", by=["g"], hot_rows=16)
    plan = got._jdf.queryExecution().toString()
    want = {r["id"]: r["pct_rank"] for r in OR.pct_rank(df, "s", by=["g"]).collect()}
    rows = got.collect()
    assert got.columns == ["g", "s", "id", "pct_rank"] and len(rows) == len(s)
    assert {r["id"]: r["pct_rank"] for r in rows} == want
    # The join is dealt by the value and its part: 200 rows of group a's zero go to 13 parts.
    assert "_hot_part" in plan
