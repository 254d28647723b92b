"""Infinite, NaN, empty, all-NULL and date input, groups without positives, exact shares, coverage, fitted tables."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankfold.operators import blend as BL
from rankfold.operators import categories as CA
from rankfold.operators import crossfit as CF
from rankfold.operators import linear as LI
from rankfold.operators import encode as EN
from rankfold.operators import features as FE
from rankfold.operators import order as OR
from rankfold.session import ensure_checkpoint_dir, materialize, release_scratch

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("scores", [[1.0, 2.0, NAN], [INF, -INF, 0.0, 0.0, None], [INF] * 3, [None, None], [NAN], [], [5.0]])
def test_pct_rank_like_pandas(spark, scores):
    df = spark.createDataFrame(list(enumerate(scores)), "id long, s double")
    got = [r["pct_rank"] for r in OR.pct_rank(df, "s").orderBy("id").collect()]
    want = pd.Series(scores, dtype=float).rank(pct=True)
    assert [None if g is None else round(g, 12) for g in got] == [None if pd.isna(w) else round(w, 12) for w in want]


def test_pct_rank_of_dates(spark):
    days = [dt.date(2024, 1, 3), dt.date(1960, 1, 1), None, dt.date(2024, 1, 3)]
    got = OR.pct_rank(spark.createDataFrame(list(enumerate(days)), "id long, d date"), "d").orderBy("id").collect()
    assert [r["pct_rank"] for r in got] == pytest.approx([2.5 / 3, 1 / 3, None, 2.5 / 3])


def test_groups_without_positives_get_null(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 2.0), (1, 0, 1.0), (2, 1, 1.0), (3, 1, NAN), (3, None, 1.0)], "g int, y int, s double")
    got = {r["g"]: r["gini"] for r in OR.gini(df, "y", "s", by=["g"]).collect()}
    assert got == {0: None, 1: 1.0, 2: None}
    share = {r["g"]: r["cum_share_label"] for r in OR.lorenz(df.where("g = 0"), "y", "s", by=["g"]).collect()}
    assert share == {0: None}
    assert OR.gini(df.limit(0), "y", "s").first()["gini"] is None


@pytest.mark.parametrize("share", [0.9, 0.003, 0.0, 1.0])
def test_subsample_keeps_the_share(spark, share):
    n = 200_000
    kept = spark.range(n).where(CF.subsample_flag(share, 3)).count()
    assert abs(kept - share * n) <= 4 * (n * share * (1 - share)) ** 0.5


def test_f_classif_is_stable(spark):
    rng = np.random.default_rng(4)
    y, x = rng.integers(0, 2, 500), rng.integers(0, 7, 500).astype(float)
    pdf = pd.DataFrame({"y": y, "x": x, "far": x + 1e9, "flat": 0.1, "none": np.nan})
    got = {r["feature"]: r["f_value"] for r in EN.f_classif(spark.createDataFrame(pdf), "y", ["x", "far", "flat", "none"]).collect()}
    assert got["flat"] is None and got["far"] == pytest.approx(got["x"], rel=1e-5) and got.get("none") is None


def test_spearman_with_ties_and_nulls(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": range(300), "y": rng.integers(0, 2, 300), "a": rng.integers(0, 9, 300), "b": rng.random(300)})
    got = {r["feature"]: r["spearman"] for r in EN.spearman_with_label(spark.createDataFrame(pdf), "y", ["a", "b"]).collect()}
    for c in "ab":
        assert got[c] == pytest.approx(pdf.y.rank().corr(pdf[c].rank()), abs=1e-12)


def test_blend_coverage_policies(spark):
    df = spark.createDataFrame([(1, "a", "test", 1.0), (2, "a", "test", 2.0), (1, "b", "test", 1.0)], "id long, model string, split string, score double")
    weights = {"a": 0.5, "b": 0.5}
    with pytest.raises(Exception, match="no score for some id"):
        BL.blend(df, weights).collect()
    assert [r["id"] for r in BL.blend(df, weights, missing="drop").collect()] == [1]
    assert {r["id"]: r["score"] for r in BL.blend(df, weights, missing="null").collect()} == {1: 0.75, 2: None}
    assert len(BL.REFERENCE_WEIGHTS) == 13


def test_categories_of_many_values_with_one_prefix(spark):
    df = spark.range(3000).select(F.format_string("CUST%05d", (F.col("id") * 7) % 2000).alias("c"), (F.col("id") % 11 - 5).alias("n"),
                                  F.expr("date_add(date'2020-01-01', cast(id % 3 as int))").alias("d"))
    fitted = CA.fit_categories(df, ["c", "n", "d"])
    assert fitted.sizes == {"c": 2000, "n": 11, "d": 3}
    for c in ("c", "n", "d"):
        rows = fitted.values(c).orderBy("__code").collect()
        values = [r[c] for r in rows]
        assert values == sorted(values) and [r["__code"] for r in rows] == list(range(len(rows))) and sum(r["__n"] for r in rows) == 3000
    new = spark.createDataFrame([("CUST00001", 99), (None, None)], "c string, n long")
    assert [tuple(r) for r in fitted.encode(new, ["c", "n"]).select("c", "n").collect()] == [(1, 11), (2000, 11)]
    assert [r[0] for r in fitted.count(new, ["n"]).select("n_count").collect()] == [0, 0]
    empty = CA.fit_categories(df.limit(0), ["c"])
    assert empty.sizes == {"c": 0} and empty.largest_codes().first()[0] is None


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, -0.0, None), (2, None, "a")], "i int, x double, s string")
    got = {r["column"]: r["n_distinct"] for r in CA.distinct_counts(df, ["i", "x", "s"]).collect()}
    assert got == {"i": 2, "x": 1, "s": 1}


def test_group_stats_with_missing_and_infinite_values(spark):
    rows = [(0, 1, 1.0), (1, 1, NAN), (2, 1, 4.0), (3, 2, None), (4, 3, INF), (5, 3, INF), (6, None, 7.0), (7, 4, -INF), (8, 4, 2.0), (9, 4, 3.0)]
    got = FE.group_stats_table(spark.createDataFrame(rows, "id long, g int, t double"), "g", ["t"]).collect()
    stats = {r["g"]: tuple(r[FE.stat_name("t", "g", s)] for s in ("size", "mean", "median", "max", "min")) for r in got}
    assert stats[1] == (3, 2.5, 2.5, 4.0, 1.0) and stats[2] == (1, None, None, None, None)
    assert stats[3][2:] == (INF, INF, INF) and stats[4] == (3, -INF, 2.0, 3.0, -INF) and set(stats) == {1, 2, 3, 4}


def test_group_medians_are_exact_for_a_hot_group(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": np.where(rng.random(60_000) < 0.6, 0, rng.integers(1, 40, 60_000)), "t": rng.normal(size=60_000), "u": rng.integers(0, 5, 60_000)})
    got = FE.group_stats_table(spark.createDataFrame(pdf), "g", ["t", "u"]).toPandas().set_index("g").sort_index()
    for c in "tu":
        assert got[FE.stat_name(c, "g", "median")].tolist() == pytest.approx(pdf.groupby("g")[c].median().tolist(), rel=1e-12)


def test_statistics_fit_once_apply_elsewhere_without_row_shuffle(spark):
    train = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "g int, t double")
    fitted = FE.fit_group_stats(train, {"g": ["t"]})
    new = spark.createDataFrame([(1,), (3,), (None,)], "g int")
    out = fitted.transform(new)
    assert [r[FE.stat_name("t", "g", "mean")] for r in out.collect()] == [3.0, None, None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"hashpartitioning\(g", plan)


def test_oof_target_features_match_least_squares(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(200), "a": rng.normal(size=200) + 1e4, "b": rng.normal(size=200), "c": rng.normal(size=200)})
    pdf["y"] = 2 * pdf.a - pdf.b + rng.normal(size=200)
    df = materialize(CF.kfold(spark.createDataFrame(pdf)), "rows")
    got = LI.oof_gram_features(df, {"y": ["a", "b", "c"], "c": ["a"]}).toPandas()
    for f, part in got.groupby("fold"):
        rest = got[got.fold != f]
        for y, xs in (("y", ["a", "b", "c"]), ("c", ["a"])):
            w = np.linalg.lstsq(np.column_stack([np.ones(len(rest)), rest[xs] - rest[xs].mean()]), rest[y], rcond=None)[0]
            want = np.column_stack([np.ones(len(part)), part[xs] - rest[xs].mean()]) @ w
            assert part[f"oof_{y}"].to_numpy() == pytest.approx(want, rel=1e-7)


def test_release_scratch_deletes_written_tables(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    df = materialize(spark.range(3), "gone")
    path = df.inputFiles()[0]
    assert release_scratch(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path.rsplit("/", 1)[0]).count()
