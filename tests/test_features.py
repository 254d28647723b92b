"""Counts and group statistics, including the edge cases of FIXTURES.md section 3."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankfold.functions import rowwise as RW
from rankfold.operators import features as FE


def test_singleton_group_std_is_zero_and_null_key_gets_null(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (1, 1, 4.0), (2, 2, 7.0), (3, None, 9.0)], "id long, g int, t double")
    out = FE.group_stats(df, "t", "g").orderBy("id").toPandas()
    n = lambda s: FE.stat_name("t", "g", s)
    assert out[n("size")].tolist()[:3] == [2, 2, 1]
    assert out[n("std")].tolist()[:3] == pytest.approx([np.sqrt(2.0), np.sqrt(2.0), 0.0])
    assert out[n("median")].tolist()[:3] == pytest.approx([3.0, 3.0, 7.0])
    assert pd.isna(out[n("mean")].iloc[3])


def test_group_stats_match_pandas_on_skewed_groups(spark):
    rng = np.random.default_rng(5)
    g = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 30, 3000))  # one hot group
    t = np.round(rng.normal(100, 20, 3000), 2)
    pdf = pd.DataFrame({"id": np.arange(3000), "g": g, "t": t})
    out = FE.group_stats(spark.createDataFrame(pdf), "t", "g").orderBy("id").toPandas()
    grp = pdf.groupby("g")["t"]
    for stat, ref in [("size", grp.transform("size")), ("mean", grp.transform("mean")),
                      ("std", grp.transform("std").fillna(0)), ("median", grp.transform("median")),
                      ("max", grp.transform("max")), ("min", grp.transform("min"))]:
        assert out[FE.stat_name("t", "g", stat)].to_numpy() == pytest.approx(ref.to_numpy(), rel=1e-9), stat


def test_value_counts_null_lookup_is_zero(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, "b")], "id long, c string")
    out = FE.value_counts(df, ["c"]).orderBy("id").toPandas()
    assert out["c_count"].tolist() == [2, 2, 0, 1]


def test_composite_counts_group_on_columns_not_text(spark):
    df = spark.createDataFrame([(0, 1.0, 10000000.0), (1, 1.0, 1e7), (2, 1.0, None), (3, 1.0, None)],
                               "id long, a double, b double")
    out = FE.composite_counts(df, ["a", "b"], "k_count").orderBy("id").toPandas()
    assert out["k_count"].tolist() == [2, 2, 2, 2]


def test_division_by_zero_becomes_zero_after_nonfinite(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    out = df.select(RW.nonfinite_to_zero(RW.safe_div(F.col("a"), F.col("b"))).alias("r")).toPandas()
    assert out["r"].tolist() == [0.0, 0.0, 1.5]


def test_missing_count_counts_numeric_and_text_sentinels(spark):
    df = spark.createDataFrame([(-1, "-1", 2.0), (3, "x", -1.0)], "a int, s string, d double")
    out = df.select(RW.missing_count(df, ["a", "s", "d"]).alias("m")).toPandas()
    assert out["m"].tolist() == [2.0, 1.0]


def test_grid_skips_target_equal_to_group(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0)], "id long, x int, y double")
    out = FE.group_stats_grid(df, ["x", "y"], ["x", "y"])
    assert FE.stat_name("x", "x", "mean") not in out.columns
    assert FE.stat_name("y", "x", "mean") in out.columns and FE.stat_name("x", "y", "mean") in out.columns


@pytest.mark.parametrize("middle_rows", [2, 16])
def test_medians_of_hot_groups_are_narrowed_by_counts(spark, middle_rows):
    """A group of a third of all rows with continuous values, ties at the middle, an even split, infinities."""
    rng = np.random.default_rng(8)
    n = 30_000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 5, n)), "v": rng.normal(size=n)})
    pdf.loc[pdf.g == 1, "v"] = np.round(pdf.v[pdf.g == 1], 1)
    pdf.loc[pdf.g == 2, "v"] = np.where(np.arange((pdf.g == 2).sum()) % 2, -1.0, 1.0) * (1 + rng.integers(0, 3, (pdf.g == 2).sum()))
    pdf.loc[pdf.g == 3, "v"] = np.where(rng.random((pdf.g == 3).sum()) < 0.6, np.inf, pdf.v[pdf.g == 3])
    pdf = pd.concat([pdf, pd.DataFrame({"g": [7, 8, 8], "v": [4.0, 1.0, 2.0]})])
    values = spark.createDataFrame(pdf).groupBy("g", "v").agg(F.count("*").alias("_n")).withColumnRenamed("v", "_v")
    sizes = spark.createDataFrame(pdf).groupBy("g").agg(F.count("*").alias("_c"))
    left, below = FE.narrowed_middles(values.join(sizes, "g"), sizes.select("g", F.lit(0).cast("long").alias("_b")), ["g"], middle_rows)
    left, below = left.toPandas(), below.toPandas().set_index("g")["_b"]
    assert left.groupby("g").size().max() <= middle_rows
    for g, own in pdf.groupby("g"):
        order, kept = np.sort(own.v.to_numpy()), left[left.g == g].sort_values("_v")
        listed, c = np.repeat(kept["_v"].to_numpy(), kept["_n"].to_numpy()), len(order)
        for place in {(c - 1) // 2, c // 2}:
            assert listed[place - below[g]] == order[place]


def test_narrowed_group_statistics_equal_those_of_pandas(spark, monkeypatch):
    from rankfold.operators import categories
    rng = np.random.default_rng(9)
    n = 24_000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 4, n)), "t": rng.normal(size=n), "u": rng.integers(0, 9, n) * 1.0})
    # Few values a task and no broadcast: every pass and the salted joins are taken.
    monkeypatch.setattr(categories, "BROADCAST_ROWS", 0)
    table = FE.fit_group_stats(spark.createDataFrame(pdf), {"g": ["t", "u"]}, middle_rows=4).tables["g"].toPandas().sort_values("g")
    ref = pdf.groupby("g").median()
    for t in ("t", "u"):
        assert table[FE.stat_name(t, "g", "median")].to_numpy() == pytest.approx(ref[t].to_numpy(), abs=1e-12)


def _initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_large_table_with_small_files_is_never_collected_by_the_driver(spark):
    from rankfold.operators import categories
    from rankfold.session import materialize
    rows = categories.BROADCAST_ROWS + 1
    table = materialize(spark.range(rows).select(F.col("id").alias("g"), F.lit(1.5).alias("x")), "small_files")
    df = spark.createDataFrame([(0, 7), (1, rows - 1), (2, rows), (3, None)], "id long, g long")
    for out in (categories.lookup(df, table, "g", rows), categories.salted_lookup(df, table, ["g"], rows, F.col("id"))):
        assert "BroadcastHashJoin" not in _initial_plan(out)
        assert {r.id: r.x for r in out.collect()} == {0: 1.5, 1: 1.5, 2: None, 3: None}


def test_composite_counts_broadcast_only_a_known_small_table(spark, monkeypatch):
    from rankfold.operators import categories
    df = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (2, None, "a"), (3, None, "a"), (4, 2, None)], "id long, p int, q string")
    small = FE.composite_counts(df, ["p", "q"], "n")
    assert "BroadcastHashJoin" in _initial_plan(small)
    monkeypatch.setattr(categories, "BROADCAST_ROWS", 2)
    large = FE.composite_counts(df, ["p", "q"], "n")
    assert "BroadcastHashJoin" not in _initial_plan(large)
    for out in (small, large):
        assert {r.id: r.n for r in out.collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1}


def test_large_tables_are_joined_before_the_statistics_of_small_ones(spark, monkeypatch):
    from rankfold.operators import categories
    monkeypatch.setattr(categories, "BROADCAST_ROWS", 3)
    pdf = pd.DataFrame({"id": range(40), "s": [i % 2 for i in range(40)], "l": [i % 10 for i in range(39)] + [None], "t": np.arange(40) / 3})
    df = spark.createDataFrame(pdf).withColumn("l", F.when(F.col("id") < 39, F.col("l").cast("int")))
    fitted = FE.fit_group_stats(df, {"s": ["t"], "l": ["t"]})
    out = fitted.transform(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Read from the top: the broadcast join is the last one.
    assert 0 < plan.index("BroadcastHashJoin") < plan.index("SortMergeJoin")
    assert out.columns == [*df.columns, *[FE.stat_name("t", g, s) for g in ("s", "l") for s in FE.STATS]]
    got = out.orderBy("id").toPandas()
    for g in ("s", "l"):
        ref = pdf.groupby(g)["t"]
        assert got[FE.stat_name("t", g, "mean")][:39].tolist() == pytest.approx(ref.transform("mean")[:39].tolist())
        assert got[FE.stat_name("t", g, "median")][:39].tolist() == pytest.approx(ref.transform("median")[:39].tolist())
    assert got[FE.stat_name("t", "l", "mean")].isna().tolist() == [False] * 39 + [True]


def test_statistics_rounded_once_a_group_are_those_rounded_on_every_row(spark):
    from rankfold.plans.catalog import _rounded_stats, round_doubles
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(300), "g": rng.integers(0, 40, 300) / 7, "h": rng.integers(0, 3, 300), "t": rng.normal(size=300) * 1e4})
    pdf.loc[:5, ["g", "t"]] = None
    df = spark.createDataFrame(pdf)
    stats = lambda out: out.select("id", *[c for c in out.columns if "__by__" in c])
    got = stats(FE.group_stats_grid(df, ["t", "g"], ["g", "h"], each=_rounded_stats)).orderBy("id").toPandas()
    want = round_doubles(stats(FE.group_stats_grid(df, ["t", "g"], ["g", "h"]))).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, want)
