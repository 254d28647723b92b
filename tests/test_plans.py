"""Plan checks: global-order operators never run a window over all rows in one partition."""

import re

from pyspark.sql import functions as F

from rankfold.operators import crossfit as CF
from rankfold.operators import order as OR
from rankfold.plans import catalog  # noqa: F401  (before its second part)
from rankfold.plans.catalog_fit import member_frame
from rankfold.sources.fixtures import base


def _plan(spark, df) -> str:
    df.createOrReplaceTempView("_plan_check")
    return spark.sql("EXPLAIN FORMATTED SELECT * FROM _plan_check").first()[0]


def test_pct_rank_window_is_partitioned_by_bucket(spark):
    df = spark.range(10000).selectExpr("id", "cast(id % 97 as double) as s")
    plan = _plan(spark, OR.pct_rank(df, "s", num_buckets=16))
    assert re.search(r"hashpartitioning\(_bucket#\d+", plan), plan


def test_folds_use_hash_prefix_buckets(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 3 = 0 as int) as target")
    plan = _plan(spark, CF.stratified_folds(df))
    assert re.search(r"hashpartitioning\(target#\d+, _bucket#\d+", plan), plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 as a", "id * 3 as b", "'x' as c").write.parquet(path)
    df = spark.read.parquet(path).where("a > 10").select("id", "a")
    plan = _plan(spark, OR.pct_rank(df, "a", num_buckets=4))
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,10)]" in plan
    assert "ReadSchema: struct<id:bigint,a:bigint>" in plan


def test_labels_of_the_running_gini_are_not_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(CF, "gini", lambda df, *a, **kw: seen.append(df) or df.withColumn("gini", F.lit(0.0)))
    oof = spark.createDataFrame([(i, s, float(i)) for i in range(5) for s in (0, 1)], "id long, seed int, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "id long, target int")
    CF.running_seed_gini(oof, labels)
    plan = _plan(spark, seen[0])
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert seen[0].count() == 10


def _tables(spark, tmp_path, orders: int) -> str:
    for name, row in {
        "orders": "id + 1 o_orderkey, 2L o_custkey, 'F' o_orderstatus, 5.0D o_totalprice, timestamp'1995-01-02' o_orderdate, '1-URGENT' o_orderpriority",
        "customer": "2L c_custkey, 3 c_nationkey, 7.0D c_acctbal, 'AUTO' c_mktsegment",
        "nation": "3 n_nationkey, 1 n_regionkey",
        "lineitem": "1L l_orderkey, 4.0D l_quantity, 0.1D l_discount, 0.2D l_tax, 'R' l_returnflag, 'O' l_linestatus, 9.0D l_extendedprice",
    }.items():
        spark.sql(f"select {row} from range({orders if name == 'orders' else 1})").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_customers_are_not_broadcast(spark, tmp_path):
    wide = base(spark, _tables(spark, tmp_path, 1))
    assert re.search(r"SortMergeJoin[^\n]*\nLeft keys \[1\]: \[o_custkey", _plan(spark, wide))
    assert [(r["id"], r["f_reg_03"], r["f_ind_01"]) for r in wide.collect()] == [(1, 7.0, 1)]


def test_members_folds_are_dealt_once(spark, tmp_path):
    train, test = member_frame(spark, _tables(spark, tmp_path, 40), "gbt_regressor")
    plan = _plan(spark, train.where("fold <> 1"))
    assert "Exchange" not in plan and "Window" not in plan
    assert train.count() == 16 and test.count() == 24 and {r[0] for r in train.select("fold").collect()} == set(range(5))


def test_members_scaler_reads_the_written_wide_table(spark, tmp_path, monkeypatch):
    from rankfold.operators import encode as EN

    seen, real = [], EN.fit_scaler
    monkeypatch.setattr(EN, "fit_scaler", lambda df, cols: seen.append(df) or real(df, cols))
    train, test = member_frame(spark, _tables(spark, tmp_path, 40), "mlp")
    assert "Join" not in _plan(spark, seen[0])
    assert train.count() == 16 and test.count() == 24


def test_row_features_of_the_flagship_are_not_shuffled(spark, tmp_path, monkeypatch):
    from rankfold.operators import categories
    from rankfold.plans.flagship import feature_matrix

    monkeypatch.setattr(categories, "BROADCAST_ROWS", 0)
    out = feature_matrix(spark, _tables(spark, tmp_path, 40))
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", _plan(spark, out))
    assert dealt and not any("inter_" in columns or "missing" in columns for columns in dealt)
    assert out.count() == 40 and len(set(out.columns)) == len(out.columns)
    new = [c for c in out.columns if "__by__" not in c]
    assert [new.index(c) for c in ("f_calc_01", "missing", "inter_0_mul", "f_ind_02_cat__code", "new_ind_count")] == sorted(
        new.index(c) for c in ("f_calc_01", "missing", "inter_0_mul", "f_ind_02_cat__code", "new_ind_count"))
