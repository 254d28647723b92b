"""Map the driver's star-schema tables onto the wide labelled/unlabelled table the operators expect.

The row entity is an order (``lineitem`` has no unique key). Feature columns follow
the ``f_<family>_<nn>[_cat|_bin]`` convention of ``rankfold.roles``. This module only
shapes input rows; every operator does its own work on whatever rows it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.sources.tables import read_table

# Statistic targets / interaction columns and the extra group column of the fixture grid.
GRID_TARGETS = ["f_car_13", "f_ind_03", "f_reg_03", "f_ind_15", "f_reg_01", "f_ind_01"]
GRID_GROUPS = GRID_TARGETS + ["f_ind_02_cat"]

# Stand-in member scores (no training needed): member name -> score column, one for each blend weight.
PSEUDO_MODELS = {
    "keras5": "f_reg_03", "lgbm3": "f_calc_01", "xgb0": "f_car_15", "lgbm1": "f_ind_15", "keras3": "f_car_11", "logistic1": "f_car_12",
    "xgblinear": "f_car_13", "lgbm8": "f_ind_01", "lgbm5": "f_reg_01", "lgbm6": "f_ind_03", "lgbm7": "f_reg_02_cat", "keras6": "f_ind_02_cat",
    "keras7": "f_ind_06_bin",
}


def _line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min("l_quantity").alias("min_qty"),
        F.max("l_discount").alias("max_disc"),
        F.max("l_tax").alias("max_tax"),
        F.max("l_returnflag").alias("max_rf"),
        F.max("l_linestatus").alias("max_ls"),
        F.max("l_extendedprice").alias("max_price"),
    )


def is_train(key: Column) -> Column:
    """Train/test designation of the fixture (40 % train)."""
    return F.pmod(key, F.lit(5)) < 2


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table: id, split, target (NULL on test) and 16 features with -1 as missing."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # The line summary is as long as the orders: a shuffled join on the order key at every size.
    li = _line_summary(spark, sf_dir).hint("merge")
    # Customers grow with the orders, and their files are far smaller than their rows: never collected for a broadcast.
    j = (o.join(c.hint("merge"), o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey)
         .join(li, li.l_orderkey == o.o_orderkey, "left"))
    train = is_train(F.col("o_orderkey"))
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.when(train, "train").otherwise("test").alias("split"),
        F.when(train, (F.col("o_orderstatus") == "F").cast("int")).alias("target"),
        F.coalesce(F.col("n_lines"), F.lit(-1)).cast("int").alias("f_ind_01"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("f_ind_02_cat"),
        F.month("o_orderdate").cast("int").alias("f_ind_03"),
        F.col("c_mktsegment").alias("f_ind_04_cat"),
        (F.col("c_acctbal") < 0).cast("int").alias("f_ind_06_bin"),
        F.dayofmonth("o_orderdate").cast("int").alias("f_ind_15"),
        (F.col("n_regionkey").cast("double") / 10).alias("f_reg_01"),
        F.col("c_nationkey").alias("f_reg_02_cat"),
        F.col("c_acctbal").alias("f_reg_03"),
        F.coalesce(F.col("max_rf"), F.lit("-1")).alias("f_car_01_cat"),
        F.coalesce(F.col("max_ls"), F.lit("-1")).alias("f_car_02_cat"),
        F.coalesce(F.col("min_qty"), F.lit(-1.0)).alias("f_car_11"),
        F.coalesce(F.col("max_disc"), F.lit(-1.0)).alias("f_car_12"),
        F.coalesce(F.col("max_tax"), F.lit(-1.0)).alias("f_car_13"),
        F.coalesce(F.col("max_price"), F.lit(-1.0)).alias("f_car_15"),
        F.col("o_totalprice").alias("f_calc_01"),
    )


def planted_label(df: DataFrame, name: str = "target") -> DataFrame:
    """Replace ``target`` on train rows by a label that depends on ``f_reg_03`` with hash noise."""
    s = (F.col("f_reg_03") > 6000).cast("int")
    flip = F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(":lbl"))), 1, 1) < "3"
    lbl = F.when(flip, 1 - s).otherwise(s)
    return df.withColumn(name, F.when(F.col("split") == "train", lbl.cast("int")))


def pseudo_scores(df: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """Long score table (id, model, split, score) taking existing columns as member scores."""
    models = models or PSEUDO_MODELS
    # One scan of the sources for all members.
    members = [F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in models.items()]
    return df.select("id", "split", F.inline(F.array(*members))).select("id", "model", "split", "score")
