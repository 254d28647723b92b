"""File sources and sinks: CSV tables, partitioned score tables, feature blocks, per-feature files.

Paths are folders on shared storage; scratch output goes under the cluster's
``spark.checkpoint.dir`` (see ``rankfold.session.scratch_dir``).
"""

from __future__ import annotations

import os
import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV without index; one folder of part files."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             columns: Sequence[str] | None = None) -> DataFrame:
    """Headered CSV with an explicit schema (inference only when no schema is given).

    ``columns`` keeps only those columns; the CSV scan then parses only them.
    """
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    return df.select(*columns) if columns else df


def write_scores(scores: DataFrame, path: str) -> None:
    """Long score table written partitioned by model and split (one folder per member file)."""
    scores.write.mode("overwrite").partitionBy("model", "split").parquet(path)


def read_scores(spark: SparkSession, path: str, models: Sequence[str] | None = None) -> DataFrame:
    """All member score files in one read; a model filter prunes partitions at planning time."""
    df = spark.read.parquet(path)
    return df.where(F.col("model").isin(list(models))) if models else df


def write_feature_block(block: DataFrame, path: str) -> None:
    """Persist a (train, test) feature block pair as one table partitioned by split."""
    block.write.mode("overwrite").partitionBy("split").parquet(path)


def read_feature_block(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def write_checkpoint_scores(scores: DataFrame, path: str, seed: int) -> None:
    """Overwrite only partition ``seed=s`` of the interim prediction table (dynamic overwrite)."""
    (scores.withColumn("seed", F.lit(seed)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("seed").parquet(path))


def write_feature_files(df: DataFrame, cols: Sequence[str], folder: str, key: str = "id") -> None:
    """One file set per feature column, named after the column: ``<folder>/<col>.parquet``."""
    for c in cols:
        df.select(key, F.col(c).cast("double").alias("value")).write.mode("overwrite").parquet(
            os.path.join(folder, f"{c}.parquet"))


def read_feature_files(spark: SparkSession, folder: str, contains: Sequence[str], key: str = "id") -> DataFrame:
    """Pick every ``<name>.parquet`` in ``folder`` whose name contains one of ``contains`` and attach
    each as a column named after the file: one read of all picked files and one pivot on ``key``."""
    pattern = os.path.join(folder, "*{" + ",".join(contains) + "}*.parquet")
    raw = spark.read.parquet(pattern)
    # Column names come from the file listing (metadata only), not from a scan of the rows.
    names = sorted({re.search(r"/([^/]+)\.parquet/[^/]+$", f).group(1) for f in raw.inputFiles()})
    df = raw.select(key, "value",
                    F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.parquet/[^/]+$", 1).alias("_name"))
    return df.groupBy(key).pivot("_name", names).agg(F.first("value"))
