"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankfold.llm.common import stage


def _towards_min(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Every edge with ``low``: the smallest node next to its ``key`` node, itself included.

    The minimum is combined before the shuffle. The join back has one row per node on one
    side, so adaptive execution splits a hub's edges freely.
    """
    low = edges.groupBy(key).agg(F.least(F.min(other), F.col(key)).alias("low"))
    return edges.join(low, key)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b); a component is its smallest node.

    Null ends and loops are ignored; repeated edges count once; no edges give an empty result.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    pairs = stage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards_min(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        linked = _towards_min(large, "a", "b")
        small = linked.select("a", F.col("low").alias("b")).unionByName(
            linked.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")))
        pairs = stage(small.where("a <> b").distinct(), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
