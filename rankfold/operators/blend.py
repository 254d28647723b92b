"""Percentile-rank blending of member scores.

Member scores live in one long table ``(id, model, split, score)``. Ranking is
per (model, split) with the exact average-tie percentile rank; weights are literals; the
blend is one ``groupBy(id, split)``.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.operators.order import pct_rank
from rankfold.session import materialize

# Member weights of the reference's 13-member blend (sum 1.75).
REFERENCE_WEIGHTS = {
    "keras5": 0.4, "lgbm3": 0.5, "xgb0": 0.1, "lgbm1": -0.1, "keras3": 0.1, "logistic1": 0.1,
    "xgblinear": 0.1, "lgbm8": 0.25, "lgbm5": 0.1, "lgbm6": -0.1, "lgbm7": 0.1, "keras6": -0.1, "keras7": 0.3,
}


def rank_members(scores: DataFrame, key: str = "id") -> DataFrame:
    """Add ``pct`` = percentile rank of the score within its (model, split)."""
    return pct_rank(scores, "score", by=["model", "split"], out="pct")


def _covered(wide: DataFrame, models: list[str], missing: str) -> DataFrame:
    """Apply the coverage policy to a wide member table: ``error`` fails the job when a member lacks
    an id that another one has, ``drop`` leaves such ids out, ``null`` keeps them."""
    if missing not in ("error", "drop", "null"):
        raise ValueError(f"unknown coverage policy {missing!r}")
    if missing == "null":
        return wide
    lacks = F.lit(False)
    for m in models:
        lacks = lacks | F.col(f"`{m}`").isNull()
    if missing == "drop":
        return wide.where(~lacks)
    return wide.where(F.when(lacks, F.raise_error(F.lit("a member has no score for some id")).cast("boolean")).otherwise(F.lit(True)))


def _side_by_side(long: DataFrame, models: list[str], value: str, key: str) -> DataFrame:
    """One row per (key, split) with a column per member. One aggregate on (key, split): a row per id in a task's table
    where a pivot keeps one per id and member."""
    return long.groupBy(key, "split").agg(*[F.first(F.when(F.col("model") == m, F.col(value)), ignorenulls=True).alias(m) for m in models])


def join_members(scores: DataFrame, models: list[str], key: str = "id", missing: str = "error") -> DataFrame:
    """Wide (key, split, <model>...) table of member scores under a coverage policy (``_covered``)."""
    return _covered(_side_by_side(scores, models, "score", key), models, missing)


def blend(scores: DataFrame, weights: Mapping[str, float] = REFERENCE_WEIGHTS, key: str = "id", rerank: bool = False,
          missing: str = "error") -> DataFrame:
    """Weighted sum of member percentile ranks per (key, split); ``rerank`` ranks the blend again.

    Ranks are set side by side, one column per member (one shuffle on (key, split)), and summed
    in the fixed member order of ``weights``, so every row's blend is the same
    floating-point expression and tied rank tuples give bit-identical scores. ``missing`` is the
    coverage policy for ids that a member lacks.
    """
    models = list(weights)
    ranked = rank_members(scores.where(F.col("model").isin(models)), key)
    # After the rank join an id's rows lie apart: brought together first, nothing to combine before that.
    met = ranked.select(key, "split", "model", "pct").repartition(key, "split")
    wide = _covered(_side_by_side(met, models, "pct", key), models, missing)
    total = None
    for m in models:
        term = F.lit(float(weights[m])) * F.col(f"`{m}`")
        total = term if total is None else total + term
    out = wide.select(key, "split", total.alias("score"))
    if rerank:
        out = pct_rank(materialize(out, "blend"), "score", by=["split"], out="target").drop("score")
    return out


def blend_equal(scores: DataFrame, model_a: str, model_b: str, key: str = "id") -> DataFrame:
    """0.5/0.5 mean of two members' percentile ranks."""
    return blend(scores, {model_a: 0.5, model_b: 0.5}, key)
