"""Fit/transform encoders, scaling and univariate statistics.

Fitted state is bounded by the schema or the category set: categories
(``operators.categories``), one row of means/stds per numeric column, one F value per feature.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.operators.categories import fit_categories
from rankfold.operators.order import as_double, avg_rank_expr, running_totals
from rankfold.session import materialize


def label_encode(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None,
                 unseen: str = "keep", suffix: str = "") -> DataFrame:
    """Replace each column by its label code, fitted on ``fit_df`` (default: ``df``, train+test).

    ``unseen``: ``'keep'`` gives values missing from the fit set the code k (one past
    the last), ``'error'`` fails the job when such a value occurs. Fit once with
    ``fit_categories`` to apply the codes to several tables.
    """
    return fit_categories(fit_df if fit_df is not None else df, cols).encode(df, cols, unseen, suffix)


def onehot(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None, out: str = "onehot",
           unseen: str = "keep") -> DataFrame:
    """Sparse one-hot vector of the label codes of ``cols``, fitted on ``fit_df`` (train only) or ``df``.

    With ``keep`` an unseen value gets its own extra slot per column.
    """
    return fit_categories(fit_df if fit_df is not None else df, cols).onehot(df, cols, out, unseen)


def vector_slots(df: DataFrame, vec: str, key: str = "id") -> DataFrame:
    """Long form (key, slot, value) of the non-zero entries of a vector column."""
    arr = df.select(key, vector_to_array(vec).alias("_a"))
    return arr.select(key, F.posexplode("_a").alias("slot", "value")).where(F.col("value") != 0)


# ---------------------------------------------------------------- scaling

@dataclass
class Scaler:
    """Mean and population standard deviation of every column (two numbers each)."""

    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """(x - mean) / std as a row-local projection with literals."""
        exprs = [((F.col(c).cast("double") - F.lit(m)) / F.lit(self.stds[c])).alias(c) for c, m in self.means.items()]
        return df.select(*[F.col(c) for c in df.columns if c not in self.means], *exprs)


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """One aggregation over (column, value) rows, as hundreds of aggregates side by side are code too long to be compiled; a column
    without variance or values is divided by 1."""
    pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(cols)]))
    found = {r["_i"]: r for r in df.select(pairs).groupBy("_i").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s")).collect()} if cols else {}
    met = {c: (found[i]["m"], found[i]["s"]) if i in found else (None, None) for i, c in enumerate(cols)}
    return Scaler({c: m or 0.0 for c, (m, _) in met.items()}, {c: s or 1.0 for c, (_, s) in met.items()})


def standard_scale(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std, fitted on ``fit_df`` (default: ``df`` = train+test)."""
    return fit_scaler(fit_df if fit_df is not None else df, cols).transform(df)


# ---------------------------------------------------------------- univariate selection

def f_classif(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """One-way ANOVA F value of every feature against the class label: (feature, pos, f_value).

    One aggregation per class: count, mean and population variance, whose merges are stable for
    large means. A feature without variance between and within classes gives NULL. NaN is missing.
    """
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        x = as_double(df, c)
        aggs += [F.count(x).cast("double").alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"), F.var_pop(x).alias(f"_v{i}"),
                 (F.min(x) == F.max(x)).alias(f"_c{i}")]
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(*aggs)
    stack = ", ".join(f"'{c}', {i}, _n{i}, _m{i}, _v{i}, _c{i}" for i, c in enumerate(cols))
    long = per_class.selectExpr(f"stack({len(cols)}, {stack}) as (feature, pos, n, m, v, flat)").where("n > 0")
    total = Window.partitionBy("feature")
    mean = F.sum(F.col("n") * F.col("m")).over(total) / F.sum("n").over(total)
    # A class of one value has no variance, whatever its mean rounds to.
    inside = F.when(F.col("flat"), F.lit(0.0)).otherwise(F.col("n") * F.col("v"))
    g = long.withColumn("_mean", mean).groupBy("feature", "pos").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(inside).alias("ss_within"),
        F.sum(F.col("n") * (F.col("m") - F.col("_mean")) * (F.col("m") - F.col("_mean"))).alias("ss_between"))
    fval = F.try_divide(F.try_divide(F.col("ss_between"), F.col("k") - 1), F.try_divide(F.col("ss_within"), F.col("n") - F.col("k")))
    return g.select("feature", "pos", fval.alias("f_value"))


def select_percentile(scores: DataFrame, percentile: float = 75.0) -> DataFrame:
    """Keep the best ``int(n * percentile / 100)`` features by F value (NULL/NaN last, ties by position).

    ``scores`` has one row per feature, so ranking them in one window partition is bounded
    by the column count.
    """
    n = scores.count()
    keep_n = int(n * percentile / 100)
    f = F.col("f_value")
    clean = F.when(f.isNull() | F.isnan(f), F.lit(None)).otherwise(f)
    w = Window.orderBy(clean.desc_nulls_last(), F.col("pos").asc())
    return scores.withColumn("keep", F.row_number().over(w) <= keep_n)


def spearman_with_label(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Spearman correlation of ``label`` with every column: Pearson correlation of average ranks.

    All ranks come from one (feature, value, label) count table: values and labels are ranked
    on it, and the correlation is weighted by the counts; no rank is joined back to rows.
    """
    x = [F.struct(F.lit(c).alias("feature"), as_double(df, c).alias("_x")) for c in cols]
    rows = df.where(F.col(label).isNotNull()).select(as_double(df, label).alias("_y"), F.inline(F.array(*x)))
    table = materialize(rows.where("_x is not null and _y is not null").groupBy("feature", "_x", "_y").agg(
        F.count(F.lit(1)).cast("double").alias("_w")), "rank_counts")
    ranked = table
    for value, name in (("_x", "_rx"), ("_y", "_ry")):
        counts = materialize(table.groupBy("feature", value).agg(F.sum("_w").alias("_c")), "rank_values")
        t = running_totals(counts, [value], by=["feature"], counted="_c")
        ranked = ranked.join(t.select("feature", value, avg_rank_expr().alias(name)), ["feature", value])
    w, rx, ry = F.col("_w"), F.col("_rx"), F.col("_ry")
    # Ranks run from 1 to n, so their mean is exactly (n + 1) / 2: sums are taken around it.
    mid = (F.sum("_w").over(Window.partitionBy("feature")) + 1) / 2
    ranked = ranked.withColumn("_dx", rx - mid).withColumn("_dy", ry - mid)
    dx, dy = F.col("_dx"), F.col("_dy")
    cov, vx, vy = F.sum(w * dx * dy), F.sum(w * dx * dx), F.sum(w * dy * dy)
    return ranked.groupBy("feature").agg(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)).alias("spearman"))
