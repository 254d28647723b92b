"""Global-order operators without a single-partition window.

An un-partitioned ``Window.orderBy`` sends every row to one task. All global-order
operators here (average-tie percentile rank, Lorenz curve, normalized Gini, row
numbers, hash-ordered folds) share one exact, deterministic prefix-sum plan:

1. collapse rows to distinct order values (``groupBy`` with map-side partial
   aggregation, so a value held by a third of the rows is one row after the
   combine);
2. give every value a bucket: split points from ``approxQuantile`` (any split
   points give an exact answer; quantiles only balance the work) or a caller
   supplied bucket column such as a hash prefix;
3. per-bucket totals (``groups x buckets`` rows) get a running sum over buckets and are joined
   back as offsets (AQE broadcasts them when they are few);
4. a running sum inside ``(group, bucket)`` window partitions plus the offset is
   the exact number (and label mass) of rows ordered before each value.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.session import materialize

_B = "_bucket"
# Private names of the multiplicity column and its prefix totals (never clash with user columns).
N, N_BEFORE, N_TOTAL = "_rt_n", "_rt_n_before", "_rt_n_total"
_PARTS, _PART = "_hot_parts", "_hot_part"
# Rows of one value that a task of the rank join may get.
HOT_ROWS = 500_000


def default_buckets(spark) -> int:
    """Bucket count scaled with the cluster's shuffle width."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(64, 4 * n)


def as_double(df: DataFrame, value: str) -> Column:
    """``value`` as a double that keeps its order (dates as days); NaN becomes NULL, that is missing."""
    kind = df.schema[value].dataType
    x = (F.unix_date(value) if isinstance(kind, T.DateType) else F.col(value)).cast("double")
    return F.when(~F.isnan(x), x)


def inner_splits(quantiles: Sequence[float]) -> list[float]:
    """Finite split points in ascending order, closed by the infinities."""
    return [float("-inf"), *sorted({q for q in quantiles if math.isfinite(q)}), float("inf")]


def quantile_bucket(df: DataFrame, value: str, num_buckets: int) -> DataFrame:
    """Add ``_bucket`` (0..k) from approximate quantile split points of column ``value``.

    The split points are a driver-side list bounded by ``num_buckets``; the
    assignment itself is a JVM binary search per row. Without a finite split point (an empty
    or constant-infinite column) all rows share one bucket.
    """
    probs = [i / num_buckets for i in range(1, num_buckets)]
    rel = max(1e-4, 1.0 / (4 * num_buckets))
    tmp = "_qv"
    vals = df.select(as_double(df, value).alias(tmp)).where(F.col(tmp).isNotNull())
    splits = inner_splits(vals.approxQuantile(tmp, probs, rel) if probs else [])
    if len(splits) < 3:
        return df.withColumn(_B, F.lit(0.0))
    bz = Bucketizer(splits=splits, inputCol=tmp, outputCol=_B, handleInvalid="keep")
    return bz.transform(df.withColumn(tmp, as_double(df, value))).drop(tmp)


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    sums: Sequence[str] = (),
    descending: bool = False,
    bucket: Column | None = None,
    distinct: bool = True,
    num_buckets: int | None = None,
    counted: str | None = None,
) -> DataFrame:
    """Per distinct ``(by, order)`` value: ``N`` rows, ``N_BEFORE`` rows ordered strictly before it
    within its ``by`` group, ``N_TOTAL`` rows of the group (module constants), and the same for
    every column in ``sums`` (``<s>``, ``<s>_before``, ``<s>_total``).

    ``distinct=False`` declares that ``order`` is unique per row (ids, hashes): the
    collapse is skipped and every input column is kept. ``counted`` names a column of an
    input that is already collapsed (one row per distinct value) holding each value's
    multiplicity; such input is not filtered (give NULL values multiplicity 0).
    Otherwise rows whose ``order`` columns are NULL or NaN are left out.
    """
    by, order, sums = list(by), list(order), list(sums)
    if descending and bucket is not None:
        raise ValueError("descending order with a caller bucket: negate the bucket instead")
    # A pre-collapsed input carries weight 0 for values it wants ignored; filtering it here
    # would change its plan and stop Spark from reusing the shared collapse exchange.
    rows = df if counted is not None else df.where(_all_present(df, order))
    if bucket is not None:
        # A caller bucket must be a function of the order value (hash prefix, per-column quantile bucket).
        rows = rows.withColumn(_B, bucket)
    keys = [*by, *order] + ([_B] if bucket is not None else [])
    if counted is not None:
        base = rows.withColumnRenamed(counted, N)
    elif distinct:
        aggs = [F.count(F.lit(1)).alias(N)] + [F.sum(s).alias(s) for s in sums]
        base = rows.groupBy(*keys).agg(*aggs)
        if bucket is None:
            # Read three times (quantiles, totals, running sums): written once, one row per distinct value.
            base = materialize(base, "collapsed")
    else:
        base = rows.withColumn(N, F.lit(1).cast("long"))
    if bucket is None:
        if len(order) != 1:
            raise ValueError("quantile buckets need exactly one numeric order column")
        k = num_buckets or default_buckets(df.sparkSession)
        base = quantile_bucket(base, order[0], k)
        if descending:
            base = base.withColumn(_B, -F.col(_B))
    # Offsets: one row per (group, bucket) -> running sum over buckets; bounded by groups x buckets.
    measure = [N] + sums
    bt = base.groupBy(*by, _B).agg(*[F.sum(m).alias(f"_bt_{m}") for m in measure])
    wb = Window.partitionBy(*by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    wg = Window.partitionBy(*by)
    bt = bt.select(*by, _B, *[F.coalesce(F.sum(f"_bt_{m}").over(wb), F.lit(0)).alias(f"_off_{m}") for m in measure],
                   *[F.sum(f"_bt_{m}").over(wg).alias(f"{m}_total") for m in measure])
    keep = [c for c in base.columns if c != _B]
    # bt has at most groups x buckets rows: AQE broadcasts it when that is small (few groups)
    # and falls back to a shuffled join for many small groups.
    j = base.join(bt, [*by, _B])
    ord_cols = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]
    wi = Window.partitionBy(*by, _B).orderBy(*ord_cols).rowsBetween(Window.unboundedPreceding, -1)
    return j.select(
        *keep,
        *[(F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(wi), F.lit(0))).alias(f"{m}_before") for m in measure],
        *[F.col(f"{m}_total") for m in measure],
    )


def _all_present(df: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            cond = cond & ~F.isnan(c)
    return cond


def avg_rank_expr() -> Column:
    """1-based average rank of a tie group from the prefix totals."""
    return F.col(N_BEFORE) + (F.col(N) + F.lit(1)) / F.lit(2.0)


def pct_rank(df: DataFrame, score: str, by: Sequence[str] = (), out: str = "pct_rank",
             num_buckets: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """pandas ``rank(pct=True)``: average rank of ties divided by the non-null count of the group.

    Exact at any scale. The distinct-value table is joined back on ``(by, score)``;
    AQE turns that join into a broadcast when the distinct table is small, and the rows of
    a value held by more than ``hot_rows`` are dealt to as many parts of about that many
    rows. NULL and NaN scores get a NULL rank and do not count.
    """
    by = list(by)
    keys = [*by, score]
    counted = df.where(_all_present(df, [score])).groupBy(*keys).agg(F.count(F.lit(1)).alias(N))
    # Read by the quantiles, the totals, the running sums and the search for hot values: written once.
    counted = materialize(counted, "collapsed")
    t = running_totals(counted, [score], by=by, counted=N, num_buckets=num_buckets)
    t = t.select(*keys, N, (avg_rank_expr() / F.col(N_TOTAL)).alias(out))
    # At most one hot value per hot_rows rows.
    hot = counted.where(F.col(N) > hot_rows)
    if hot.isEmpty():
        return df.join(t.drop(N), keys, "left")
    parts = F.ceil(F.col(N) / F.lit(hot_rows)).cast("int")
    dealt = df.join(F.broadcast(hot.select(*keys, parts.alias(_PARTS))), keys, "left")
    dealt = dealt.withColumn(_PART, F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col(_PARTS)), F.lit(0)).cast("int")).drop(_PARTS)
    copies = F.when(F.col(N) > hot_rows, parts).otherwise(F.lit(1))
    t = t.withColumn(_PART, F.explode(F.sequence(F.lit(0), copies - 1))).drop(N)
    return dealt.join(t, [*keys, _PART], "left").drop(_PART)


def row_number_by(df: DataFrame, key: str, out: str = "row_id", by: Sequence[str] = (),
                  num_buckets: int | None = None) -> DataFrame:
    """0-based position of each row in ``key`` order (``key`` unique within ``by``)."""
    t = running_totals(df, [key], by=by, distinct=False, num_buckets=num_buckets)
    return t.withColumn(out, F.col(N_BEFORE)).drop(N, N_BEFORE, N_TOTAL)


def hash_order_position(df: DataFrame, hash_col: str, tie: str, by: Sequence[str] = (),
                        prefix_len: int | None = None, out: str = "pos") -> DataFrame:
    """0-based position in ``(hash_col, tie)`` order within ``by``; buckets are the first
    ``prefix_len`` hex digits of the hash (16**prefix_len buckets per group). By default there are at least
    sixteen times as many as ``default_buckets``, so they follow the cluster's shuffle width."""
    if prefix_len is None:
        prefix_len = math.ceil(math.log(16 * default_buckets(df.sparkSession), 16))
    bucket = F.substring(F.col(hash_col), 1, prefix_len)
    t = running_totals(df, [hash_col, tie], by=by, bucket=bucket, distinct=False)
    return t.withColumn(out, F.col(N_BEFORE)).drop(N, N_BEFORE, N_TOTAL)


def lorenz(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
           num_buckets: int | None = None) -> DataFrame:
    """Lorenz curve in descending score order, one point per distinct score (ties are one step).

    Columns: ``by``, score, ``cum_share_rows`` (rows with score >= s / n),
    ``cum_share_label`` (label mass with score >= s / total), and ``diag_gap`` =
    cum_share_rows - cum_share_label.
    """
    by = list(by)
    t = running_totals(df.where(F.col(label).isNotNull()), [score], by=by, sums=[label], descending=True,
                       num_buckets=num_buckets)
    rows = (F.col(N_BEFORE) + F.col(N)) / F.col(N_TOTAL)
    # A group without label mass has no Lorenz curve: NULL.
    lab = F.try_divide((F.col(f"{label}_before") + F.col(label)).cast("double"), F.col(f"{label}_total"))
    return t.select(*by, score, rows.alias("cum_share_rows"), lab.alias("cum_share_label"),
                    (rows - lab).alias("diag_gap"))


def _gini_area(t: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Area between diagonal and Lorenz curve with ties spread evenly (reference formula, true division).

    G = (n+1)/2 - (1/T) * sum_v [ c_v * S_before(v) + y_v * (c_v + 1) / 2 ]
    """
    term = F.col(N) * F.col(f"{label}_before") + F.col(label) * (F.col(N) + 1) / F.lit(2.0)
    return t.groupBy(*by).agg(
        ((F.first(N_TOTAL) + 1) / F.lit(2.0) - F.try_divide(F.sum(term), F.first(f"{label}_total"))).alias("_g"),
        F.first(N_TOTAL).alias("n"),
    )


def gini(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
         num_buckets: int | None = None, out: str = "gini") -> DataFrame:
    """Normalized Gini: area(score order) / area(label order), one row per ``by`` group.

    Equals 2*AUC-1 for 0/1 labels with tied scores counted as half; rows with a NULL
    label or score (NaN scores too) are left out. A group whose labels are all equal or sum to 0 has
    no order to compare with: NULL.
    """
    by = list(by)
    clean = df.where(_all_present(df, [label, score])).select(
        *by, F.col(label).cast("double").alias("_y"), F.col(score).alias("_s"))
    pred = running_totals(clean, ["_s"], by=by, sums=["_y"], descending=True, num_buckets=num_buckets)
    # The perfect order needs the label's counts only: labels are classes, a handful of rows per group.
    counts = clean.groupBy(*by, F.col("_y").alias("_s2")).agg(F.count(F.lit(1)).alias(N), F.sum("_y").alias("_y"))
    before = Window.partitionBy(*by).orderBy(F.col("_s2").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    true = counts.select("*", F.coalesce(F.sum("_y").over(before), F.lit(0.0)).alias("_y_before"),
                         F.sum("_y").over(whole).alias("_y_total"), F.sum(N).over(whole).alias(N_TOTAL))
    # One row per group on each side: tag, union and aggregate per group (no join needed).
    gp = _gini_area(pred, "_y", by).withColumn("_side", F.lit("p"))
    gt = _gini_area(true, "_y", by).withColumn("_side", F.lit("t"))
    both = gp.unionByName(gt)
    g_pred = F.max(F.when(F.col("_side") == "p", F.col("_g")))
    g_true = F.max(F.when(F.col("_side") == "t", F.col("_g")))
    n = F.max(F.when(F.col("_side") == "p", F.col("n")))
    return both.groupBy(*by).agg(F.try_divide(g_pred, g_true).alias(out), n.alias("n"))
