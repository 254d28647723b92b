"""Frequency and group-statistic features, joined back to every row.

Counts come from ``operators.categories`` (one aggregate for all columns, no codes). Group statistics are
fitted once for a whole grid of (target, group) pairs and applied with one join per group column:

* one grouping-sets aggregation over all group columns yields size, mean, sample std, max
  and min of all targets, with map-side combining and every key in its own type;
* the same pass brackets every median with two approximate percentiles; a second pass counts
  the values below the bracket and collapses those inside it, from which the exact
  interpolated median is picked. Where a bracket can hold more than ``MIDDLE_ROWS`` distinct values
  (a thousandth of a very large group), it is narrowed first: the values are counted in cells
  between split points, and only the cell of the middle is kept, until few are left. So no
  task orders more than ``MIDDLE_ROWS`` values of a group, whatever the group's size.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.operators.categories import distinct_counts, fit_counts, join_side, lookup, salted_lookup, small
from rankfold.operators.order import as_double
from rankfold.session import materialize

STATS = ("size", "mean", "std", "median", "max", "min")
# The sketch's rank error is n / ACCURACY; the bracket reaches five times as far around the middle.
ACCURACY = 10_000
BRACKET = 5 / ACCURACY
# Distinct values of one (group, target) that a single task may order; cells a narrowing pass counts.
MIDDLE_ROWS = 65_536
CELLS = 64


def stat_name(t: str, g: str, stat: str) -> str:
    return f"{t}__by__{g}__{stat}"


# ---------------------------------------------------------------- counts

def value_counts(df: DataFrame, cols: Sequence[str], fmt: str = "{}_count", fit_df: DataFrame | None = None) -> DataFrame:
    """``{c}_count`` = frequency of the row's value of ``c`` over all rows of ``fit_df`` (default: ``df``).

    A NULL or unseen value finds no entry and gets 0, like a dictionary lookup with default 0.
    """
    counted = fit_counts(fit_df if fit_df is not None else df, cols).count(df, cols, fmt)
    return counted.select(*df.columns, *[fmt.format(c) for c in cols])


def composite_counts(df: DataFrame, cols: Sequence[str], name: str, fit_df: DataFrame | None = None) -> DataFrame:
    """Frequency of the combination of ``cols`` (a composite key) over ``fit_df`` (default: ``df``), grouped on the columns.

    Grouping on the column list instead of a concatenated string keeps doubles exact
    (their text forms differ between engines) and treats NULL as a value, as the
    string key would. Joined back null-safely; the counts are written first, so that the join knows how many they are.
    """
    cols = list(cols)
    counts = (fit_df if fit_df is not None else df).groupBy(*cols).agg(F.count(F.lit(1)).alias(name))
    counts = materialize(counts.select(*[F.col(c).alias(f"_ck_{c}") for c in cols], name), "composites")
    cond = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"_ck_{c}"))
        cond = e if cond is None else cond & e
    j = df.join(join_side(counts, counts.count()), cond, "left")
    return j.select(*df.columns, F.coalesce(F.col(name), F.lit(0)).alias(name))


def cat_size(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """``{cat}_size``: group size per value, joined back (NULL key -> NULL size)."""
    sized = fit_counts(df, cats).count(df, cats, "{}_size", default=None)
    return sized.select(*df.columns, *[f"{c}_size" for c in cats])


def overlay_column(df: DataFrame, repaired: DataFrame, column: str, key: str = "id") -> DataFrame:
    """``column`` replaced by its version in ``repaired`` (key, column) where that has one, in place."""
    new = repaired.select(key, F.col(column).alias("__new"))
    return df.join(new, key, "left").select(*[F.coalesce("__new", c).alias(c) if c == column else F.col(c) for c in df.columns])


def nunique(df: DataFrame, cols: Sequence[str], composites: dict[str, Sequence[str]] | None = None, approx: bool = False) -> DataFrame:
    """``{c}_nunique`` of each column and of each named composite key (one row)."""
    parts = [distinct_counts(df, cols, approx)]
    for name, members in (composites or {}).items():
        keys = df.select(*members).distinct()
        parts.append(keys.agg(F.count(F.lit(1)).alias("n_distinct")).select(F.lit(name).alias("column"), "n_distinct"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.agg(*[F.max(F.when(F.col("column") == c, F.col("n_distinct"))).alias(f"{c}_nunique") for c in [*(composites or {}), *cols]])


# ---------------------------------------------------------------- group statistics

@dataclass
class GroupStats:
    """Fitted statistics: per group column a table with one row per value, and its row count."""

    tables: dict[str, DataFrame]
    rows: dict[str, int]

    def transform(self, df: DataFrame) -> DataFrame:
        """Join every table to ``df``; NULL and unseen group values get NULL statistics.

        Large tables first: their joins shuffle and sort the rows of ``df``, which then do not yet carry the statistics of the small,
        broadcast tables. Until all are joined, the statistics of a table are one column.
        """
        out, new = df, {}
        for i, g in sorted(enumerate(self.tables), key=lambda p: (small(self.rows[p[1]]), p[0])):
            stats = [c for c in self.tables[g].columns if c != g]
            out = lookup(out, self.tables[g].select(g, F.struct(*stats).alias(f"__s{i}")), g, self.rows[g])
            new[g] = [F.col(f"__s{i}")[c].alias(c) for c in stats]
        return out.select(*df.columns, *[c for g in self.tables for c in new[g]])

    def each(self, change: Callable[[DataFrame, str], DataFrame]) -> GroupStats:
        """The tables as ``change(table, group column)`` gives them: work on statistics that is done once a group, not once a row."""
        return GroupStats({g: change(t, g) for g, t in self.tables.items()}, self.rows)


def narrowed_middles(values: DataFrame, below: DataFrame, keys: Sequence[str], middle_rows: int = MIDDLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``values`` and ``below`` cut down until no group has more than ``middle_rows`` distinct values.

    ``values`` (keys, _v, _n, _c) holds distinct values, how often each occurs, and the count ``_c`` of all the group's
    values; ``below`` (keys, _b) how many of these are smaller than the values listed. Each pass counts a large group's values in
    ``CELLS`` cells of about equally many distinct values and keeps the cell with both middle places, or the two
    values next to the border that parts them; its distinct values shrink about ``CELLS`` times.
    """
    if middle_rows < 2:
        raise ValueError("a middle may need two values")
    keys = list(keys)
    values, below = materialize(values, "middle_values"), materialize(below, "middle_below")
    shares = F.array(*[F.lit(j / CELLS) for j in range(1, CELLS)])
    lo, hi = F.floor((F.col("_c") - 1) / 2), F.ceil((F.col("_c") - 1) / 2)
    while True:
        large = materialize(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > middle_rows), "middle_large")
        groups = large.count()
        if not groups:
            return values, below
        cuts = salted_lookup(values, large, keys, groups, F.col("_v"), "inner").groupBy(*keys).agg(
            F.percentile_approx("_v", shares, F.lit(ACCURACY)).alias("_cuts"))
        cuts = materialize(cuts, "middle_cuts")
        cell = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        cells = salted_lookup(values, cuts, keys, groups, F.col("_v"), "inner").withColumn("_cell", cell).groupBy(*keys, "_cell").agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.max_by("_n", "_v").alias("_top"), F.first("_c").alias("_c"))
        # At most CELLS rows per group from here on.
        before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.join(below.hint("merge"), keys).withColumn("_first", F.col("_b") + F.coalesce(F.sum("_n").over(before), F.lit(0))) \
                      .withColumn("_last", F.col("_first") + F.col("_n") - 1)
        at_lo, at_hi = lo.between(F.col("_first"), F.col("_last")), hi.between(F.col("_first"), F.col("_last"))
        both = F.struct("_cell", "_low", "_high", "_first", "_last", "_top")
        held = placed.groupBy(*keys).agg(F.max(F.when(at_lo, both)).alias("_l"), F.max(F.when(at_hi, both)).alias("_h"))
        one = F.col("_l._cell") == F.col("_h._cell")
        kept = materialize(held.select(*keys, F.when(one, F.col("_l._low")).otherwise(F.col("_l._high")).alias("_from"),
                                       F.when(one, F.col("_h._high")).otherwise(F.col("_h._low")).alias("_to"),
                                       F.when(one, F.col("_l._first")).otherwise(F.col("_l._last") + 1 - F.col("_l._top")).alias("_nb")), "middle_kept")
        inside = F.col("_nb").isNull() | F.col("_v").between(F.col("_from"), F.col("_to"))
        values = materialize(salted_lookup(values, kept, keys, groups, F.col("_v")).where(inside).select(*values.columns), "middle_values")
        below = materialize(below.join(kept, keys, "left").select(*keys, F.coalesce("_nb", "_b").alias("_b")), "middle_below")


def _median_table(src: DataFrame, fitted: DataFrame, g: str, targets: Sequence[str], rows: int, narrow: bool, middle_rows: int) -> DataFrame:
    """Exact interpolated medians of every target per value of ``g``.

    ``fitted`` has, per value, each target's count ``_c<i>`` and bracket ``_lo<i>``, ``_hi<i>``. ``narrow`` says that
    some bracket may hold more than ``middle_rows`` values. A bracket that misses the middle fails the job.
    """
    x = [F.col(f"_v{i}") for i in range(len(targets))]
    joined = salted_lookup(src, fitted, [g], rows, F.hash(*x))
    below = joined.groupBy(g).agg(*[F.sum((x[i] < F.col(f"_lo{i}")).cast("long")).alias(f"_b{i}") for i in range(len(targets))])
    inside = joined.select(g, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_t"), F.when(x[i].between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), x[i]).alias("_v"), F.col(f"_c{i}").alias("_c"))
        for i in range(len(targets))]))).where("_v is not null")
    # A bracket holds about BRACKET * 2 of a group's values, repeats counted once.
    values = inside.groupBy(g, "_t", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_c").alias("_c"))
    start = below.select(g, F.inline(F.array(*[F.struct(F.lit(i).alias("_t"), F.coalesce(f"_b{i}", F.lit(0)).alias("_b"))
                                               for i in range(len(targets))])))
    if narrow:
        values, start = narrowed_middles(values, start, [g, "_t"], middle_rows)
    before = Window.partitionBy(g, "_t").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_b") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    placed = values.join(start, [g, "_t"]).withColumn("_first", first).withColumn("_last", F.col("_first") + F.col("_n") - 1)
    lo, hi = F.floor((F.col("_c") - 1) / 2), F.ceil((F.col("_c") - 1) / 2)
    picked = placed.groupBy(g, "_t").agg(F.max(F.when(lo.between(F.col("_first"), F.col("_last")), F.col("_v"))).alias("_l"),
                                         F.max(F.when(hi.between(F.col("_first"), F.col("_last")), F.col("_v"))).alias("_h"))
    half = F.col("_l") + (F.col("_h") - F.col("_l")) * F.lit(0.5)
    # Two equal infinities have no difference; their middle is they themselves.
    half = F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise(half)
    missed = F.raise_error(F.lit("a percentile bracket missed the median of a group")).cast("double")
    half = F.when(F.col("_l").isNull() | F.col("_h").isNull(), missed).otherwise(half)
    return picked.groupBy(g).agg(*[F.max(F.when(F.col("_t") == i, half)).alias(stat_name(t, g, "median")) for i, t in enumerate(targets)])


def fit_group_stats(df: DataFrame, pairs: dict[str, Sequence[str]], median: str = "exact", middle_rows: int = MIDDLE_ROWS) -> GroupStats:
    """Statistics of every (group column, targets) pair over all rows of ``df``.

    NULL and NaN target values are missing in all statistics but ``size``; a group without values has
    NULL statistics and std 0; the std of one value is 0. ``median='approx'`` keeps
    the sketch's value and saves the second pass. ``middle_rows`` bounds the values of a group that one task orders.
    """
    if median not in ("exact", "approx"):
        raise ValueError(f"unknown median {median!r}")
    groups = list(pairs)
    targets = list(dict.fromkeys(t for ts in pairs.values() for t in ts))
    src = materialize(df.select(*[F.col(g).alias(f"_g{j}") for j, g in enumerate(groups)],
                                *[as_double(df, t).alias(f"_v{i}") for i, t in enumerate(targets)]), "stats_src")
    keys = [f"_g{j}" for j in range(len(groups))]
    aggs = [F.count(F.lit(1)).alias("_size"), F.grouping_id(*keys).alias("_set")]
    for i in range(len(targets)):
        x = F.col(f"_v{i}")
        aggs += [F.count(x).alias(f"_c{i}"), F.avg(x).alias(f"_mean{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"_std{i}"),
                 F.max(x).alias(f"_max{i}"), F.min(x).alias(f"_min{i}"),
                 F.percentile_approx(x, F.array(*[F.lit(0.5 + d) for d in (-BRACKET, 0.0, BRACKET)]), F.lit(ACCURACY)).alias(f"_q{i}")]
    every = materialize(src.groupingSets([[k] for k in keys], *keys).agg(*aggs), "stats")
    # grouping_id has a bit per key, the first key highest, set where the key is not grouped.
    full = (1 << len(keys)) - 1
    sets = {full ^ (1 << (len(keys) - 1 - j)): j for j in range(len(keys))}
    largest = F.max(F.greatest(F.lit(0), *[F.col(f"_c{i}") for i in range(len(targets))]))
    met = every.groupBy("_set").agg(F.count(F.lit(1)), largest).collect()
    rows = {sets[r[0]]: int(r[1]) for r in met}
    # A bracket holds its share of the group's values and the sketch's error at both ends.
    wide = {sets[r[0]]: r[2] * (2 * BRACKET + 2 / ACCURACY) + 2 > middle_rows for r in met}

    def table(j: int) -> DataFrame:
        g = groups[j]
        mine = [targets.index(t) for t in pairs[g]]
        own = every.where((F.col("_set") == (full ^ (1 << (len(keys) - 1 - j)))) & F.col(keys[j]).isNotNull()).withColumnRenamed(keys[j], g)
        if median == "exact":
            bracket = own.select(g, *[c for n, i in enumerate(mine) for c in (
                F.col(f"_c{i}").alias(f"_c{n}"), F.col(f"_q{i}")[0].alias(f"_lo{n}"), F.col(f"_q{i}")[2].alias(f"_hi{n}"))])
            values = src.select(F.col(keys[j]).alias(g), *[F.col(f"_v{i}").alias(f"_v{n}") for n, i in enumerate(mine)]).where(F.col(g).isNotNull())
            own = own.join(_median_table(values, bracket, g, pairs[g], rows.get(j, 0), wide.get(j, False), middle_rows), g, "left")
        else:
            own = own.select("*", *[F.col(f"_q{i}")[1].alias(stat_name(targets[i], g, "median")) for i in mine])
        columns = []
        for i in mine:
            source = {s: f"_{s}{i}" for s in STATS} | {"size": "_size", "median": stat_name(targets[i], g, "median")}
            columns += [F.col(source[s]).alias(stat_name(targets[i], g, s)) for s in STATS]
        return materialize(own.select(g, *columns), "stats_table")

    # Independent small jobs; the pool only submits them.
    with ThreadPoolExecutor(max_workers=4) as pool:
        tables = list(pool.map(table, range(len(groups))))
    return GroupStats(dict(zip(groups, tables)), {g: rows.get(j, 0) for j, g in enumerate(groups)})


def group_stats_table(df: DataFrame, g: str, targets: Sequence[str], median: str = "exact") -> DataFrame:
    """One row per (non-NULL) value of ``g`` with size, mean, std (sample, 0 for one row), median,
    max, min of every target."""
    return fit_group_stats(df, {g: [t for t in targets if t != g]}, median).tables[g]


def exact_group_medians(df: DataFrame, g: str, targets: Sequence[str]) -> DataFrame:
    """Exact interpolated median of every target per value of group column ``g``."""
    return group_stats_table(df, g, targets).select(g, *[stat_name(t, g, "median") for t in targets])


def group_stats(df: DataFrame, target: str, group: str, **kw) -> DataFrame:
    """``proj_num_on_cat``: six statistics of ``target`` per ``group`` joined back to every row."""
    return group_stats_grid(df, [target], [group], **kw)


def grid_pairs(targets: Sequence[str], groups: Sequence[str]) -> dict[str, list[str]]:
    """All (group, targets) pairs with target != group; groups de-duplicated in order."""
    pairs = {g: [t for t in targets if t != g] for g in dict.fromkeys(groups)}
    return {g: ts for g, ts in pairs.items() if ts}


def group_stats_grid(df: DataFrame, targets: Sequence[str], groups: Sequence[str], median: str = "exact",
                     each: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """All (target, group) pairs with target != group, fitted on ``df`` and joined back to its every row; ``each`` as in ``GroupStats.each``."""
    fitted = fit_group_stats(df, grid_pairs(targets, groups), median)
    return (fitted.each(each) if each else fitted).transform(df)
