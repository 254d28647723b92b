"""Categories fitted once and applied to any table: label codes, counts, one-hot slots.

``fit_categories`` unpivots the columns in one scan and aggregates (column, value) counts with
map-side combining. The distinct values are range-partitioned in (column, value) order, so a
prefix sum over partitions gives every value its code 0..k-1 in sorted order, for any type and
any number of values. The fitted table is written once; applying it is one join per column.
A column's table is broadcast only when its row count, known from the fit, is at most
``BROADCAST_ROWS``; beyond that the join is a merge of shuffled rows that adaptive execution may split.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.operators.order import N_BEFORE, N_TOTAL, running_totals
from rankfold.session import materialize

BROADCAST_ROWS = 20_000
SALTS = 32


def small(rows: int) -> bool:
    """Whether a table of ``rows`` rows is broadcast."""
    return rows <= BROADCAST_ROWS


def join_side(table: DataFrame, rows: int) -> DataFrame:
    """``table`` of ``rows`` rows as the side of a join: broadcast if it is small, else merged.

    Without the hint the planner judges a written table by its files, which may be far smaller than its rows
    (and an exploded one by the rows before), and the driver would collect all of it.
    """
    return F.broadcast(table) if small(rows) else table.hint("merge")


def lookup(df: DataFrame, table: DataFrame, key: str, rows: int) -> DataFrame:
    """Left join of ``table`` (one row per ``key``, ``rows`` rows) onto ``df``."""
    return df.join(join_side(table, rows), key, "left")


def salted_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], rows: int, salt: Column, how: str = "left") -> DataFrame:
    """``lookup`` for results that are aggregated next: a shuffled join is dealt by ``keys`` and a salt made from ``salt``.

    Every key's rows go to up to ``SALTS`` tasks, and an aggregate on ``keys`` after it combines before its own shuffle; after a join
    dealt by ``keys`` alone it would count a key that a third of all rows hold in one task.
    """
    keys = list(keys)
    if small(rows):
        return df.join(F.broadcast(table), keys, how)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(join_side(copies, rows * SALTS), [*keys, "__salt"], how).drop("__salt")


def _sort_form(df: DataFrame, c: str) -> tuple[Column, Column]:
    """(number, text) pair that orders the values of ``c`` and from which they are restored."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        return F.lit(0).cast("decimal(38,0)"), F.col(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("decimal(38,0)"), F.col(c).cast("string")
    if isinstance(kind, T.BooleanType):
        return F.col(c).cast("int").cast("decimal(38,0)"), F.col(c).cast("string")
    if isinstance(kind, T.IntegralType):
        return F.col(c).cast("decimal(38,0)"), F.col(c).cast("string")
    raise TypeError(f"{c}: categories are text, whole numbers, booleans or dates, not {kind.simpleString()}")


def long_values(df: DataFrame, cols: Sequence[str]) -> Column:
    """Generator of one (column, number, text) row per column of ``cols``; ``text`` is NULL where the value is."""
    forms = []
    for c in cols:
        number, text = _sort_form(df, c)
        forms.append(F.struct(F.lit(c).alias("column"), number.alias("number"), text.alias("text")))
    return F.inline(F.array(*forms))


@dataclass
class Counts:
    """Fitted frequencies: ``table`` (column, text, n, ...) and the number of values of every column."""

    table: DataFrame
    sizes: dict[str, int]
    kinds: dict[str, T.DataType]

    def entries(self, c: str, *what: Column) -> DataFrame:
        """The rows of one column: its value in its own type, and ``what``."""
        return self.table.where(F.col("column") == c).select(F.col("text").cast(self.kinds[c]).alias(c), *what)

    def count(self, df: DataFrame, cols: Sequence[str] | None = None, fmt: str = "{}_count", default: int | None = 0) -> DataFrame:
        """Add every value's fitted frequency; ``default`` for NULL and unseen values."""
        for c in cols or list(self.sizes):
            n = F.col("__n") if default is None else F.coalesce("__n", F.lit(default))
            df = lookup(df, self.entries(c, F.col("n").alias("__n")), c, self.sizes[c]).withColumn(fmt.format(c), n).drop("__n")
        return df


@dataclass
class Categories(Counts):
    """Fitted categories: ``table`` (column, number, text, n, code) and the value count ``k`` of every column."""

    def values(self, c: str) -> DataFrame:
        """(value, code, n) of one column, the value in its own type."""
        return self.entries(c, F.col("code").alias("__code"), F.col("n").alias("__n"))

    def _joined(self, df: DataFrame, c: str) -> DataFrame:
        return lookup(df, self.values(c), c, self.sizes[c])

    def encode(self, df: DataFrame, cols: Sequence[str] | None = None, unseen: str = "keep", suffix: str = "") -> DataFrame:
        """Replace each column by its code (or add it under ``suffix``). A NULL or unseen value gets k
        (``keep``), NULL (``null``), or an unseen value fails the job (``error``)."""
        if unseen not in ("keep", "null", "error"):
            raise ValueError(f"unknown policy {unseen!r}")
        for c in cols or list(self.sizes):
            df, code = self._joined(df, c), F.col("__code")
            if unseen == "keep":
                code = F.coalesce(code, F.lit(self.sizes[c]))
            elif unseen == "error":
                told = F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.col(c).cast("string"))).cast("int")
                code = F.when(code.isNull() & F.col(c).isNotNull(), told).otherwise(code)
            df = df.withColumn("__code", code).drop("__n")
            df = df.drop(c).withColumnRenamed("__code", c) if not suffix else df.withColumnRenamed("__code", f"{c}{suffix}")
        return df

    def describe(self, df: DataFrame, cols: Sequence[str] | None = None, code: str = "{}__code", count: str = "{}_count") -> DataFrame:
        """Add code and frequency of every column with one join per column; k and 0 for NULL and unseen values."""
        for c in cols or list(self.sizes):
            df = self._joined(df, c).withColumn("__code", F.coalesce("__code", F.lit(self.sizes[c]))) \
                     .withColumn("__n", F.coalesce("__n", F.lit(0))).withColumnsRenamed({"__code": code.format(c), "__n": count.format(c)})
        return df

    def onehot(self, df: DataFrame, cols: Sequence[str] | None = None, out: str = "onehot", unseen: str = "keep") -> DataFrame:
        """Sparse one-hot vector of the codes; ``keep`` gives unseen values a slot of their own per column.

        The encoder learns its sizes from one row that holds the largest codes, not from the data.
        """
        cols = list(cols or self.sizes)
        extra = int(unseen == "keep")
        coded = self.encode(df, cols, unseen, suffix="__idx")
        idx = [f"{c}__idx" for c in cols]
        top = df.sparkSession.createDataFrame([tuple(max(self.sizes[c] - 1 + extra, 0) for c in cols)], ", ".join(f"{i} int" for i in idx))
        encoder = OneHotEncoder(inputCols=idx, outputCols=[f"{c}__oh" for c in cols], dropLast=False, handleInvalid="error")
        encoded = encoder.fit(top).transform(coded)
        return VectorAssembler(inputCols=[f"{c}__oh" for c in cols], outputCol=out).transform(encoded).drop(*idx, *[f"{c}__oh" for c in cols])

    def largest_codes(self) -> DataFrame:
        """One row with the largest code of every column (``<column>_max``); NULL for a column without values."""
        return self.table.agg(*[F.max(F.when(F.col("column") == c, F.col("code"))).alias(f"{c}_max") for c in self.sizes])


def fit_counts(df: DataFrame, cols: Sequence[str]) -> Counts:
    """Frequencies of all columns from one unpivoted aggregate, written once: no order, no codes. NULL is no value."""
    cols = list(cols)
    counts = df.select(long_values(df, cols)).where("text is not null").groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))
    table = materialize(counts, "counts")
    sizes = {r[0]: int(r[1]) for r in table.groupBy("column").count().collect()}
    return Counts(table, {c: sizes.get(c, 0) for c in cols}, {c: df.schema[c].dataType for c in cols})


def fit_categories(df: DataFrame, cols: Sequence[str]) -> Categories:
    """Fit on all rows of ``df``; NULL is no category."""
    cols, spark = list(cols), df.sparkSession
    counts = df.select(long_values(df, cols)).where("text is not null").groupBy("column", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(width, "column", "number", "text").withColumn("part", F.spark_partition_id())
    # Written with its partition number: the order of the ranges is the order of the values.
    ranged = materialize(ranged, "categories")
    rt = running_totals(ranged, ["number", "text"], by=["column"], bucket=F.col("part"), distinct=False)
    table = materialize(rt.select("column", "number", "text", "n", F.col(N_BEFORE).cast("int").alias("code"),
                                  F.col(N_TOTAL).alias("k")), "categories")
    sizes = {r[0]: int(r[1]) for r in table.groupBy("column").agg(F.max("k")).collect()}
    return Categories(table.drop("k"), {c: sizes.get(c, 0) for c in cols}, {c: df.schema[c].dataType for c in cols})


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Number of distinct non-NULL values of each column: (column, n_distinct).

    Exact: unpivot, drop repeats (map-side), count; values are compared as text with their sign of
    zero dropped. ``approx`` uses one sketch per column and one pass instead.
    """
    if approx:
        one = df.agg(*[F.approx_count_distinct(c, rsd).alias(f"d{i}") for i, c in enumerate(cols)])
        return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(cols)])))

    def form(c):
        fractional = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        return (F.col(c) + F.lit(0.0) if fractional else F.col(c)).cast("string")

    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), form(c).alias("value")) for c in cols]))
    found = df.select(pairs).where("value is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return every.join(found, "column", "left").fillna(0, ["n_distinct"])
