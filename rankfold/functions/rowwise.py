"""Row-wise column expressions (all JVM-side, whole-stage codegen; no UDFs).

Each helper returns ``Column`` expressions or a DataFrame with added columns, so a
whole feature block lands in one ``select``.
"""

from __future__ import annotations

import operator
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL = -1


def _is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _is_fractional(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def is_sentinel(df: DataFrame, c: str, sentinel: int = SENTINEL) -> Column:
    """True where column ``c`` holds the missing sentinel (numeric -1, or the text '-1')."""
    lit = F.lit(str(sentinel)) if _is_string(df, c) else F.lit(sentinel)
    return F.coalesce(F.col(c) == lit, F.lit(False))


def missing_count(df: DataFrame, cols: list[str], sentinel: int = SENTINEL) -> Column:
    """Per-row number of sentinel values over ``cols``, as double."""
    terms = [is_sentinel(df, c, sentinel).cast("int") for c in cols]
    return reduce(operator.add, terms).cast("double") if terms else F.lit(0.0)


def null_count(df: DataFrame, cols: list[str]) -> Column:
    """Per-row number of NULL (or NaN) values over ``cols``, as int."""
    terms = [((F.col(c).isNull() | F.isnan(F.col(c))) if _is_fractional(df, c) else F.col(c).isNull()).cast("int")
             for c in cols]
    return reduce(operator.add, terms) if terms else F.lit(0)


def sentinel_to_null(df: DataFrame, cols: list[str], sentinel: int = SENTINEL) -> DataFrame:
    """``replace(-1, NaN)``: sentinel becomes NULL in the given columns."""
    return df.select(*[F.when(is_sentinel(df, c, sentinel), None).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def nonfinite_to_zero(c: str | Column) -> Column:
    """NaN, NULL, +inf and -inf become 0 (``replace([inf, -inf, nan], 0)``)."""
    x = F.col(c) if isinstance(c, str) else c
    xd = x.cast("double")
    bad = xd.isNull() | F.isnan(xd) | (F.abs(xd) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(xd)


def recode_negative(c: str, code: int = 99) -> Column:
    """Categorical value ``< 0`` becomes ``code``."""
    return F.when(F.col(c) < 0, F.lit(code)).otherwise(F.col(c)).alias(c)


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields NULL instead of raising under ANSI mode when the divisor is 0.

    The reference gets inf/NaN here and later maps non-finite values to 0; NULL goes
    through ``nonfinite_to_zero`` to the same 0.
    """
    return F.try_divide(a.cast("double"), b.cast("double"))


def interaction_cols(f1: str, f2: str, prefix) -> list[Column]:
    """``inter_{p}_mul`` = f1*f2 and ``inter_{p}_div`` = f1/f2 (the reference's ``*`` and ``/`` suffixes)."""
    a, b = F.col(f1).cast("double"), F.col(f2).cast("double")
    return [(a * b).alias(f"inter_{prefix}_mul"), safe_div(a, b).alias(f"inter_{prefix}_div")]


def all_pair_interactions(cols: list[str]) -> list[Column]:
    """All C(k,2) unordered pairs -> 2 columns each, numbered in ``combinations`` order."""
    out: list[Column] = []
    for e, (x, y) in enumerate(combinations(cols, 2)):
        out.extend(interaction_cols(x, y, e))
    return out


def composite_key(cols: list[str], sep: str = "_", trailing: bool = False) -> Column:
    """String forms of ``cols`` joined with ``sep`` (optionally with a trailing separator)."""
    key = F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])
    return F.concat(key, F.lit(sep)) if trailing else key
