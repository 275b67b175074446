"""Column expressions every operator uses: missing values, labels, moments, ranks, bins.

Written for ANSI mode: divisions that may meet zero are ``try_divide``, and no
expression depends on a session setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONS = (T.FloatType, T.DoubleType)
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def finite(df: DataFrame, name: str) -> Column:
    """A number as double, null where it is null, NaN or infinite."""
    c = F.col(name).cast("double")
    if isinstance(kind_of(df, name), FRACTIONS):
        return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    return c


def label(df: DataFrame, name: str) -> Column:
    """A category as text the way Python writes it: True, 1.0, 2024-01-31 00:00:00."""
    kind = kind_of(df, name)
    if isinstance(kind, T.BooleanType):
        return F.when(F.col(name), "True").when(~F.col(name), "False")
    return F.col(name).cast("string")


def m2(c: Column) -> Column:
    """Sum of squared deviations from the mean, mergeable over partitions."""
    return F.regr_sxx(c, c)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are there; null where one is constant."""
    r = F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))


def rank_bin(rank: Column, n: Column, bins: int) -> Column:
    """Equal-frequency bin of an average rank; ties share a bin."""
    return F.least(F.greatest(F.floor((rank - 1) * bins / n), F.lit(0)), F.lit(bins - 1)).cast("long")


def width_bin(c: Column, lo: Column, width: Column, bins: int) -> Column:
    """Equal-width bin; both ends fall inside."""
    return F.least(F.greatest(F.floor((c - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("long")


def nearest(values: Column, q: float) -> Column:
    """The element of a sorted array at rank round((n - 1) q), halves up."""
    at = F.floor((F.size(values) - 1) * F.lit(q) + 0.5).cast("int")
    return F.get(values, at)


def bucket(c: Column, unit: str) -> Column:
    """Start of the day, week (from Monday), month or year."""
    return F.date_trunc(unit, c)


def row_hash(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in df.columns))
