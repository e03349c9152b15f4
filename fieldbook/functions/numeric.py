"""Row-wise arithmetic used by features, labels and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the values present in a row; null if there are none."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.try_divide(total, n)


def row_std(columns: Sequence[str]) -> Column:
    """Sample deviation of the values present in a row; null below two."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    mean = row_mean(columns)
    squares = sum((F.coalesce(F.pow(F.col(c).cast("double") - mean, F.lit(2)), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1)))


def half_even(value: Column) -> Column:
    """Round to an integer, ties to the even neighbour."""
    return F.bround(value, 0)


def ordinal(value: Column, lowest: Column) -> Column:
    """Rank-like integer: 1 for the lowest value, growing by whole steps."""
    return F.ceil(F.lit(1) + value - lowest).cast("bigint")


def flag(condition: Column, kind: str = "int") -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast(kind)


def at_least(score: Column, threshold: float) -> Column:
    return flag(score >= threshold)


def next_level(level: Column, clamp: bool = True) -> Column:
    """The level to aim for: one lower, not below 0 when clamped."""
    return F.when(level > 0, level - 1).otherwise(F.lit(0)) if clamp else level - 1


def linear_score(features: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    """Prediction of a linear model as one expression."""
    return sum((F.col(c) * float(w) for c, w in zip(features, coefficients)), F.lit(float(intercept)))


def fold_of(key: Column, folds: int) -> Column:
    """Shuffled fold number from the key alone: stable under any partitioning."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def held_out(key: Column, share: float = 0.3) -> Column:
    """Hold-out membership from the key alone."""
    return fold_of(key, 1000) < int(round(share * 1000))
