"""Profile statistics: correlations, summaries, box figures."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators.quantiles import exact_quantiles
from fieldbook.operators.relational import numeric_columns


def _column(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are given; null if either is constant there."""
    x_both, y_both = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x_both, y_both), F.stddev_pop(x_both) * F.stddev_pop(y_both))


def unpivot_wide(wide: DataFrame, names: Sequence[str], value: str, key: str = "feature") -> DataFrame:
    """A one-row aggregate with columns ``_0 .. _n`` as rows ``(key, value)``."""
    cells = F.array(*[F.struct(F.lit(n).alias(key), F.col(f"_{i}").alias(value)) for i, n in enumerate(names)])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def key_correlation(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, r): each numeric column against the key, one scan. No shared rows gives 0."""
    columns = list(columns or numeric_columns(df, [key]))
    k = _column(key)
    both = {c: F.count(F.when(k.isNotNull(), _column(c))) for c in columns}
    wide = df.agg(
        *[F.when(both[c] == 0, F.lit(0.0)).otherwise(pearson(_column(c), k)).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    return unpivot_wide(wide, columns, "r")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(m1, m2, r) for every ordered pair; each unordered pair is computed once, all in one scan."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2))
    wide = df.agg(
        *[pearson(_column(a), _column(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)],
        *[pearson(_column(c), _column(c)).alias(f"_{len(pairs) + i}") for i, c in enumerate(columns)],
    )

    def cell(a: str, b: str, i: int) -> Column:
        return F.struct(F.lit(a).alias("m1"), F.lit(b).alias("m2"), F.col(f"_{i}").alias("r"))

    cells = [cell(a, b, i) for i, (a, b) in enumerate(pairs)]
    cells += [cell(b, a, i) for i, (a, b) in enumerate(pairs)]
    cells += [cell(c, c, len(pairs) + i) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, sample std, min, exact quartiles, max."""
    columns = list(columns or numeric_columns(df))
    moments = df.agg(
        *[
            F.struct(
                F.count(_column(c)).alias("count"),
                F.avg(_column(c)).alias("mean"),
                F.stddev_samp(_column(c)).alias("std"),
                F.min(_column(c)).alias("min"),
                F.max(_column(c)).alias("max"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    moments = unpivot_wide(moments, columns, "s", key="metric").select("metric", "s.*")
    quartiles = (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        .groupBy("metric")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    )
    return moments.join(quartiles, "metric", "left").select("metric", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def box_stats(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Quartiles per group, with the furthest values inside 1.5 interquartile ranges."""
    by = list(by)
    quartiles = (
        exact_quantiles(df, [column], [0.25, 0.5, 0.75], by)
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    x = _column(column)
    within = F.when(x.between(F.col("q1") - reach, F.col("q3") + reach), x)
    return (
        df.join(quartiles, by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(F.min(within).alias("low_fence"), F.max(within).alias("high_fence"), F.count(x).alias("n"))
        .select(*by, "n", "q1", "median", "q3", "low_fence", "high_fence")
    )


def strongest_drivers(correlations: DataFrame, threshold: float = 0.2, k: int = 5) -> DataFrame:
    """Up to ``k`` features on each side whose correlation passes the threshold."""
    down = correlations.filter(F.col("r") < -threshold).orderBy("r", "feature").limit(k)
    up = correlations.filter(F.col("r") > threshold).orderBy(F.col("r").desc(), "feature").limit(k)
    return down.unionByName(up).distinct()


def by_strength(correlations: DataFrame) -> DataFrame:
    """Features ordered by the size of their correlation."""
    return correlations.orderBy(F.abs("r").desc_nulls_last(), "feature")


def cumulative_share(parts: DataFrame, part: str, order: str, name: str) -> DataFrame:
    """Running share of a total, on a table with one row per feature."""
    from fieldbook.operators.segments import running_totals

    total = parts.agg(F.sum(part).alias("t")).scalar()
    return running_totals(parts, [order], {name: F.col(part)}).withColumn(name, F.try_divide(F.col(name), total))
