"""The tables behind the report pages: level snapshots, advice, comparisons, forecast heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.numeric import next_level
from fieldbook.functions.text import dnf_label, fixed_point
from fieldbook.operators.relational import numeric_columns, require_columns, with_table_value
from fieldbook.operators.stats import describe, key_correlation, strongest_drivers

IMPROVE = "**Improve %s:** strong negative correlation (%.2f) with {key}, which tends to fall where it rises."
REDUCE = "**Reduce %s:** strong positive correlation (%.2f) with {key}, which tends to fall where it falls."
NONE_FOUND = "No feature passes the threshold on these rows."
HEADING = "Between %s %s and %s %s, these features matter."


def _long(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    cells = [F.col(f"`{m}`").cast("double").alias(m) for m in metrics]
    return df.select(F.col(key), *cells).unpivot([key], [F.col(f"`{m}`") for m in metrics], "metric", "value")


def levels(df: DataFrame, key: str) -> DataFrame:
    """Distinct key values in order."""
    return df.select(key).distinct().orderBy(key)


def kpi_snapshot(df: DataFrame, key: str, level, metrics: Sequence[str]) -> DataFrame:
    """(metric, value) text of one level, of its least row by the metrics in order; ``N/A`` where a metric or the level is absent."""
    present = [m for m in metrics if m in df.columns]
    row = df.filter(F.col(key) == level).groupBy().agg(
        F.min(F.struct(*[F.col(f"`{m}`").cast("double").alias(f"_{i}") for i, m in enumerate(present)])).alias("r")
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.coalesce(fixed_point(F.col(f"r._{present.index(m)}")) if m in present else F.lit(None), F.lit("N/A")).alias("value"),
            )
            for m in metrics
        ]
    )
    return row.select(F.explode(cells).alias("c")).select("c.*")


def advice(df: DataFrame, key: str, threshold: float = 0.3, columns: Sequence[str] | None = None) -> DataFrame:
    """(place, feature, r, line): what to raise, strongest first, then what to lower; a fallback line if nothing passes."""
    r = F.col("r")
    strong = key_correlation(df, key, columns).filter(F.abs(r) > threshold)
    picked = strong.withColumn("side", F.when(r < 0, 0).otherwise(1))
    line = F.when(r < 0, F.format_string(IMPROVE.format(key=key), "feature", "r")).otherwise(
        F.format_string(REDUCE.format(key=key), "feature", "r")
    )
    # One row per feature: sorting them in an array is bounded by the number of columns.
    ordered = picked.select(F.struct("side", (-F.abs(r)).alias("weight"), "feature", "r", line.alias("line")).alias("a")).agg(
        F.array_sort(F.collect_list("a")).alias("all")
    )
    none = F.struct(
        F.lit(0).alias("side"),
        F.lit(0.0).alias("weight"),
        F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("double").alias("r"),
        F.lit(NONE_FOUND).alias("line"),
    )
    lines = F.when(F.size("all") > 0, F.col("all")).otherwise(F.array(none))
    return ordered.select(F.posexplode(lines).alias("place", "a")).select(
        "place", F.col("a.feature").alias("feature"), F.col("a.r").alias("r"), F.col("a.line").alias("line")
    )


def advice_heading(df: DataFrame, key: str, level, clamp: bool = True) -> DataFrame:
    """(level, target, line) for the level in focus."""
    here = df.select(F.lit(level).alias("level")).limit(1)
    target = next_level(F.col("level"), clamp)
    return here.select(
        "level",
        target.alias("target"),
        F.format_string(HEADING, F.lit(key), F.col("level").cast("string"), F.lit(key), target.cast("string")).alias("line"),
    )


def trend_series(df: DataFrame, key: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """(metric, strength, key, value): the points of every metric with the size of its correlation."""
    metrics = list(metrics or numeric_columns(df, [key]))
    strength = key_correlation(df, key, metrics).select(F.col("feature").alias("metric"), F.abs("r").alias("strength"))
    # One row per metric on the right; Spark broadcasts it on its own.
    return _long(df, key, metrics).join(strength, "metric", "left").select("metric", "strength", key, "value")


def compare_long(df: DataFrame, key: str, metrics: Sequence[str], levels: Sequence | None = None) -> DataFrame:
    """(key, metric, value) of the chosen levels; by default the lowest and the highest."""
    if levels is not None:
        chosen = df.filter(F.col(key).isin(list(levels)))
    else:
        ends = with_table_value(df, {"_low": F.min(key), "_high": F.max(key)})
        chosen = ends.filter(F.col(key).isin(F.col("_low"), F.col("_high")))
    return _long(chosen, key, metrics)


def compare_summary(df: DataFrame, key: str, levels: Sequence, metrics: Sequence[str] | None = None) -> DataFrame:
    return describe(df.filter(F.col(key).isin(list(levels))), metrics or numeric_columns(df, [key]))


def driver_points(df: DataFrame, key: str, metrics: Sequence[str] | None = None, threshold: float = 0.2, k: int = 5) -> DataFrame:
    """(driver, x, key): the points of the strongest drivers."""
    metrics = list(metrics or numeric_columns(df, [key]))
    drivers = strongest_drivers(key_correlation(df, key, metrics), threshold, k).select(F.col("feature").alias("metric"))
    points = _long(df, key, metrics).join(drivers, "metric", "left_semi")
    return points.select(F.col("metric").alias("driver"), F.col("value").alias("x"), key)


def forecast_head(df: DataFrame, event: str, entity: str, score: str, k: int = 10, descending: bool = True) -> DataFrame:
    """(event, entity, score) of the best ``k``."""
    require_columns(df, [event, entity, score])
    order = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    return df.select(event, entity, score).orderBy(order, entity).limit(k)


def forecast_kpis(df: DataFrame, entity: str, finishes: Sequence[str], averages: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """Display table: missed cuts as DNF, averages with two places, flags on the best and worst of each average."""
    require_columns(df, [entity, *finishes, *averages, *others])
    ends = {f"_{side}_{i}": f(c) for i, c in enumerate(averages) for side, f in (("low", F.min), ("high", F.max))}
    wide = with_table_value(df, ends)
    return wide.select(
        entity,
        *[dnf_label(F.col(c)).alias(c) for c in finishes],
        *[fixed_point(F.col(c)).alias(c) for c in averages],
        *[F.coalesce(F.col(c) == F.col(f"_high_{i}"), F.lit(False)).alias(f"{c}_is_max") for i, c in enumerate(averages)],
        *[F.coalesce(F.col(c) == F.col(f"_low_{i}"), F.lit(False)).alias(f"{c}_is_min") for i, c in enumerate(averages)],
        *others,
    )
