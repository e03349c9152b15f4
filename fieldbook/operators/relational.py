"""Small table operations: filters, recodes, unions, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """Raised with the names that a frame lacks."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns("missing columns: " + ", ".join(missing))
    return df


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def exclude(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Drop rows that hold one of the values; rows without a value stay."""
    return df.filter(F.coalesce(~F.col(column).isin(list(values)), F.lit(True)))


def recode(column: str, mapping: dict) -> Column:
    """Replace listed values, keep the others."""
    chain = F
    for old, new in mapping.items():
        chain = chain.when(F.col(column) == old, F.lit(new))
    return chain.otherwise(F.col(column))


def event_mask(event: str, year: str, name, season) -> Column:
    """True on the rows of one edition of an event, false elsewhere, never null."""
    return F.col(event).eqNullSafe(F.lit(name)) & F.col(year).eqNullSafe(F.lit(season))


def split_by(df: DataFrame, mask: Column) -> tuple[DataFrame, DataFrame]:
    """(rows outside the mask, rows inside it)."""
    inside = F.coalesce(mask, F.lit(False))
    return df.filter(~inside), df.filter(inside)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union with the columns of all frames; absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, non_nulls) of every column, in one scan."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return wide.unpivot(["_n"], [F.col(f"`{c}`") for c in df.columns], "column", "non_nulls").select(
        "column", (F.col("_n") - F.col("non_nulls")).alias("nulls"), "non_nulls"
    )


def lookup_region(df: DataFrame, on: Sequence[str], regions: DataFrame, value: str, default: str = "Unknown") -> DataFrame:
    """Left join to a small map table, with a default for keys that are not in it."""
    return df.join(regions.select(*on, value), list(on), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def with_group_value(df: DataFrame, group: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Give an aggregate of the group back to its rows.

    Aggregated before the join rather than windowed: partial sums leave each task, so a group with a
    third of all rows never gathers in one place. The join has one row per group on its right side;
    Spark broadcasts that when it measures small, and splits skewed left partitions otherwise.
    """
    return df.join(df.groupBy(*group).agg(*[v.alias(n) for n, v in values.items()]), list(group), "left")


def with_table_value(df: DataFrame, values: dict[str, Column], of: DataFrame | None = None) -> DataFrame:
    """Give one-row aggregates of a whole table (``of``, by default ``df``) to every row."""
    row = (df if of is None else of).agg(F.struct(*[v.alias(n) for n, v in values.items()]).alias("v")).scalar()
    return df.withColumns({n: row[n] for n in values})


def missed_position(df: DataFrame, event: Sequence[str], position: str, name: str, missed: float = -1.0) -> DataFrame:
    """Position with missed cuts placed one behind the worst finisher of the event."""
    missing = F.col(position) == missed
    worst = with_group_value(df, event, {"_worst": F.max(position)})
    return worst.withColumn(name, F.when(missing, F.col("_worst") + 1).otherwise(F.col(position))).drop("_worst")


def fill_missed(
    df: DataFrame, missed: Column, zero: Sequence[str], to_par: str, *, extra: float = 5.0, fallback: float = 10.0
) -> DataFrame:
    """Rows of missed cuts: zero for the given columns, the worst score to par plus ``extra`` (or ``fallback``)."""
    missed = F.coalesce(missed, F.lit(False))
    worst = df.agg(F.coalesce(F.max(F.when(~missed, F.col(to_par))) + extra, F.lit(fallback)).alias("w")).scalar()
    cells = {c: F.when(missed, F.lit(0.0)).otherwise(F.col(c)) for c in zero}
    return df.withColumns({**cells, to_par: F.when(missed, worst).otherwise(F.col(to_par))})


def previous_edition(
    df: DataFrame,
    entity: str,
    event: str,
    year: str,
    value: str,
    order: Sequence[str],
    name: str,
    *,
    missed: float | None = -1.0,
    default: float | None = 100.0,
    editions: DataFrame | None = None,
) -> DataFrame:
    """Value of the same entity in the same event one year earlier, its first row that year.

    ``editions`` are the rows to look in, by default ``df``; give them where ``df`` is costly to compute twice.
    """
    first = (
        (df if editions is None else editions).groupBy(entity, event, (F.col(year) + 1).alias(year))
        .agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"))
        .select(entity, event, year, F.col("_first.v").alias("_previous"))
    )
    found = df.join(first, [entity, event, year], "left")
    kept = F.when(F.col("_previous") == missed, F.lit(None)).otherwise(F.col("_previous")) if missed is not None else F.col("_previous")
    return found.withColumn(name, F.coalesce(kept, F.lit(default)) if default is not None else kept).drop("_previous")


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows in an explicit order."""
    return df.orderBy(*order).limit(k)


def best_row(df: DataFrame, score: str, key: str) -> DataFrame:
    """The single row with the highest score; ties go to the lowest key."""
    return top_rows(df, [F.col(score).desc_nulls_last(), F.col(key)], 1)


def first_values(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in an explicit order."""
    rest = [c for c in df.columns if c not in group]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*group).agg(first).select(*group, "_row.*")
