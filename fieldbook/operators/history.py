"""History features: what an entity did before (or around) each of its rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldbook.operators.segments import DEFAULT_LAYOUT, LONE, SEGMENT, Layout, Segmented, has_entity, segment

# Row frames by name, for a width of w rows.
FRAMES: dict[str, Callable[[int], tuple[int, int]]] = {
    "incl": lambda w: (-(w - 1), 0),
    "excl": lambda w: (-w, -1),
    "lookahead": lambda w: (0, w - 1),
}


@dataclass(frozen=True)
class Framed:
    """A window expression that looks at most ``before`` rows back and ``after`` rows ahead."""

    name: str
    build: Callable[[WindowSpec], Column]
    before: int = 0
    after: int = 0


@dataclass(frozen=True)
class Streak:
    """Rows since the last one where ``broken`` held, not counting the current row."""

    name: str
    broken: Column


@dataclass(frozen=True)
class ClosingTrend:
    """Slope over the last five rows of the entity, given to all of its rows."""

    name: str
    value: str


Feature = Framed | Streak | ClosingTrend


def previous(name: str, column: str, back: int = 1) -> Framed:
    return Framed(name, lambda w: F.lag(column, back).over(w), before=back)


def days_since_previous(name: str, date: str) -> Framed:
    return Framed(name, lambda w: F.datediff(F.col(date), F.lag(date).over(w)), before=1)


def over_rows(name: str, aggregate: Column, start: int, end: int) -> Framed:
    """An aggregate over the rows ``start`` .. ``end`` relative to the current one."""
    return Framed(name, lambda w: aggregate.over(w.rowsBetween(start, end)), before=max(0, -start), after=max(0, end))


def rolling_mean(name: str, column: str | Column, width: int, frame: str = "incl") -> Framed:
    return over_rows(name, F.avg(column), *FRAMES[frame](width))


def rolling_std(name: str, column: str | Column, width: int, frame: str = "incl") -> Framed:
    """Sample deviation; null while fewer than two values are in the frame."""
    return over_rows(name, F.stddev_samp(column), *FRAMES[frame](width))


def rolling_sum(name: str, column: str | Column, width: int, frame: str = "incl") -> Framed:
    return over_rows(name, F.sum(column), *FRAMES[frame](width))


def rolling_ratio(name: str, condition: Column, width: int, frame: str = "incl") -> Framed:
    """Share of rows in the frame that meet a condition; an unknown condition counts as not met."""
    return rolling_mean(name, F.coalesce(condition, F.lit(False)).cast("double"), width, frame)


def trend_so_far(name: str, value: str) -> Framed:
    """Least-squares slope over the five rows ending at the current one."""

    def build(w: WindowSpec) -> Column:
        y = [F.col(value), *[F.lag(value, k).over(w) for k in range(1, 5)]]
        # Slope of five equally spaced points; null unless all five are there.
        return (2 * y[0] + y[1] + 0 * y[2] - y[3] - 2 * y[4]) / 10.0

    return Framed(name, build, before=4)


def _slope_of_last_five(value: Column, age: Column) -> Column:
    """Slope as an aggregate; ``age`` is 1 on the newest row. Null unless five values are there."""
    recent = F.when(age <= 5, value)
    return F.when(F.count(recent) == 5, F.sum(recent * (3 - age)) / 10.0)


def _streaks(rows: DataFrame, cut: Segmented, streaks: Sequence[Streak]) -> DataFrame:
    """Local streaks within each segment: ``_at_k`` rows so far, ``_open_k`` when no break came yet."""
    upto = cut.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = cut.window.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.sum(cut.core.cast("int")).over(upto))
    for i, s in enumerate(streaks):
        broken = cut.core & F.coalesce(s.broken, F.lit(False))
        rows = rows.withColumn(f"_broken_{i}", broken).withColumn(
            f"_break_{i}", F.max(F.when(broken, F.col("_at"))).over(earlier)
        )
    return rows


def _streak_carry(cut: Segmented, streaks: Sequence[Streak]) -> DataFrame:
    """Per segment of a divided entity: the streak its first row continues."""
    local = _streaks(cut.divided(), cut, streaks)
    totals = local.groupBy(*cut.keys).agg(
        F.max("_at").alias("_rows"),
        *[F.max(F.when(F.col(f"_broken_{i}"), F.col("_at"))).alias(f"_last_{i}") for i in range(len(streaks))],
    )
    along = Window.partitionBy(*cut.entity).orderBy(SEGMENT)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_end", F.sum("_rows").over(upto))
    before = F.coalesce(F.lag("_end").over(along), F.lit(0))
    carries = [
        (before - F.coalesce(F.max(F.col("_end") - F.col("_rows") + F.col(f"_last_{i}")).over(earlier), F.lit(0))).alias(
            f"_carry_{i}"
        )
        for i in range(len(streaks))
    ]
    return totals.select(*cut.keys, *carries)


def _closing_trends(cut: Segmented, trends: Sequence[ClosingTrend]) -> DataFrame:
    """Trends of the divided entities, from their five newest rows only."""
    newest = Window.partitionBy(*cut.entity).orderBy(*[F.col(c).desc() for c in cut.order])
    last = cut.divided().withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= 5)
    return last.groupBy(*cut.entity).agg(
        *[_slope_of_last_five(F.col(t.value), F.col("_age")).alias(f"_hot_{t.name}") for t in trends]
    )


def add_history(
    df: DataFrame,
    entity: list[str],
    order: list[str],
    features: Sequence[Feature],
    *,
    layout: Layout = DEFAULT_LAYOUT,
    keep_null: bool = False,
    sampled: DataFrame | None = None,
) -> DataFrame:
    """Add all ``features`` in one pass: one shuffle by entity, one sort, shared by every frame.

    Rows without an entity are left out; with ``keep_null`` they stay, with null features. ``sampled`` has the same
    rows with fewer columns, for the jobs that look for cuts.
    """
    framed = [f for f in features if isinstance(f, Framed)]
    streaks = [f for f in features if isinstance(f, Streak)]
    trends = [f for f in features if isinstance(f, ClosingTrend)]
    cut = segment(
        df,
        entity,
        order,
        before=max([f.before for f in framed], default=0),
        after=max([f.after for f in framed], default=0),
        layout=layout,
        keep_null=keep_null,
        sampled=sampled,
    )
    rows = cut.rows.withColumns({f.name: f.build(cut.window) for f in framed}) if framed else cut.rows
    if streaks or trends:
        rows = _streaks(rows, cut, streaks)
    if trends:
        rows = rows.withColumn("_age", F.sum(cut.core.cast("int")).over(cut.whole) - F.col("_at") + 1)
        for t in trends:
            recent = F.when(cut.core & (F.col("_age") <= 5), F.col(t.value))
            slope = F.sum(recent * (3 - F.col("_age"))).over(cut.whole) / 10.0
            rows = rows.withColumn(t.name, F.when(F.count(recent).over(cut.whole) == 5, slope))
    rows = rows.filter(cut.core)
    if streaks:
        carried: dict[int, Column] = {}
        if cut.cuts is not None:
            rows = rows.join(F.broadcast(_streak_carry(cut, streaks).drop(LONE)), [*cut.entity, SEGMENT], "left")
            carried = {i: F.coalesce(F.col(f"_carry_{i}"), F.lit(0)) for i in range(len(streaks))}
        rows = rows.withColumns(
            {
                s.name: F.col("_at") - 1 - F.coalesce(F.col(f"_break_{i}"), -carried.get(i, F.lit(0)))
                for i, s in enumerate(streaks)
            }
        )
    if trends and cut.cuts is not None:
        hot = _closing_trends(cut, trends).withColumn("_divided", F.lit(True))
        rows = rows.join(F.broadcast(hot), cut.entity, "left").withColumns(
            {t.name: F.when(F.col("_divided"), F.col(f"_hot_{t.name}")).otherwise(F.col(t.name)) for t in trends}
        )
    known = has_entity(cut.entity)
    return rows.select(*df.columns, *[F.when(known, F.col(f.name)).alias(f.name) if cut.lone else F.col(f.name) for f in features])
