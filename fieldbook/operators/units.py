"""Columns that hold one quantity in two units: found by a gap in the sizes of their values, and put into one unit.

Values of one quantity lie within some decades; if a part of them was written in another unit, they form two
clusters a power of ten apart, with nothing between. Sizes are counted in steps of a tenth of a decade (some six
thousand counts a column at most, whatever the number of rows); the widest empty stretch splits them, and the
clusters are a unit apart if the ratio of their means is near a power of ten.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 10  # counts a decade


@dataclass(frozen=True)
class UnitBreak:
    """Where a column falls apart, the factor between its units, and the rows on either side."""

    column: str
    border: float
    factor: float
    low_rows: int
    high_rows: int

    @property
    def rescaled_low(self) -> bool:
        """Whether the small values are the ones to rescale: the unit of fewer rows gives way, of equally many the smaller."""
        return self.low_rows <= self.high_rows


def unit_breaks(df: DataFrame, columns: Sequence[str], least_gap: float = 1.0, near: float = 0.35) -> list[UnitBreak]:
    """The columns with two units; ``least_gap`` is in decades, ``near`` how far the means may be from a power of ten.

    Nulls, zeros and signs do not count. A column without values, or with a gap that no unit explains, is left out.
    """
    sizes = df.select(*[F.abs(F.col(f"`{c}`").cast("double")).alias(c) for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns], "metric", "v")
    sizes = sizes.filter((F.col("v") > 0) & (F.col("v") < float("inf"))).withColumn("digits", F.log10("v"))
    counted = sizes.groupBy("metric", F.floor(F.col("digits") * STEPS).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.min("digits").alias("low"), F.max("digits").alias("high"), F.sum("digits").alias("sum")
    )
    by_column: dict[str, list] = {}
    for row in counted.orderBy("metric", "step").collect():  # some 6000 counts a column at most
        by_column.setdefault(row["metric"], []).append(row)
    found = []
    for column in columns:
        steps = by_column.get(column, [])
        gaps = [(b["low"] - a["high"], i + 1) for i, (a, b) in enumerate(zip(steps, steps[1:]))]
        if not gaps or max(gaps)[0] < least_gap:
            continue
        _, at = max(gaps)
        (few, low), (many, high) = ((sum(s["n"] for s in part), sum(s["sum"] for s in part)) for part in (steps[:at], steps[at:]))
        apart = high / many - low / few
        if abs(apart - round(apart)) <= near:
            found.append(UnitBreak(column, 10 ** ((steps[at - 1]["high"] + steps[at]["low"]) / 2), 10.0 ** round(apart), few, many))
    return found


def repair_units(df: DataFrame, columns: Sequence[str], breaks: Sequence[UnitBreak] | None = None) -> DataFrame:
    """The rows with each column in one unit, and ``<column>_rescaled``, whether a row's value was put into it."""
    broken = {b.column: b for b in (unit_breaks(df, columns) if breaks is None else breaks)}
    cells = {}
    for c in columns:
        value, b = F.col(f"`{c}`").cast("double"), broken.get(c)
        if b is None:
            cells[f"{c}_rescaled"] = F.lit(False)
            continue
        moved = (F.abs(value) < b.border if b.rescaled_low else F.abs(value) > b.border) & (value != 0)
        cells[f"{c}_rescaled"] = F.coalesce(moved, F.lit(False))
        cells[c] = F.when(moved, value * b.factor if b.rescaled_low else value / b.factor).otherwise(value)
    return df.withColumns(cells)
