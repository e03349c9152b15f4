"""Ordered groups cut into bounded segments.

A window partitioned by an entity puts all rows of that entity into one task. When one entity may
hold a third of the table, that task never ends. Here every large entity is cut along its order
into segments of limited size, and each segment is windowed on its own:

* frames of limited width see copies of the neighbouring rows (a halo) across the cut;
* running values are completed with what the earlier segments add up to (a carry).

Cut points come from rows sampled by hash before the plan is built, as Spark itself samples before
a range partitioning. The sample only decides where to cut, never what is computed, so results are
exact. If no entity is that large the plan is the plain window: one shuffle, nothing else. The table
of cut points is broadcast; it holds about ``sample_rows / stride`` entries at most whatever the size
of the input, because the sampling rate falls as the row count grows: beyond
``sample_rows / stride * segment_rows`` rows segments grow with the input, and a caller with such
tables gives a layout with a larger ``sample_rows``. An order over all rows needs no sample: its ranges are written
once, and their sums are the carries. Cuts are looked up in two steps, first the page
of ``PAGE`` cuts, then the cut in it, so no row carries more than a page.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from fieldbook.session import materialise

SEGMENT, CORE = "_segment", "_core"
#: Key of the rows without an entity, each on its own, where such rows are kept.
LONE = "_lone"
_CUTS, _KEY, _ALL, _HEADS, _PAGE = "_cuts", "_key", "_all", "_heads", "_page"
#: Cuts that are searched at once.
PAGE = 128
_HASH_RANGE = 1 << 40


@dataclass(frozen=True)
class Layout:
    """Expected rows per segment, sampled rows per segment, and the most rows ever sampled."""

    segment_rows: int = 2_000_000
    stride: int = 256
    sample_rows: int = 8_000_000


DEFAULT_LAYOUT = Layout()


@dataclass(frozen=True)
class Segmented:
    """Rows ready to be windowed by ``keys``; ``core`` is false on the halo copies. ``cuts`` has a row per divided entity."""

    rows: DataFrame
    cuts: DataFrame | None
    entity: list[str]
    order: list[str]
    lone: bool = False

    @property
    def keys(self) -> list[str]:
        return [*self.entity, *([LONE] if self.lone else []), *([] if self.cuts is None else [SEGMENT])]

    @property
    def core(self) -> Column:
        return F.lit(True) if self.cuts is None else F.col(CORE)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def divided(self) -> DataFrame:
        """Core rows of the entities that were cut."""
        return self.rows.filter(self.core).join(F.broadcast(self.cuts.select(*self.entity)), self.entity, "left_semi")


def _cut_points(
    df: DataFrame, entity: list[str], order: list[str], before: int, after: int, layout: Layout
) -> list[Row]:
    """One row per entity that is too large, with its sorted cuts."""
    total = df.count()
    if total < 2 * layout.segment_rows:
        return []
    rate = min(layout.stride / layout.segment_rows, layout.sample_rows / total)
    picked = F.pmod(F.xxhash64(*entity, *order), F.lit(_HASH_RANGE)) < int(rate * _HASH_RANGE)
    # Equal keys share one hash, so copies of a row count once and cannot flood the sample.
    sample = df.filter(picked).select(*entity, *order).distinct().withColumn(_KEY, F.struct(*order))
    along = Window.partitionBy(*entity).orderBy(_KEY)
    place, size = F.col("_place"), F.col("_size")
    placed = sample.select(
        *entity,
        F.col(_KEY).alias("cut"),
        (F.lag(_KEY, before).over(along) if before else F.col(_KEY)).alias("halo_from"),
        (F.lead(_KEY, after).over(along) if after else F.col(_KEY)).alias("halo_to"),
        F.row_number().over(along).alias("_place"),
        F.count(F.lit(1)).over(Window.partitionBy(*entity)).alias("_size"),
    ).filter((place % layout.stride == 0) & (place + layout.stride <= size))
    cuts = placed.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct("cut", "halo_from", "halo_to"))).alias(_CUTS))
    return cuts.collect()  # sample_rows / stride entries at most


def _paged(df: DataFrame, entity: list[str], order: list[str], found: list[Row]) -> tuple[DataFrame, DataFrame, int]:
    """Per entity the first cut of each page; per page its cuts and the next page's first; the most pages of any entity."""
    key = StructType([df.schema[c] for c in order])
    cut = StructType([StructField(n, key) for n in ("cut", "halo_from", "halo_to")])
    own = [df.schema[c] for c in entity]
    heads = [(*(row[c] for c in entity), [c["cut"] for c in row[_CUTS][::PAGE]]) for row in found]
    pages = [
        (*(row[c] for c in entity), start // PAGE, row[_CUTS][start : start + PAGE + 1])
        for row in found
        for start in range(0, len(row[_CUTS]), PAGE)
    ]
    spark = df.sparkSession
    return (
        spark.createDataFrame(heads, StructType([*own, StructField(_HEADS, ArrayType(key))])),
        spark.createDataFrame(pages, StructType([*own, StructField(_PAGE, IntegerType()), StructField(_CUTS, ArrayType(cut))])),
        max(len(h[-1]) for h in heads),
    )


def _at_or_before(values: Column, most: int, key: Column, part: str | None = None) -> Column:
    """Number of values at or before ``key``: a binary search over a sorted array of at most ``most`` values."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length()))])

    def climb(place: Column, step: Column) -> Column:
        ahead = place + step
        value = F.get(values, ahead - 1)
        return F.when((ahead <= F.size(values)) & ((value[part] if part else value) <= key), ahead).otherwise(place)

    return F.when(values.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), climb))


def has_entity(entity: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in entity], F.lit(True))


def segment(
    df: DataFrame,
    entity: list[str],
    order: list[str],
    *,
    before: int = 0,
    after: int = 0,
    layout: Layout = DEFAULT_LAYOUT,
    keep_null: bool = False,
    sampled: DataFrame | None = None,
) -> Segmented:
    """Cut ordered groups; ``before`` / ``after`` rows of context are copied across each cut.

    Rows without an entity are left out, or with ``keep_null`` kept, spread by a hash of their order so that
    they are no group. ``order`` should end in a unique column: rows with equal order values have no defined
    sequence, with or without cuts. ``sampled`` has the same rows with fewer columns, for the jobs that look for cuts.
    """
    if max(before, after) >= layout.stride:
        raise ValueError(f"frame of {max(before, after)} rows needs a stride above it, got {layout.stride}")
    keep_null = keep_null and bool(entity)
    seen = df if sampled is None else sampled
    if keep_null:
        df = df.withColumn(LONE, F.when(~has_entity(entity), F.xxhash64(*order)))
    elif entity:
        df = df.filter(has_entity(entity))
    else:
        entity, df, seen = [_ALL], df.withColumn(_ALL, F.lit(0)), seen.withColumn(_ALL, F.lit(0))
    found = _cut_points(seen.filter(has_entity(entity)), entity, order, before, after, layout)
    if not found:
        return Segmented(df, None, entity, order, keep_null)
    heads, pages, most = _paged(df, entity, order, found)
    page = F.greatest(_at_or_before(F.col(_HEADS), most, F.col(_KEY)) - 1, F.lit(0))
    rows = df.withColumn(_KEY, F.struct(*order)).join(F.broadcast(heads), entity, "left").withColumn(_PAGE, page).drop(_HEADS)
    rows = rows.join(F.broadcast(pages), [*entity, _PAGE], "left")
    rows = rows.withColumn("_local", _at_or_before(F.col(_CUTS), PAGE + 1, F.col(_KEY), "cut")).withColumn(SEGMENT, F.col(_PAGE) * PAGE + F.col("_local"))
    number, key = F.col(SEGMENT), F.col(_KEY)

    def copy_to(segment_number: Column, core: bool) -> Column:
        return F.struct(segment_number.alias(SEGMENT), F.lit(core).alias(CORE))

    following = F.get(F.col(_CUTS), F.col("_local"))["halo_from"]
    own = F.get(F.col(_CUTS), F.col("_local") - 1)["halo_to"]
    copies = [copy_to(number, True)]
    if before:
        copies.append(F.when(key >= following, copy_to(number + 1, False)))
    if after:
        copies.append(F.when((number > 0) & (key < own), copy_to(number - 1, False)))
    spread = F.when(F.col(_CUTS).isNull(), F.array(copies[0])).otherwise(F.array_compact(F.array(*copies)))
    rows = rows.withColumn("_spread", F.explode(spread)).withColumns(
        {SEGMENT: F.col("_spread")[SEGMENT], CORE: F.col("_spread")[CORE]}
    )
    return Segmented(rows.drop(_CUTS, _KEY, _PAGE, "_local", "_spread"), heads, entity, order, keep_null)


def _ranged_totals(df: DataFrame, order: list[str], totals: dict[str, Column], layout: Layout) -> DataFrame:
    """Running totals over all rows: ranges of the order are written once, and each starts from the sums of those before it.

    Ranges are Spark's own, as many as a shuffle has partitions, or more if these were to hold more rows than a segment.
    Rows of equal order are spread by a hash of the whole row.
    """
    spark = df.sparkSession
    base = materialise(df)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), base.count() // layout.segment_rows)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    along = [F.col(c).asc_nulls_first() for c in order]
    placed = materialise(base.withColumn("_tie", tie).repartitionByRange(ranges, *along, "_tie").withColumn(SEGMENT, F.spark_partition_id()))
    window = Window.partitionBy(SEGMENT).orderBy(*along, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each range, in number of the shuffle's partitions
    earlier = Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(SEGMENT).agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()])
    carry = sums.select(SEGMENT, *[F.sum(f"_sum_{name}").over(earlier).alias(f"_carry_{name}") for name in totals])
    rows = placed.withColumns({name: F.sum(value).over(window) for name, value in totals.items()}).join(F.broadcast(carry), SEGMENT)
    return rows.select(*df.columns, *[(F.col(name) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0))).alias(name) for name in totals])


def running_totals(
    df: DataFrame,
    order: list[str],
    totals: dict[str, Column],
    *,
    group: list[str] = (),
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Add sums from the first row of the group up to and including the current row; rows without a group stay, with null sums."""
    if not group:
        return _ranged_totals(df, order, totals, layout)
    cut = segment(df, list(group), order, layout=layout, keep_null=True)
    upto = cut.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cut.rows.withColumns({name: F.sum(value).over(upto) for name, value in totals.items()})
    if cut.cuts is not None:
        earlier = Window.partitionBy(*cut.entity).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        # One row per segment of a divided group: as few as there are cuts.
        carry = (
            cut.divided()
            .groupBy(*cut.keys)
            .agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()])
            .select(*cut.keys, *[F.sum(f"_sum_{name}").over(earlier).alias(f"_carry_{name}") for name in totals])
        )
        rows = rows.join(F.broadcast(carry.drop(LONE)), [*cut.entity, SEGMENT], "left").withColumns(
            {name: F.col(name) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0)) for name in totals}
        )
    return rows.select(*df.columns, *[F.when(has_entity(cut.entity), F.col(name)).alias(name) for name in totals])


def row_numbers(df: DataFrame, order: list[str], name: str, *, group: list[str] = (), layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Consecutive numbers from 1 along ``order``, over the whole frame or per group."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, group=list(group), layout=layout)
