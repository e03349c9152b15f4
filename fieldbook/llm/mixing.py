"""Mixing sources to target weights by hash-threshold histograms.

Every source has a budget of words. What the budget holds of whole passes over the source is repeated; the rest is
taken by a threshold on a hash of the document's id, and the document at the threshold gives the words that still miss,
so that the words taken are the target but for rounding. The threshold is found without sorting: sizes are summed by source
and the leading bits of the hash, the bucket in which the budget is reached is the boundary, and only the boundary
bucket of each source is summed again by its next bits. The thresholds of smaller budgets lie below those of larger
ones, so that a mix of less is part of a mix of more.

A null or empty text has size 0 and takes 0; a null source is a source of its own, the last; a null doc_id is hashed as
an id of its own. Rows that share the id at the threshold are told apart in the same way by a hash of their texts, and equal
rows by their place in a written table, so that a source meets its target however many rows have one id; reruns take the same
rows. An empty table gives no rows. Extra columns, of whatever name, stay where documents are returned, but for the four
that the mix adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.llm.storage import documents_only, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Sources are a small dimension that is planned on the driver; more are refused, never cut.
MOST_SOURCES = 1_000_000
#: Bits of the hash that are used, and bits of a level of histograms.
HASH_BITS, LEVEL_BITS = 48, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(doc_id: Column) -> Column:
    """A number below 2**HASH_BITS that depends on the id only."""
    hashed = F.md5(F.concat(F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substr(hashed, F.lit(1), F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def plan_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """Target of each source: its share by weight of all sizes, at most ``most`` times its own size, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left = dict(order), float(sum(n for _, n in order))
    open_, target = [s for s, _ in order], {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > most * size[s]]
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = most * size[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """Threshold of each ``source``: the sizes of places below it fit its ``budget``, ``part`` of those at it are needed.

    ``sizes`` has source, place and size; sources are compared null-safe. Each round sums the open bucket of a source.
    """
    state = budgets.select("source", F.lit(0).cast("long").alias("low"), F.col("budget").cast("double").alias("need"))
    done = None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        s = F.broadcast(state.withColumnRenamed("source", "of"))
        inside = sizes.join(s, sizes["source"].eqNullSafe(F.col("of")) & (F.shiftright("place", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS)))
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("low").alias("low"), F.first("need").alias("need"))
        w = W.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(w.rowsBetween(W.unboundedPreceding, 0)))
        edge = sums.where("upto > need").groupBy("source").agg(F.min_by(F.struct("bucket", "words", "upto", "need"), "bucket").alias("e"))
        found = written(edge.select("source", F.shiftleft("e.bucket", shift).alias("low"), (F.col("e.need") - F.col("e.upto") + F.col("e.words")).alias("need"), F.col("e.words").alias("words")), "mix-edge")
        # a source whose open bucket holds no more than is needed takes all of it
        full = state.alias("s").join(found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left_anti")
        full = full.select("source", (F.shiftright("low", shift + LEVEL_BITS) + 1).alias("upper")).select("source", F.shiftleft("upper", shift + LEVEL_BITS).alias("threshold"), F.lit(0.0).alias("part"))
        done = full if done is None else done.unionByName(full)
        state = found
    last = state.select("source", F.col("low").alias("threshold"), (F.col("need") / F.col("words")).alias("part"))
    return done.unionByName(last)


def text_place(text: Column) -> Column:
    """A number below 2**HASH_BITS that depends on the text only."""
    return F.conv(F.substr(F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(1), F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def plan_of(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """A row for each source: ``of`` (the source), source_size, target, passes, threshold, part. ``sizes`` is a written table."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    listed = [(r["source"], r["size"]) for r in sources.limit(MOST_SOURCES + 1).collect()]
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    target = plan_targets(listed, weights, most)
    rows = []
    for source, size in listed:
        passes = min(int(most), int(target[source] // size)) if size else 0
        rows.append((source, size, float(target[source]), passes, float(target[source] - passes * size)))
    plan = sizes.sparkSession.createDataFrame(rows, "source string, source_size long, target double, passes int, budget double")
    cut = thresholds(sizes.where("size > 0"), plan.select("source", "budget"))
    plan = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    return written(plan.select(F.col("p.source").alias("of"), "source_size", "target", "passes", F.coalesce("c.threshold", F.lit(0)).alias("threshold"), F.coalesce("c.part", F.lit(0.0)).alias("part")), "mix-plan")


def _more_at_edge(edge: DataFrame, name: str, keys: Sequence[Column]) -> DataFrame:
    """Adds ``more`` to the struct ``name``: the words taken of rows that share the place at their source's threshold.

    Each key decides as the places did; the rows at its threshold go on to the next one.
    """
    field = lambda c: F.col(f"{name}.{c}")
    source, size = field("source"), field("size")
    rows = edge.select(source.alias("source"), size.alias("size"), field("part").alias("part"))
    budgets = rows.groupBy("source").agg((F.sum("size") * F.max("part")).alias("budget"))
    left, done = edge, None
    for key in keys:
        ties = left.groupBy(source.alias("source")).agg(F.count_if(size > 0).alias("n"))
        if (ties.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        sizes = left.select(source.alias("source"), key.alias("place"), size.alias("size")).where("size > 0")
        cut = written(thresholds(sizes, budgets).withColumnRenamed("source", "of"), "mix-ties")
        cut = F.broadcast(cut.select(F.struct("of", "threshold", "part").alias(f"{name}cut")))  # MOST_SOURCES rows at most
        placed = left.join(cut, source.eqNullSafe(F.col(f"{name}cut.of")))
        at = key == F.col(f"{name}cut.threshold")
        sure = placed.where(~at).withColumn(name, F.col(name).withField("more", F.when(key < F.col(f"{name}cut.threshold"), size).otherwise(0))).drop(f"{name}cut")
        done = sure if done is None else done.unionByName(sure)
        left = written(placed.where(at).withColumn(name, F.col(name).withField("part", F.col(f"{name}cut.part"))).drop(f"{name}cut"), "mix-left")
        budgets = left.groupBy(source.alias("source")).agg((F.sum(size) * F.max(field("part"))).alias("budget"))
    last = left.withColumn(name, F.col(name).withField("more", F.round(size * field("part")).cast("long")))
    return last if done is None else done.unionByName(last)


def _mixed(rows: DataFrame, name: str, weights: Sequence[float], most: float) -> DataFrame:
    """The rows, their struct ``name`` (source, size, place, text) with source_size, target and taken."""
    field = lambda c: F.col(f"{name}.{c}")
    sizes = written(rows.select(field("source").alias("source"), field("size").alias("size"), field("place").alias("place")), "mix-sizes")
    plan = plan_of(sizes, weights, most).select(F.struct("of", "source_size", "target", "passes", "threshold", "part").alias(f"{name}plan"))
    joined = rows.join(F.broadcast(plan), field("source").eqNullSafe(F.col(f"{name}plan.of")))  # MOST_SOURCES rows at most
    for c in ("source_size", "target", "passes", "threshold", "part"):
        joined = joined.withColumn(name, F.col(name).withField(c, F.col(f"{name}plan.{c}")))
    joined = joined.drop(f"{name}plan")
    at = field("place") == field("threshold")
    sure = joined.where(~at).withColumn(name, F.col(name).withField("more", F.when(field("place") < field("threshold"), field("size")).otherwise(0)))
    edge = written(joined.where(at).withColumn(name, F.col(name).withField("row", F.monotonically_increasing_id())), "mix-edge")
    row_place = F.shiftrightunsigned(F.xxhash64(field("row")), 64 - HASH_BITS)
    edge = _more_at_edge(edge, name, [field("text"), row_place])
    edge = edge.withColumn(name, F.col(name).dropFields("row"))
    taken = F.least(field("size") * field("passes") + field("more"), field("size") * int(most))
    return sure.unionByName(edge).withColumn(name, F.col(name).withField("taken", taken))


def _numbers(text: Column, doc_id: Column, source: Column) -> Column:
    return F.struct(source.alias("source"), word_count(text).alias("size"), place_of(doc_id).alias("place"), text_place(text).alias("text"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    given = documents_only(docs, "doc_id", "text", "source")
    rows = written(given.select("doc_id", _numbers(F.col("text"), F.col("doc_id"), F.col("source")).alias("_mix")), "mix-rows")
    return _mixed(rows, "_mix", weights, most).select("doc_id", *(f"_mix.{c}" for c in ("source", "size", "source_size", "target", "taken")))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """The documents that the mix takes, with their columns and size, source_size, target, taken.

    Rows with null or empty texts are never taken; equal rows are taken as often as their target needs; an empty table gives
    no rows; columns of other names than the four are kept as they are.
    """
    name = "_mix"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    added = ["size", "source_size", "target", "taken"]
    given = [F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string") for c in ("text", "doc_id", "source")]
    mixed = _mixed(docs.withColumn(name, _numbers(*given)), name, weights, most)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return mixed.where(F.col(f"{name}.taken") > 0).select(*kept, *(F.col(f"{name}.{c}").alias(c) for c in added))
