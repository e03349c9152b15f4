import random
from datetime import date, timedelta
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import history as h
from fieldbook.operators import segments
from fieldbook.operators.segments import DEFAULT_LAYOUT, Layout, row_numbers, running_totals, segment

TINY = Layout(segment_rows=40, stride=25, sample_rows=100_000)  # cuts every 25 rows or so
SCHEMA = "p string, d date, k int, y double"


def panel():
    rng = random.Random(7)
    # One entity holds more than a third of all rows; others have 1, 2, 4, 5 and 30; two rows share a date.
    sizes = {"hot": 400, "a": 1, "b": 2, "c": 4, "e": 5, "f": 30, **{f"n{i}": 20 for i in range(25)}}
    rows, k = [], 0
    for p, n in sizes.items():
        for i in range(n):
            y = rng.choice([-1.0, -1.0, 1.0, 2.0, 15.0]) if p != "f" else -1.0
            rows.append((p, date(2020, 1, 1) + timedelta(days=i // 2), k, None if rng.random() < 0.03 and p == "hot" else y))
            k += 1
    return [*rows, (None, date(2020, 1, 1), k, 1.0)]


def features():
    return [
        h.previous("last", "y"),
        h.previous("last3", "y", 3),
        h.days_since_previous("days", "d"),
        h.rolling_mean("mean5", "y", 5),
        h.rolling_std("std5", "y", 5, "excl"),
        h.rolling_mean("ahead", "y", 3, "lookahead"),
        h.rolling_ratio("wins", F.col("y") == 1, 20, "excl"),
        h.Streak("streak", F.col("y") == -1),
        h.Streak("unbroken", F.col("y") == -9),
        h.ClosingTrend("closing", "y"),
        h.trend_so_far("sofar", "y"),
    ]


def slope(ys):
    if len(ys) < 5 or any(y is None for y in ys):
        return None
    return sum((x - 2) * y for x, y in enumerate(ys)) / 10


def by_hand(rows):
    groups, out = {}, {}
    for r in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    for g in groups.values():
        ys = [r[3] for r in g]

        def some(values):
            return [v for v in values if v is not None]

        for i, r in enumerate(g):
            streak = 0
            for y in reversed(ys[:i]):
                if y == -1:
                    break
                streak += 1
            incl, excl, ahead = some(ys[max(0, i - 4) : i + 1]), some(ys[max(0, i - 5) : i]), some(ys[i : i + 3])
            before = ys[max(0, i - 20) : i]
            out[r[2]] = (
                ys[i - 1] if i else None,
                ys[i - 3] if i > 2 else None,
                (r[1] - g[i - 1][1]).days if i else None,
                mean(incl) if incl else None,
                stdev(excl) if len(excl) > 1 else None,
                mean(ahead) if ahead else None,
                sum(y == 1 for y in before) / len(before) if before else None,
                streak,
                i,
                slope(ys[-5:]),
                slope(ys[i - 4 : i + 1]) if i > 3 else None,
            )
    return out


@pytest.mark.parametrize("layout", [DEFAULT_LAYOUT, TINY, Layout(10, 21, 100)], ids=["whole", "cut", "sampled"])
@pytest.mark.parametrize("partitions", [1, 16])
def test_features_equal_a_plain_loop(spark, layout, partitions):
    rows = panel()
    want = by_hand(rows)
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = {r["k"]: tuple(r)[4:] for r in h.add_history(df, ["p"], ["d", "k"], features(), layout=layout).collect()}
    assert got.keys() == want.keys()
    for k, expected in want.items():
        assert got[k] == pytest.approx(expected, abs=1e-9, nan_ok=True), k


def test_large_entities_are_cut_and_small_ones_are_not(spark):
    df = spark.createDataFrame(panel(), SCHEMA)
    cut = segment(df, ["p"], ["d", "k"], before=5, after=3, layout=TINY)
    sizes = {(r["p"], r["_segment"]): r["n"] for r in cut.rows.groupBy("p", "_segment").agg(F.count("*").alias("n")).collect()}
    assert max(s for p, s in sizes if p == "hot") >= 8
    assert all(s == 0 for p, s in sizes if p != "hot")
    assert max(sizes.values()) < 100
    assert cut.rows.filter("_core").count() == df.filter("p is not null").count()


def test_no_cuts_leave_a_single_exchange(spark):
    df = spark.createDataFrame(panel(), SCHEMA)
    plan = h.add_history(df, ["p"], ["d", "k"], features())._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_frames_wider_than_a_segment_are_refused(spark):
    df = spark.createDataFrame(panel(), SCHEMA)
    with pytest.raises(ValueError, match="stride"):
        h.add_history(df, ["p"], ["d", "k"], [h.rolling_mean("m", "y", 30)], layout=TINY)


@pytest.mark.parametrize("layout", [DEFAULT_LAYOUT, TINY])
def test_running_totals_over_all_rows(spark, layout):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(1000)], "k int, v double").repartition(7)
    got = running_totals(df, ["k"], {"s": F.col("v")}, layout=layout).orderBy("k").collect()
    total = 0.0
    for r in got:
        total += r["v"]
        assert r["s"] == total
    numbers = row_numbers(df, ["k"], "n", layout=layout).filter("n <> k + 1")
    assert numbers.isEmpty()


def test_copies_of_one_key_do_not_flood_the_sample(spark):
    df = spark.range(3000).select(F.lit("x").alias("p"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), F.lit(1).alias("v"))
    got = running_totals(df, ["k"], {"s": F.col("v")}, group=["p"], layout=TINY)
    assert got.agg(F.max("s")).first()[0] == 3000
    assert got.select("s").distinct().count() == 3000


@pytest.mark.parametrize("page", [1, 3])
def test_cuts_on_many_pages(spark, monkeypatch, page):
    monkeypatch.setattr(segments, "PAGE", page)
    rows = panel()
    df, want = spark.createDataFrame(rows, SCHEMA).repartition(3), by_hand(rows)
    got = {r["k"]: tuple(r)[4:] for r in h.add_history(df, ["p"], ["d", "k"], features(), layout=TINY).collect()}
    assert got.keys() == want.keys()
    for k, expected in want.items():
        assert got[k] == pytest.approx(expected, abs=1e-9, nan_ok=True), k
    assert row_numbers(spark.range(2000), ["id"], "n", layout=TINY).filter("n <> id + 1").isEmpty()
