from datetime import date

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import numeric as n
from fieldbook.functions import text as x


def each(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_positions(spark):
    texts = ["1", "T12", "-", "", "CUT", None, "E"]
    assert each(spark, texts, x.finish_position) == [1.0, 12.0, -1.0, -1.0, None, None, None]
    assert each(spark, texts, x.rejected_position) == [False, False, False, False, True, False, True]


def test_numbers(spark):
    texts = ["-11", "+3", "E", "--", " 5 ", "1d", "NaN", "1e2", ".5", None]
    assert each(spark, texts, x.number) == [-11.0, 3.0, None, None, 5.0, None, None, 100.0, 0.5, None]
    assert each(spark, ["E", "2", None], lambda c: x.to_par(c, even_par_zero=True)) == [0.0, 2.0, None]
    assert each(spark, ["$1,234,567", "--", None], x.currency) == [1234567.0, None, None]


def test_cell_text(spark):
    texts = ["<a href='x'>Jos&eacute;</a> ", "A &amp;lt; B", "&#233;&#xE9; &unknown; & c", "\n\t&nbsp;x<!-- <b> -->", None, ""]
    assert each(spark, texts, x.cell_text) == ["José", "A &lt; B", "éé &unknown; & c", "x", None, ""]


def test_range_end(spark):
    rows = [("Jan 2 - 5", 2025), ("Feb 29 - Mar 3", 2024), ("17-Dec", 2024), ("Dec 17", 2024), ("Sept 5 - 8", 2024), (None, 2024)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, y int")
    got = [r[0] for r in df.orderBy("i").select(x.range_end_date(F.col("t"), F.col("y"))).collect()]
    assert got == [date(2025, 1, 5), date(2024, 3, 3), date(2024, 12, 17), None, None, None]


def test_long_range_end(spark):
    texts = ["January 16 - 19, 2025", "April 30 - May 3, 2025", "December 30, 2024 - January 2, 2025", "junk", None]
    assert each(spark, texts, x.long_range_end_date) == [date(2025, 1, 19), date(2025, 5, 3), date(2025, 1, 2), None, None]


def test_states_and_regions(spark):
    places = ["Club - Dublin, OH", "Southampton, Bermuda", "Rio, PR", "Oakmont, PA", "PGA West, CA"]
    assert each(spark, places, x.state_of) == ["OH", "Bermuda", "PR", None, "CA"]
    assert each(spark, places, lambda c: x.region_of(x.state_of(c))) == ["Midwest", "International", "Other", "Unknown", "West"]


def test_labels_and_formats(spark):
    assert each(spark, [100.0, 4.0, None], x.dnf_label, "double") == ["DNF", "4.0", None]
    assert each(spark, [1.005, 2.0, None], x.fixed_point, "double")[1:] == ["2.00", None]
    assert each(spark, ["a", None], lambda c: x.join_key(c, F.lit(2024))) == ["a_2024", None]
    assert each(spark, ["id=12&x", "none"], lambda c: x.capture(c, r"id=(\d+)")) == ["12", None]


def test_rounding(spark):
    assert each(spark, [0.5, 1.5, 2.5, -0.5], n.half_even, "double") == [0.0, 2.0, 2.0, 0.0]
    assert each(spark, [2.84, 2.89, 4.0], lambda c: n.ordinal(c, F.lit(2.84)), "double") == [1, 2, 3]
    assert each(spark, [3, 0, -2], n.next_level, "int") == [2, 0, 0]
    assert each(spark, [3, 0], lambda c: n.next_level(c, clamp=False), "int") == [2, -1]


def test_row_statistics(spark):
    df = spark.createDataFrame([(1, 70.0, 72.0, None, None), (2, 70.0, None, None, None), (3, None, None, None, None)], "i int, a double, b double, c double, d double")
    got = df.orderBy("i").select(n.row_mean(["a", "b", "c", "d"]), n.row_std(["a", "b", "c", "d"])).collect()
    assert got[0][0] == 71.0 and got[0][1] == pytest.approx(2**0.5)
    assert got[1][0] == 70.0 and got[1][1] is None
    assert got[2][0] is None and got[2][1] is None


def test_folds_depend_on_the_key_only(spark):
    df = spark.range(1000).withColumn("f", n.fold_of(F.col("id"), 5))
    again = df.repartition(13).select("id", "f")
    assert df.exceptAll(again).isEmpty()
    sizes = [r["count"] for r in df.groupBy("f").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 150
