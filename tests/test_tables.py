from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.operators import relational as r
from fieldbook.operators import reports, stats
from fieldbook.operators.impute import FillRules, fit_filler, impute
from fieldbook.operators.quantiles import exact_quantiles, medians


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 400])
def test_quantiles_are_exact(spark, size):
    rng = np.random.default_rng(size)
    values = rng.choice([1.0, 2.0, 2.0, 7.5], size) if size % 2 else rng.normal(size=size)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)] + [(0, None)], "g int, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {row["prob"]: row["value"] for row in exact_quantiles(df, ["v"], probs).collect()}
    assert [got[p] for p in probs] == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)
    by_group = {(row["g"], row["prob"]): row["value"] for row in exact_quantiles(df, ["v"], probs, ["g"]).collect()}
    for g in {i % 2 for i in range(size)}:
        assert [by_group[g, p] for p in probs] == pytest.approx(list(np.quantile(values[g::2], probs)), abs=1e-12)


def test_medians_leave_out_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    assert medians(df, ["a", "b"]) == {"a": 2.0}


def test_fill_rules(spark):
    df = spark.createDataFrame([(1, 1.0, None, None, None), (2, 3.0, 4.0, 0.5, None), (3, None, 8.0, None, None)], "i int, a double, trend double, ratio_5 double, none double")
    rules = FillRules(zero_columns=("trend",), zero_prefixes=("ratio",))
    got = impute(df, ["a", "trend", "ratio_5", "none"], rules).orderBy("i").collect()
    assert [tuple(x)[1:] for x in got] == [(1.0, 0.0, 0.0, None), (3.0, 4.0, 0.5, None), (2.0, 8.0, 0.0, None)]
    assert fit_filler(df.filter("i = 1"), ["a"]).apply(df.filter("i = 3")).first()["a"] == 1.0


def test_correlation_of_constant_empty_and_single_columns(spark):
    rows = [(k, float(k), 5.0, None, 1.0 if k == 2 else None, -2.0 * k + (1.0 if k == 3 else 0.0)) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "key int, up double, constant double, empty double, single double, down double")
    got = {x["feature"]: x["r"] for x in stats.key_correlation(df, "key").collect()}
    assert got["up"] == pytest.approx(1.0) and got["constant"] is None and got["empty"] == 0.0 and got["single"] is None
    assert got["down"] == pytest.approx(np.corrcoef([1, 2, 3, 4, 5], [-2, -4, -5, -8, -10])[0, 1])
    matrix = {(x["m1"], x["m2"]): x["r"] for x in stats.correlation_matrix(df, ["key", "up", "down"]).collect()}
    assert len(matrix) == 9 and matrix["up", "down"] == matrix["down", "up"]
    lines = reports.advice(df, "key").orderBy("place").collect()
    assert [x["feature"] for x in lines] == ["down", "up"]
    assert "strong negative correlation (-0.99)" in lines[0]["line"] and lines[1]["line"].startswith("**Reduce up")
    flat = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 1.0)], "key int, v double")
    [only] = reports.advice(flat, "key").collect()
    assert only["line"] == reports.NONE_FOUND


def test_describe_and_box(spark):
    values = [float(v) for v in (1, 2, 3, 4, 100)]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    [d] = stats.describe(df, ["v"]).collect()
    assert (d["count"], d["q25"], d["q50"], d["q75"], d["max"]) == (5, 2.0, 3.0, 4.0, 100.0)
    assert d["std"] == pytest.approx(np.std(values, ddof=1))
    [b] = stats.box_stats(df, ["g"], "v").collect()
    assert (b["low_fence"], b["high_fence"], b["n"]) == (1.0, 4.0, 5)


def test_snapshot_and_comparison(spark):
    df = spark.createDataFrame([(1, 1.234, None), (2, 2.0, 3.0), (3, 4.0, 5.0)], "lvl int, `a %` double, b double")
    got = {x["metric"]: x["value"] for x in reports.kpi_snapshot(df, "lvl", 1, ["a %", "b", "c"]).collect()}
    assert got == {"a %": "1.23", "b": "N/A", "c": "N/A"}
    assert {x["value"] for x in reports.kpi_snapshot(df, "lvl", 9, ["b"]).collect()} == {"N/A"}
    assert {x["lvl"] for x in reports.compare_long(df, "lvl", ["a %"]).collect()} == {1, 3}
    assert reports.advice_heading(df, "lvl", 0).first()["target"] == 0


def test_predicates_keep_rows_without_values(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "v string")
    assert {x[0] for x in r.exclude(df, "v", ["x"]).collect()} == {"y", None}
    outside, inside = r.split_by(df, F.col("v") == "x")
    assert outside.count() == 2 and inside.count() == 1
    with pytest.raises(r.MissingColumns, match="a, b"):
        r.require_columns(df, ["v", "a", "b"])


def test_missed_positions(spark):
    rows = [("e", 1, -1.0), ("e", 1, 3.0), ("f", 1, -1.0), ("f", 1, -1.0), ("g", 1, 2.0)]
    df = spark.createDataFrame(rows, "event string, year int, pos double")
    got = sorted(tuple(x) for x in r.missed_position(df, ["event", "year"], "pos", "placed").select("event", "pos", "placed").collect())
    assert got == [("e", -1.0, 4.0), ("e", 3.0, 3.0), ("f", -1.0, 0.0), ("f", -1.0, 0.0), ("g", 2.0, 2.0)]


def test_fill_missed_falls_back_when_nobody_finished(spark):
    df = spark.createDataFrame([(-1.0, 70.0, None)], "pos double, r3 double, par double")
    [got] = r.fill_missed(df, F.col("pos") == -1, ["r3"], "par").collect()
    assert (got["r3"], got["par"]) == (0.0, 10.0)


def test_previous_edition(spark):
    rows = [("p", "e", 2023, date(2023, 1, 2), 7.0), ("p", "e", 2023, date(2023, 1, 1), 5.0), ("p", "e", 2024, date(2024, 1, 1), -1.0),
            ("p", "e", 2025, date(2025, 1, 1), 1.0), ("q", "e", 2023, date(2023, 1, 1), None), ("q", "e", 2024, date(2024, 1, 1), 2.0)]
    df = spark.createDataFrame(rows, "who string, event string, year int, d date, pos double")
    got = {(x["who"], x["d"]): x["prev"] for x in r.previous_edition(df, "who", "event", "year", "pos", ["d"], "prev").collect()}
    assert got["p", date(2024, 1, 1)] == 5.0  # the earlier of two rows
    assert got["p", date(2025, 1, 1)] == 100.0  # missed cut
    assert got["p", date(2023, 1, 1)] == 100.0 and got["q", date(2024, 1, 1)] == 100.0
