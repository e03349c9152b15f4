"""Queries over profile statistics and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.catalog.base import PANEL_SQL, PROFILE_METRICS, PROFILE_SQL, panel, profile, query, round_all, table
from fieldbook.operators import reports, stats, units
from fieldbook.operators.quantiles import exact_quantiles
from fieldbook.operators.relational import with_table_value

_DESCRIBED = ["l_quantity", "l_extendedprice", "l_tax"]


def _describe_sql(source: str, columns: list[str], where: str = "") -> str:
    one = (
        "SELECT '{c}' AS metric, count({c}) AS \"count\", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, "
        "CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 5) AS q25, round(quantile_cont({c}, 0.5), 5) AS q50, "
        "round(quantile_cont({c}, 0.75), 5) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {s} {w}"
    )
    return " UNION ALL ".join(one.format(c=c, s=source, w=where) for c in columns)


@query(_describe_sql("lineitem", _DESCRIBED))
def describe_lines(spark: SparkSession, folder: str) -> DataFrame:
    df = stats.describe(table(spark, folder, "lineitem"), _DESCRIBED)
    return round_all(df, ["mean", "std", "q25", "q50", "q75"], 5)


@query(
    f"WITH {PROFILE_SQL}, r AS (SELECT level, round(quantity, 9) AS quantity, round(price, 6) AS price FROM profile) "
    + _describe_sql("r", ["quantity", "price"], "WHERE level IN (1, 10, 50)").replace("CAST(min(", "round(min(").replace("CAST(max(", "round(max(").replace(" AS DOUBLE)", ", 5)")
)
def compare_summary(spark: SparkSession, folder: str) -> DataFrame:
    df = round_all(round_all(profile(spark, folder), ["quantity"], 9), ["price"], 6)
    return round_all(reports.compare_summary(df, "level", [1, 10, 50], ["quantity", "price"]), ["mean", "std", "min", "q25", "q50", "q75", "max"], 5)


@query(
    "SELECT event_type, p AS prob, round(CASE p WHEN 0.1 THEN a WHEN 0.5 THEN b ELSE c END, 6) AS value FROM (SELECT event_type, "
    "quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.99) AS c FROM events GROUP BY event_type), "
    "(VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE)) AS t(p)"
)
def quantiles_by_type(spark: SparkSession, folder: str) -> DataFrame:
    df = exact_quantiles(table(spark, folder, "events"), ["value"], [0.1, 0.5, 0.99], ["event_type"])
    return round_all(df, ["value"]).select("event_type", "prob", "value")


@query(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type)
SELECT event_type, count(value) AS n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low_fence,
  max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high_fence
FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3"""
)
def box_stats(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.box_stats(table(spark, folder, "events"), ["event_type"], "value"), ["q1", "median", "q3"])


def _corr_sql(key: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS feature, corr({m}, {key}) AS r FROM profile" for m in metrics)


_R_SQL = f"WITH {PROFILE_SQL}, r AS ({_corr_sql('level', PROFILE_METRICS)})"


@query(f"{_R_SQL} SELECT feature, round(r, 6) AS r FROM r")
def key_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.key_correlation(profile(spark, folder), "level"), ["r"])


@query(
    f"WITH {PROFILE_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS m1, '{b}' AS m2, round(corr({a}, {b}), 6) AS r FROM profile"
        for a in ["level", *PROFILE_METRICS]
        for b in ["level", *PROFILE_METRICS]
    )
)
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.correlation_matrix(profile(spark, folder), ["level", *PROFILE_METRICS]), ["r"])


@query(
    f"""{_R_SQL} (SELECT feature, round(r, 6) AS r FROM r WHERE r < -0.05 ORDER BY r.r, feature LIMIT 2)
UNION (SELECT feature, round(r, 6) AS r FROM r WHERE r > 0.05 ORDER BY r.r DESC, feature LIMIT 2)"""
)
def strongest_drivers(spark: SparkSession, folder: str) -> DataFrame:
    r = stats.key_correlation(profile(spark, folder), "level")
    return round_all(stats.strongest_drivers(r, 0.05, 2), ["r"])


_LONG_SQL = " UNION ALL ".join(f"SELECT level, '{m}' AS metric, {m} AS value FROM profile" for m in PROFILE_METRICS)


@query(
    f"""{_R_SQL}, long AS ({_LONG_SQL}), picked AS ((SELECT feature FROM r WHERE r < -0.05 ORDER BY r.r, feature LIMIT 2)
UNION (SELECT feature FROM r WHERE r > 0.05 ORDER BY r.r DESC, feature LIMIT 2))
SELECT metric AS driver, round(value, 6) AS x, level FROM long JOIN picked ON feature = metric"""
)
def driver_points(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(reports.driver_points(profile(spark, folder), "level", threshold=0.05, k=2), ["x"])


@query(
    f"""{_R_SQL}, long AS ({_LONG_SQL}) SELECT metric, round(abs(r), 6) AS strength, level, round(value, 6) AS value FROM long JOIN r ON feature = metric"""
)
def trend_series(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(reports.trend_series(profile(spark, folder), "level"), ["strength", "value"])


@query(
    f"""{_R_SQL} SELECT CAST(row_number() OVER (ORDER BY r >= 0, -abs(r)) - 1 AS INT) AS place, feature, round(r, 6) AS r,
CASE WHEN r < 0 THEN 'Improve ' ELSE 'Reduce ' END || feature AS line FROM r WHERE abs(r) > 0.05"""
)
def advice(spark: SparkSession, folder: str) -> DataFrame:
    df = reports.advice(profile(spark, folder), "level", 0.05)
    start = F.regexp_extract("line", r"^\*\*((?:Improve|Reduce) [^:]*):\*\*", 1)
    return round_all(df, ["r"]).withColumn("line", start)


@query(
    f"""WITH {PROFILE_SQL}, long AS ({_LONG_SQL}) SELECT metric, printf('%.2f', value) AS value FROM long WHERE level = 16
UNION ALL SELECT 'absent', 'N/A'"""
)
def kpi_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return reports.kpi_snapshot(profile(spark, folder), "level", 16, [*PROFILE_METRICS, "absent"])


@query(
    f"""SELECT metric, 'N/A' AS value FROM (SELECT unnest({PROFILE_METRICS}) AS metric) UNION ALL SELECT 'advice', '{reports.NONE_FOUND}' UNION ALL
SELECT 'levels', CAST(count(*) AS VARCHAR) FROM part WHERE p_size > 1000"""
)
def empty_level(spark: SparkSession, folder: str) -> DataFrame:
    """A level without rows: every metric is absent, and the advice says that there is none."""
    df = profile(spark, folder)
    none = df.filter(F.col("level") > 1000)
    lines = reports.advice(none, "level").select(F.lit("advice").alias("metric"), F.col("line").alias("value"))
    count = none.agg(F.lit("levels").alias("metric"), F.count(F.lit(1)).cast("string").alias("value"))
    return reports.kpi_snapshot(df, "level", 1001, PROFILE_METRICS).unionByName(lines).unionByName(count)


@query(f"{_R_SQL} SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INT) AS place, feature, round(r, 6) AS r FROM r")
def features_by_strength(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics in the order of their correlation's size."""
    ordered = stats.by_strength(stats.key_correlation(profile(spark, folder), "level"))
    # one row for each metric
    numbered = ordered.agg(F.collect_list(F.struct("feature", "r")).alias("all")).select(F.posexplode("all").alias("at", "f"))
    return round_all(numbered.select((F.col("at") + 1).alias("place"), "f.feature", "f.r"), ["r"])


@query(
    """SELECT p_partkey, round(p_retailprice / 100, 6) AS proximity, p_size <= 10 OR p_size > 45 AS proximity_rescaled, round(p_retailprice, 6) AS price, false AS price_rescaled FROM part"""
)
def repaired_units(spark: SparkSession, folder: str) -> DataFrame:
    """A column in two units, a hundred apart, put into the unit of most rows; a column in one unit stays."""
    other = (F.col("p_size") <= 10) | (F.col("p_size") > 45)
    mixed = F.when(other, F.col("p_retailprice") / 10_000).otherwise(F.col("p_retailprice") / 100)
    df = table(spark, folder, "part").select("p_partkey", mixed.alias("proximity"), F.col("p_retailprice").alias("price"))
    return round_all(units.repair_units(df, ["proximity", "price"]), ["proximity", "price"])


@query(
    f"""WITH {PROFILE_SQL}, long AS ({_LONG_SQL}) SELECT level, metric, round(value, 6) AS value FROM long
WHERE level IN ((SELECT min(level) FROM profile), (SELECT max(level) FROM profile))"""
)
def compare_long(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(reports.compare_long(profile(spark, folder), "level", PROFILE_METRICS), ["value"])


@query("SELECT DISTINCT p_size AS level FROM part ORDER BY 1")
def levels(spark: SparkSession, folder: str) -> DataFrame:
    return reports.levels(table(spark, folder, "part").select(F.col("p_size").alias("level")), "level")


@query("SELECT o_orderstatus AS event, o_orderkey AS player, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def forecast_head(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    named = orders.select(F.col("o_orderstatus").alias("event"), F.col("o_orderkey").alias("player"), F.col("o_totalprice").alias("score"))
    return reports.forecast_head(named, "event", "player", "score")


@query(
    f"""WITH {PANEL_SQL} SELECT k, CASE WHEN position = -1 THEN 'DNF' ELSE CAST(position AS VARCHAR) END AS position, printf('%.2f', to_par) AS to_par,
    to_par = (SELECT max(to_par) FROM panel) AS to_par_is_max, to_par = (SELECT min(to_par) FROM panel) AS to_par_is_min, player FROM panel"""
)
def forecast_kpis(spark: SparkSession, folder: str) -> DataFrame:
    coded = panel(spark, folder).replace(-1.0, 100.0, subset=["position"])
    return reports.forecast_kpis(coded, "k", ["position"], ["to_par"], ["player"])


@query(
    """SELECT event_id, value = (SELECT max(value) FROM events) AS is_max, value = (SELECT min(value) FROM events) AS is_min FROM events"""
)
def highlight_ends(spark: SparkSession, folder: str) -> DataFrame:
    ends = with_table_value(table(spark, folder, "events"), {"high": F.max("value"), "low": F.min("value")})
    return ends.select("event_id", (F.col("value") == F.col("high")).alias("is_max"), (F.col("value") == F.col("low")).alias("is_min"))
