"""Queries over parsing, filters, recodes, unions and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.catalog.base import PANEL_SQL, panel, query, table
from fieldbook.functions import numeric as n
from fieldbook.functions import text as x
from fieldbook.operators import relational as r
from fieldbook.operators.stats import cumulative_share
from fieldbook.plans.results import join_schedule

_TEXT_SQL = """
texts AS (
  SELECT o_orderkey AS k,
    CASE o_orderkey % 6 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN 'CUT' WHEN 3 THEN 'T' || CAST(o_custkey AS VARCHAR)
      ELSE CAST(o_custkey AS VARCHAR) END AS place,
    CASE o_orderkey % 5 WHEN 0 THEN 'E' WHEN 1 THEN '--' WHEN 2 THEN '+' || CAST(o_custkey % 20 AS VARCHAR)
      WHEN 3 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' ' ELSE '-' || CAST(1 + o_custkey % 20 AS VARCHAR) END AS par,
    CASE WHEN o_orderkey % 7 = 0 THEN '--' ELSE '$' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || ',' ||
      lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') END AS won
  FROM orders
)"""


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written out as scraped cells."""
    k, player, price = F.col("o_orderkey"), F.col("o_custkey"), F.floor("o_totalprice")
    place = (
        F.when(k % 6 == 0, "-").when(k % 6 == 1, "").when(k % 6 == 2, "CUT")
        .when(k % 6 == 3, F.concat(F.lit("T"), player.cast("string"))).otherwise(player.cast("string"))
    )
    small = (player % 20).cast("string")
    par = (
        F.when(k % 5 == 0, "E").when(k % 5 == 1, "--").when(k % 5 == 2, F.concat(F.lit("+"), small))
        .when(k % 5 == 3, F.concat(F.lit(" "), player.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("-"), (1 + player % 20).cast("string")))
    )
    thousands = F.floor(F.col("o_totalprice") / 1000).cast("string")
    won = F.when(k % 7 == 0, "--").otherwise(F.concat(F.lit("$"), thousands, F.lit(","), F.lpad((price % 1000).cast("string"), 3, "0")))
    return table(spark, folder, "orders").select(k.alias("k"), place.alias("place"), par.alias("par"), won.alias("won"))


@query(
    f"""WITH {_TEXT_SQL} SELECT k,
    CASE WHEN place IN ('-', '') THEN -1.0 ELSE TRY_CAST(replace(place, 'T', '') AS DOUBLE) END::DOUBLE AS position, place = 'CUT' AS rejected FROM texts"""
)
def parse_position(spark: SparkSession, folder: str) -> DataFrame:
    place = F.col("place")
    return _texts(spark, folder).select("k", x.finish_position(place).alias("position"), x.rejected_position(place).alias("rejected"))


@query(
    f"""WITH {_TEXT_SQL} SELECT k, TRY_CAST(trim(par) AS DOUBLE) AS to_par,
    CASE WHEN par = 'E' THEN 0.0 ELSE TRY_CAST(trim(par) AS DOUBLE) END AS to_par_even, coalesce(TRY_CAST(trim(par) AS DOUBLE), 100.0) AS filled FROM texts"""
)
def coerce_numbers(spark: SparkSession, folder: str) -> DataFrame:
    par = F.col("par")
    filled = F.coalesce(x.number(par), F.lit(100.0))
    return _texts(spark, folder).select(
        "k", x.to_par(par).alias("to_par"), x.to_par(par, even_par_zero=True).alias("to_par_even"), filled.alias("filled")
    )


@query(f"WITH {_TEXT_SQL} SELECT k, TRY_CAST(replace(replace(won, '$', ''), ',', '') AS DOUBLE) AS winnings FROM texts")
def parse_currency(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("k", x.currency(F.col("won")).alias("winnings"))


@query(
    """SELECT o_orderkey AS k, CAST(CASE o_orderkey % 3 WHEN 0 THEN d WHEN 1 THEN d ELSE NULL END AS DATE) AS ends
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def date_range_end(spark: SparkSession, folder: str) -> DataFrame:
    """End dates read back from ``Jan 2 - 5``, ``Jan 30 - Feb 2`` and unreadable text built from the order date."""
    k, end = F.col("o_orderkey"), F.to_date("o_orderdate")
    start = F.date_sub(end, 3)
    month_day = F.date_format(end, "MMM d")
    same = F.month(start) == F.month(end)
    short = F.concat(F.date_format(start, "MMM d"), F.lit(" - "), F.when(same, F.date_format(end, "d")).otherwise(month_day))
    text = F.when(k % 3 == 0, short).when(k % 3 == 1, F.concat(F.date_format(start, "MMM d"), F.lit(" - "), month_day)).otherwise(month_day)
    orders = table(spark, folder, "orders").select(k.alias("k"), text.alias("text"), F.year(end).alias("season"))
    return orders.select("k", x.range_end_date(F.col("text"), F.col("season")).alias("ends"))


@query("SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS ends FROM orders")
def long_date_range_end(spark: SparkSession, folder: str) -> DataFrame:
    """End dates read back from ``January 16 - 19, 2025`` and its longer forms."""
    end = F.to_date("o_orderdate")
    start = F.date_sub(end, 3)
    tail = F.date_format(end, "MMMM d, yyyy")
    same_month, same_year = F.month(start) == F.month(end), F.year(start) == F.year(end)
    text = (
        F.when(same_month, F.concat(F.date_format(start, "MMMM d"), F.lit(" - "), F.date_format(end, "d, yyyy")))
        .when(same_year, F.concat(F.date_format(start, "MMMM d"), F.lit(" - "), tail))
        .otherwise(F.concat(F.date_format(start, "MMMM d, yyyy"), F.lit(" - "), tail))
    )
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), x.long_range_end_date(text).alias("ends"))


@query(
    """WITH places AS (SELECT c_custkey, 'Club ' || c_name || ' - ' || ['Dublin, OH', 'Palm Beach, FL', 'Hamilton, Bermuda', 'Lima, Peru', 'Rio, PR', 'Reno, NV']
    [CAST(c_custkey % 6 AS INT) + 1] AS place, CAST(c_custkey % 6 AS INT) AS i FROM customer)
SELECT c_custkey, ['OH', 'FL', 'Bermuda', NULL, 'PR', 'NV'][i + 1] AS state,
       ['Midwest', 'South', 'International', 'Unknown', 'Other', 'West'][i + 1] AS region FROM places"""
)
def state_and_region(spark: SparkSession, folder: str) -> DataFrame:
    towns = F.array(*[F.lit(t) for t in ("Dublin, OH", "Palm Beach, FL", "Hamilton, Bermuda", "Lima, Peru", "Rio, PR", "Reno, NV")])
    place = F.concat(F.lit("Club "), F.col("c_name"), F.lit(" - "), F.get(towns, (F.col("c_custkey") % 6).cast("int")))
    state = x.state_of(F.col("place"))
    named = table(spark, folder, "customer").select("c_custkey", place.alias("place")).withColumn("state", state)
    return named.select("c_custkey", "state", x.region_of(F.col("state")).alias("region"))


@query(
    """SELECT c_custkey, coalesce(r_name, 'Unknown') AS region FROM customer
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20) ON c_nationkey = n_nationkey"""
)
def lookup_region(spark: SparkSession, folder: str) -> DataFrame:
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    known = nations.filter(F.col("n_nationkey") < 20).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    known = known.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    return r.lookup_region(table(spark, folder, "customer"), ["c_nationkey"], known, "region").select("c_custkey", "region")


@query(
    """SELECT o_orderkey AS k, CAST(month(o_orderdate) AS INT) AS month, o_orderpriority || '_' || CAST(year(o_orderdate) AS VARCHAR) AS event_key,
    round(o_totalprice - o_custkey, 2) + 0.0 AS par FROM orders"""
)
def month_key_difference(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.month("o_orderdate").alias("month"),
        x.join_key(F.col("o_orderpriority"), F.year("o_orderdate")).alias("event_key"),
        F.round(F.col("o_totalprice") - F.col("o_custkey"), 2).alias("par"),
    )


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '') OR o_orderpriority IS NULL")
def excluded_values(spark: SparkSession, folder: str) -> DataFrame:
    return r.exclude(table(spark, folder, "orders"), "o_orderpriority", ["5-LOW", ""]).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority FROM orders")
def recoded_values(spark: SparkSession, folder: str) -> DataFrame:
    mapping = {"1-URGENT": "urgent", "5-LOW": "low"}
    return table(spark, folder, "orders").select("o_orderkey", r.recode("o_orderpriority", mapping).alias("priority"))


@query(
    f"""WITH {PANEL_SQL}, earlier AS (SELECT k, lag(position) OVER (PARTITION BY player ORDER BY d, k) AS last FROM panel)
SELECT k, CASE WHEN position = -1 THEN 100.0 ELSE position END AS position, CASE WHEN last = -1 THEN 100.0 ELSE last END AS last
FROM panel JOIN earlier USING (k) WHERE last IS NOT NULL"""
)
def replaced_sentinels(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a previous finish; the missed-cut code -1 becomes 100 in both columns."""
    from fieldbook.operators.history import add_history, previous

    df = add_history(panel(spark, folder), ["player"], ["d", "k"], [previous("last", "position")])
    return df.na.drop(subset=["last"]).replace(-1.0, 100.0, subset=["position", "last"]).select("k", "position", "last")


@query(f"WITH {PANEL_SQL} SELECT k, (event = 6 AND year = 1997) AS upcoming FROM panel")
def split_by_event(spark: SparkSession, folder: str) -> DataFrame:
    """Every row, marked by the side of the train / predict split it falls on."""
    train, predict = r.split_by(panel(spark, folder), r.event_mask("event", "year", 6, 1997))
    return r.union_by_name([train.select("k", F.lit(False).alias("upcoming")), predict.select("k", F.lit(True).alias("upcoming"))])


@query(
    "SELECT 'o_custkey' AS \"column\", count(*) - count(o_custkey) AS nulls, count(o_custkey) AS non_nulls FROM orders UNION ALL "
    "SELECT 'late', count(*) - count(nullif(o_orderstatus, 'F')), count(nullif(o_orderstatus, 'F')) FROM orders"
)
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("late"))
    return r.null_counts(df)


@query("SELECT count(*) AS n, sum(o_custkey)::DOUBLE AS keys, round(sum(o_totalprice), 2) AS total FROM orders")
def numeric_column_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Scan with required columns; the numeric ones are found from the schema."""
    df = r.require_columns(table(spark, folder, "orders").drop("o_orderkey"), ["o_custkey", "o_totalprice"])
    names = {"o_custkey": "keys", "o_totalprice": "total"}
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col(c).cast("double")), 2).alias(names[c]) for c in r.numeric_columns(df)])


@query(
    """SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS r1, o_orderstatus AS r2, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS extra FROM orders"""
)
def union_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Two layouts of one table brought to the same column names and united; one lacks a column."""
    orders = table(spark, folder, "orders")
    new = orders.filter(F.col("o_orderkey") % 2 == 0).select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("r1"), F.col("o_orderstatus").alias("r2"), F.col("o_orderpriority").alias("extra")
    )
    old = orders.filter(F.col("o_orderkey") % 2 != 0).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("today"), F.col("o_orderstatus").alias("thru"))
    return r.union_by_name([new, old.withColumnsRenamed({"today": "r1", "thru": "r2"})])


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Doubled input, then distinct rows."""
    pairs = table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    return r.union_by_name([pairs, pairs]).dropDuplicates()


@query(
    """SELECT o_orderkey AS k, CAST(o_totalprice <= 100000 AS INT) AS cheap, CAST(o_orderstatus <> 'F' AS DOUBLE) AS made,
    CAST(o_totalprice / 500000 >= 0.35 AS INT) AS called FROM orders"""
)
def flags(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"),
        n.flag(price <= 100000).alias("cheap"),
        n.flag(F.col("o_orderstatus") != "F", "double").alias("made"),
        n.at_least(price / 500000, 0.35).alias("called"),
    )


@query(
    """SELECT o_orderkey AS k, round_even(o_custkey / 2.0, 0) AS half_even, CAST(ceil(1 + o_totalprice - (SELECT min(o_totalprice) FROM orders)) AS BIGINT) AS ordinal,
    CASE WHEN o_custkey > 0 THEN o_custkey - 1 ELSE 0 END AS target, o_custkey - 1 AS target_plain FROM orders"""
)
def rounding(spark: SparkSession, folder: str) -> DataFrame:
    df = r.with_table_value(table(spark, folder, "orders"), {"low": F.min("o_totalprice")})
    key = F.col("o_custkey")
    return df.select(
        F.col("o_orderkey").alias("k"),
        n.half_even(key / 2.0).alias("half_even"),
        n.ordinal(F.col("o_totalprice"), F.col("low")).alias("ordinal"),
        n.next_level(key).alias("target"),
        n.next_level(key, clamp=False).alias("target_plain"),
    )


@query(
    f"""WITH {PANEL_SQL}, coded AS (SELECT k, CASE WHEN position = -1 THEN 100.0 ELSE position END AS p FROM panel)
SELECT k, CASE WHEN p = 100 THEN 'DNF' ELSE CAST(p AS VARCHAR) END AS finish, printf('%.2f', p) AS two FROM coded"""
)
def dnf_and_fixed_point(spark: SparkSession, folder: str) -> DataFrame:
    coded = panel(spark, folder).replace(-1.0, 100.0, subset=["position"])
    return coded.select("k", x.dnf_label(F.col("position")).alias("finish"), x.fixed_point(F.col("position")).alias("two"))


@query(
    """SELECT c_name AS event, c_mktsegment AS place, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def schedule_join(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as board rows under the customer as their event."""
    from fieldbook.schema import BOARD_COLUMNS

    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    schedule = customers.select(
        F.col("c_custkey").cast("string").alias("tournament_id"), F.col("c_mktsegment").alias("location"), F.col("c_name").alias("Name"),
        F.lit("Jan 2 - 5").alias("Date"), F.lit(2025).alias("Year"),
    )
    cells = {c: F.lit(None).cast("string") for c in BOARD_COLUMNS} | {"Player": F.col("o_orderkey").cast("string")}
    boards = orders.select(F.col("o_custkey").cast("string").alias("tournament_id"), *[v.alias(c) for c, v in cells.items()])
    joined = join_schedule(schedule, boards)
    return joined.select(F.col("Tournament").alias("event"), F.col("Location").alias("place"), F.col("Player").cast("bigint").alias("k"))


@query(
    f"""WITH {PANEL_SQL}, first AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY d, k) AS n FROM panel)
SELECT player, k, position FROM first WHERE n = 1"""
)
def first_event(spark: SparkSession, folder: str) -> DataFrame:
    return r.first_values(panel(spark, folder), ["player"], ["d", "k"]).select("player", "k", "position")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def top_fifty(spark: SparkSession, folder: str) -> DataFrame:
    return r.top_rows(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best_score(spark: SparkSession, folder: str) -> DataFrame:
    return r.best_row(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query(
    """WITH parts AS (SELECT o_orderpriority AS component, sum(o_totalprice) AS part FROM orders GROUP BY 1)
SELECT component, round(sum(part) OVER (ORDER BY component) / (SELECT sum(part) FROM parts), 6) AS cumulative FROM parts"""
)
def cumulative_ratio(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    parts = orders.groupBy(F.col("o_orderpriority").alias("component")).agg(F.sum("o_totalprice").alias("part"))
    return cumulative_share(parts, "part", "component", "cumulative").select("component", F.round("cumulative", 6).alias("cumulative"))
