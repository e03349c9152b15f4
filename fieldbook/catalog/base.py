"""Registry of queries over the test tables, each with the SQL it must agree with where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql.strip()
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """The rows of a small table in as many partitions as the work on each of them needs."""
    return df.repartition(-(-max(df.count(), 1) // rows), key)


def rounded(places: int = 6, **columns: Column | str) -> list[Column]:
    return [F.round(F.col(c) if isinstance(c, str) else c, places).alias(n) for n, c in columns.items()]


def round_all(df: DataFrame, names: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), places) for n in names})


ENTITY, ORDER = ["player"], ["d", "k"]

PANEL_SQL = """
panel AS (
  SELECT o_custkey AS player, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k,
         CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS event,
         CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE 1.0 + (CAST(floor(o_totalprice) AS BIGINT) % 80) END::DOUBLE AS position,
         CAST((CAST(floor(o_totalprice / 1000) AS BIGINT) % 30) - 12 AS DOUBLE) AS to_par
  FROM orders
)"""


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as results: a customer is a player, a calendar month an event, status F a missed cut."""
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("player"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_orderkey").alias("k"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("event"),
        F.when(F.col("o_orderstatus") == "F", -1.0).otherwise(1.0 + F.floor(price) % 80).alias("position"),
        (F.floor(price / 1000) % 30 - 12).cast("double").alias("to_par"),
    )


ROUNDS_SQL = (
    PANEL_SQL
    + """,
rounds AS (
  SELECT l_orderkey AS k, avg(l_quantity) FILTER (l_linenumber = 1) AS r1, avg(l_quantity) FILTER (l_linenumber = 2) AS r2,
         avg(l_quantity) FILTER (l_linenumber = 3) AS r3, avg(l_quantity) FILTER (l_linenumber = 4) AS r4
  FROM lineitem GROUP BY l_orderkey
),
scored AS (SELECT p.*, r1, r2, r3, r4 FROM panel p LEFT JOIN rounds r USING (k))"""
)


def scored_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel with four round scores per order: mean quantity of its line items 1 to 4."""
    lines = table(spark, folder, "lineitem")
    rounds = lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        *[F.avg(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"r{i}") for i in range(1, 5)]
    )
    return panel(spark, folder).join(rounds, "k", "left")


PROFILE_METRICS = ["quantity", "price", "discount", "tax", "retail"]
PROFILE_SQL = """
profile AS (
  SELECT p_size AS level, avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_discount) AS discount,
         avg(l_tax) AS tax, avg(p_retailprice) AS retail
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_size
)"""


def profile(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part size: mean quantity, price, discount, tax and retail price of its line items."""
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(F.col("p_size").alias("level"))
        .agg(
            F.avg("l_quantity").alias("quantity"),
            F.avg("l_extendedprice").alias("price"),
            F.avg("l_discount").alias("discount"),
            F.avg("l_tax").alias("tax"),
            F.avg("p_retailprice").alias("retail"),
        )
    )
