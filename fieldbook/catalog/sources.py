"""Queries over page extraction, the results table, and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.catalog.base import ROUNDS_SQL, query, scored_panel, spread, table
from fieldbook.functions.text import capture
from fieldbook.plans import results as plan
from fieldbook.session import materialise, shared_folder
from fieldbook.sources import pages as p
from fieldbook.sources import tables as t


@query("SELECT page_id, nullif(regexp_extract(url, '/(\\d+)(?:[/.?#]|$)', 1), '') AS page_no FROM pages")
def page_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", capture(F.col("url"), r"/(\d+)(?:[/.?#]|$)").alias("page_no"))


def _plain(sql: str) -> str:
    return f"trim(replace(regexp_replace({sql}, '<[^>]*>', '', 'g'), '&amp;', '&'))"


@query(
    f"""SELECT page_id, {_plain("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
    {_plain("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS dated, {_plain("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS place FROM pages"""
)
def page_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Title, date text and place of each page; the place is found under its second alternative."""
    heads = p.extract_event(
        table(spark, folder, "pages"),
        date=r"<title\b[^>]*>(.*?)</title>",
        places=(r"<div\b[^>]*no-such-class[^>]*>(.*?)</div>", r"<div\b[^>]*\bad\b[^>]*>(.*?)</div>"),
    )
    return heads.select("page_id", F.col("Tournament").alias("title"), F.col("Date").alias("dated"), F.col("Location").alias("place"))


_LI_SQL = "regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '(?s)<li[^>]*>(.*?)</li>', 1)"


@query(
    f"""SELECT page_id, CAST(i - 1 AS INT) AS row_no, {_plain("li[i]")} AS cell
FROM (SELECT page_id, {_LI_SQL} AS li FROM pages), LATERAL (SELECT unnest(range(1, len(li) + 1)) AS i)"""
)
def largest_block(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the largest list on each page."""
    rows = p.page_rows(table(spark, folder, "pages"), p.Markup("ul", "li", "a"))
    return rows.select("page_id", "row_no", F.get("cells", F.lit(0)).alias("cell"))


@query(
    f"""SELECT page_id, {_plain("li[2]")} AS second, {_plain("li[3]")} AS third, {_plain("li[11]")} AS eleventh
FROM (SELECT page_id, {_LI_SQL} AS li FROM pages) WHERE len(li) >= 6"""
)
def list_cells(spark: SparkSession, folder: str) -> DataFrame:
    """A list read as one row of cells; pages with fewer than six cells are left out, trailing cells are null."""
    boards = p.extract_boards(table(spark, folder, "pages"), markup=p.Markup("nav", "ul", "li"), min_cells=6)
    return boards.select("page_id", F.col("Position").alias("second"), F.col("Player").alias("third"), F.col("FedEx").alias("eleventh"))


def _element(tag: str, attributes: str, body) -> list:
    return [F.lit(f"<{tag} {attributes}>"), body, F.lit(f"</{tag}>")]


def _customer_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written out as schedule pages: some lack a place, dates stand under either class."""
    key = F.col("c_custkey")
    dated = F.when(key % 2 == 0, F.lit("dateAndTickets__col")).otherwise(F.lit("dateRange__col"))
    place = F.when(key % 10 == 9, F.lit("")).otherwise(
        F.concat(*_element("div", 'class="eventAndLocation__tournamentLocation"', F.col("c_mktsegment")))
    )
    html = F.concat(
        F.lit('<div class="Table__Scroller"><table><tr class="Table__TR"><td class="'), dated, F.lit('"> Jan 2 - 5 </td><td><a href="/x?tournamentId='),
        key.cast("string"), F.lit('" class="AnchorLink eventAndLocation__tournamentLink">'), F.col("c_name"), F.lit(" &amp; Co</a>"), place,
        F.lit('</td></tr><tr class="Table__TR"><td>no link</td></tr></table></div>'),
    )
    return spread(table(spark, folder, "customer"), "c_custkey").select(key.alias("page_id"), F.lit("https://example.org/schedule/_/season/2024").alias("url"), html.alias("html"))


@query(
    """SELECT c_custkey AS page_id, CAST(c_custkey AS VARCHAR) AS tournament_id, c_mktsegment AS location, c_name || ' & Co' AS name, 'Jan 2 - 5' AS dates
FROM customer WHERE c_custkey % 10 <> 9"""
)
def schedule_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = p.extract_schedule(_customer_pages(spark, folder))
    return rows.select("page_id", "tournament_id", "location", F.col("Name").alias("name"), F.col("Date").alias("dates"))


def _order_pages(spark: SparkSession, folder: str, player, event, place, to_par, short=None) -> DataFrame:
    """Orders written out as board pages: a short table first, then the board with one row and a note.

    Rounds follow from the order's key; where ``short`` holds, the row ends after them.
    """
    key = F.col("o_orderkey")
    rounds = [62 + key * i * 7 % 17 for i in (1, 2, 3, 4)]
    first = [F.lit(""), place, player, to_par, *[r.cast("string") for r in rounds]]
    last = [sum(rounds[1:], rounds[0]).cast("string"), F.concat(F.lit("$"), key.cast("string")), (key % 100).cast("string")]
    rest = F.concat(*[x for c in last for x in _element("td", 'class="c"', c)])
    html = F.concat(
        F.lit('<table><tbody class="Table__TBODY"><tr><td>note</td></tr></tbody></table><table><tbody class="Table__TBODY"><tr>'),
        *[x for c in first for x in _element("td", 'class="c"', c)],
        rest if short is None else F.when(short, F.lit("")).otherwise(rest),
        F.lit("</tr><tr><td>cut line</td></tr></tbody></table>"),
    )
    url = F.concat(F.lit("https://example.org/leaderboard?tournamentId="), event)
    return spread(table(spark, folder, "orders"), "o_orderkey").select(key.alias("page_id"), url.alias("url"), html.alias("html"))


@query(
    """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE 'T' || (o_orderkey % 60 + 1) END AS "Position", CAST(o_custkey AS VARCHAR) AS "Player",
    CASE WHEN o_orderkey % 9 = 0 THEN 'E' ELSE CAST(o_orderkey % 19 - 9 AS VARCHAR) END AS "TOPAR",
    CAST(62 + o_orderkey * 7 % 17 AS VARCHAR) AS "R1", CAST(62 + o_orderkey * 14 % 17 AS VARCHAR) AS "R2", CAST(62 + o_orderkey * 21 % 17 AS VARCHAR) AS "R3", CAST(62 + o_orderkey * 28 % 17 AS VARCHAR) AS "R4",
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(248 + o_orderkey * 7 % 17 + o_orderkey * 14 % 17 + o_orderkey * 21 % 17 + o_orderkey * 28 % 17 AS VARCHAR) END AS "Total",
    CASE WHEN o_orderkey % 4 <> 0 THEN '$' || CAST(o_orderkey AS VARCHAR) END AS "Winnings", CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 100 AS VARCHAR) END AS "FedEx" FROM orders"""
)
def board_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One board row of each page, a fourth of them without the cells behind the rounds."""
    key = F.col("o_orderkey")
    place = F.when(key % 5 == 0, F.lit(" - ")).otherwise(F.concat(F.lit(" T"), (key % 60 + 1).cast("string"), F.lit(" ")))
    to_par = F.when(key % 9 == 0, F.lit("E")).otherwise((key % 19 - 9).cast("string"))
    pages = _order_pages(spark, folder, F.col("o_custkey").cast("string"), F.lit("1"), place, to_par, key % 4 == 0)
    return p.extract_boards(pages).select("page_id", "Position", "Player", "TOPAR", "R1", "R2", "R3", "R4", "Total", "Winnings", "FedEx")


@query("SELECT o_orderkey AS page_id, CAST(o_custkey AS VARCHAR) AS player FROM orders")
def field_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Entrants from the full row of each board page."""
    pages = _order_pages(spark, folder, F.col("o_orderkey").cast("string"), F.lit("1"), F.col("o_custkey").cast("string"), F.lit("E"))
    return p.extract_field(pages).select("page_id", F.col("Player").alias("player"))


@query(
    """SELECT c_custkey AS page_id, 'Open of ' || n_name || ' & Co' AS tournament, CASE WHEN c_custkey % 7 <> 0 THEN n_name || ' Links - Dublin, OH' END AS location,
    CASE WHEN c_custkey % 5 = 0 THEN make_date(2025, 2, c_custkey % 9 + 1) ELSE make_date(2025, 1, c_custkey % 20 + 4) END AS last_day, 2025 AS year, c_name || suffix AS player
FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (''), (' II')) AS e(suffix)"""
)
def upcoming_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Event pages to the rows to predict: name, place and last day from the head, two entrants from the table of each."""
    named = spread(table(spark, folder, "customer"), "c_custkey").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    day = lambda n: n.cast("string")
    dates = F.when(key % 5 == 0, F.concat(F.lit("January 30 - February "), day(key % 9 + 1))).otherwise(F.concat(F.lit("January "), day(key % 20 + 1), F.lit(" - "), day(key % 20 + 4)))
    place = F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(*_element("div", 'class="Leaderboard__Course__Location n8 clr-gray-04"', F.concat("n_name", F.lit(" Links - Dublin, OH")))))
    entrant = lambda suffix: [F.lit("<tr>"), *_element("td", "", F.lit("")), *_element("td", 'class="p"', F.concat("c_name", F.lit(suffix))), F.lit("</tr>")]
    html = F.concat(
        *_element("h1", 'class="title"', F.concat(F.lit("Open of "), "n_name", F.lit(" &amp; Co"))), *_element("span", 'class="Leaderboard__Event__Date n7"', F.concat(dates, F.lit(", 2025"))),
        place, F.lit('<table><tbody class="Table__TBODY">'), *entrant(""), *entrant(" II"), F.lit("</tbody></table>"),
    )
    pages = named.select(key.alias("page_id"), F.lit("https://example.org/event").alias("url"), html.alias("html"))
    found = plan.upcoming_field(pages, keep_page=True)
    return found.select("page_id", F.col("Tournament").alias("tournament"), F.col("Location").alias("location"), F.col("Final_Date").alias("last_day"), F.col("Year").alias("year"), F.col("Player").alias("player"))


RESULTS_SQL = (
    ROUNDS_SQL
    + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY player, year, event ORDER BY k) AS n FROM scored),
results AS (
  SELECT CAST(player AS VARCHAR) AS player, 'Event ' || lpad(CAST(event AS VARCHAR), 2, '0') || CASE WHEN n > 1 THEN ' No ' || CAST(n AS VARCHAR) ELSE '' END AS tournament, year, make_date(year, event, 4) AS d,
         position, to_par, r1, r2, r3, r4 FROM numbered
)"""
)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One result per order, in the columns of the results table; further orders of a customer and month are events of their own."""
    order = W.partitionBy("player", "year", "event").orderBy("k")
    first = scored_panel(spark, folder).withColumn("n", F.row_number().over(order))
    number = F.lpad(F.col("event").cast("string"), 2, "0")
    text = {c: F.col(c.lower()).cast("string").alias(c) for c in ("R1", "R2", "R3", "R4")}
    return first.select(
        F.concat(F.lit("Event "), number, F.when(F.col("n") > 1, F.concat(F.lit(" No "), F.col("n").cast("string"))).otherwise("")).alias("Tournament"),
        F.lit("Muirfield - Dublin, OH").alias("Location"),
        F.col("year").alias("Year"),
        F.col("position").alias("Position"),
        F.col("player").cast("string").alias("Player"),
        F.col("to_par").cast("int").cast("string").alias("TOPAR"),
        *text.values(),
        F.lit(None).cast("string").alias("Total"),
        F.lit(None).cast("string").alias("Winnings"),
        F.make_date("year", "event", F.lit(4)).alias("Final_Date"),
    )


_BY = "OVER (PARTITION BY player ORDER BY d, tournament, year)"
FIRST_HISTORY_SQL = f"""
dated AS (
  SELECT *, lag(position, 1) {_BY} AS last_1, lag(position, 2) {_BY} AS last_2, lag(position, 3) {_BY} AS last_3,
         CAST(date_diff('day', lag(d) {_BY}, d) AS INT) AS days, CAST(month(d) AS INT) AS month FROM results
),
history AS (
  SELECT a.*, coalesce(nullif(b.position, -1), 100.0) AS previous
  FROM dated a LEFT JOIN results b ON b.player = a.player AND b.tournament = a.tournament AND b.year = a.year - 1
)"""


@query(
    f"""WITH {RESULTS_SQL}, {FIRST_HISTORY_SQL}
SELECT player, tournament, year, position, 'OH' AS state, 'Midwest' AS region, last_1, last_2, last_3, month, previous, days,
  coalesce(CAST(r1 AS VARCHAR), '--') AS r1, coalesce(CAST(r2 AS VARCHAR), '--') AS r2, coalesce(CAST(r3 AS VARCHAR), '--') AS r3, coalesce(CAST(r4 AS VARCHAR), '--') AS r4 FROM history"""
)
def results_table(spark: SparkSession, folder: str) -> DataFrame:
    """Pages to the results table: schedule and boards are written out as pages and read back."""
    found = materialise(results(spark, folder))
    number = F.concat(F.col("Year").cast("string"), F.regexp_replace("Tournament", "[^0-9]", ""))
    month = F.date_format("Final_Date", "MMM")
    events = found.select("Tournament", "Year", number.alias("id"), month.alias("month")).distinct()
    schedule_html = F.concat(
        F.lit('<div><table><tr class="Table__TR"><td class="dateRange__col">'), F.col("month"), F.lit(' 1 - 4</td><td><a href="?tournamentId='), F.col("id"),
        F.lit('"><p class="eventAndLocation__tournamentLink">'), F.col("Tournament"),
        F.lit('</p></a><div class="eventAndLocation__tournamentLocation">Muirfield - Dublin, OH</div></td></tr></table></div>'),
    )
    season = F.concat(F.lit("https://example.org/schedule/_/season/"), F.col("Year").cast("string"))
    schedule_pages = events.select(F.col("id").cast("bigint").alias("page_id"), season.alias("url"), schedule_html.alias("html"))
    place = F.when(F.col("Position") == -1, "-").otherwise(F.concat(F.lit("T"), F.col("Position").cast("int").cast("string")))
    shown = [F.lit(""), place, F.col("Player"), F.col("TOPAR"), *[F.coalesce(c, F.lit("--")) for c in ("R1", "R2", "R3", "R4")], F.lit("280"), F.lit("$1,000"), F.lit("5")]
    board_html = F.concat(F.lit("<tbody><tr>"), *[x for c in shown for x in _element("td", "", c)], F.lit("</tr></tbody>"))
    url = F.concat(F.lit("https://example.org/leaderboard?tournamentId="), number)
    board_pages = found.select(F.xxhash64("Player", "Tournament", "Year").alias("page_id"), url.alias("url"), board_html.alias("html"))
    built = plan.build_results(plan.ingest(schedule_pages, board_pages, 2025))
    return built.select(
        F.col("Player").alias("player"), F.col("Tournament").alias("tournament"), F.col("Year").alias("year"), F.col("Position").alias("position"),
        F.col("State").alias("state"), F.col("Region").alias("region"), F.col("Last T1 Finish").alias("last_1"), F.col("Last T2 Finish").alias("last_2"),
        F.col("Last T3 Finish").alias("last_3"), F.col("Month").alias("month"), F.col("Previous_Year_Position").alias("previous"),
        F.col("Days_Since_Last_Tournament").alias("days"), *[F.col(c).alias(c.lower()) for c in ("R1", "R2", "R3", "R4")],
    )


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Selection exported as CSV with a header and read back with its schema."""
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    t.write_table(df, path, "csv")
    return t.read_csv(spark, path, df.schema)


@query("SELECT c_custkey, c_acctbal + 1 AS score FROM customer")
def snapshot_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Two days of forecasts, the second written twice; the newest is read back by its partition."""
    df = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("score"))
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    t.write_snapshot(df, path, "2025-05-28")
    t.write_snapshot(df, path, "2025-06-04")
    t.write_snapshot(df.withColumn("score", F.col("score") + 1), path, "2025-06-04")
    return t.read_snapshot(spark, path).select("c_custkey", "score")


@query("SELECT c_custkey, c_acctbal AS score FROM customer")
def active_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The active forecast, replaced as a whole."""
    df = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("score"))
    path = f"{shared_folder(spark)}/active-{uuid.uuid4().hex}"
    t.write_active(df.limit(0), path)
    t.write_active(df, path)
    return t.read_table(spark, path, ["c_custkey", "score"])


@query("SELECT c_custkey, -c_acctbal AS score FROM customer")
def switched_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The active forecast after two switches: the second one is read, though the first is still there."""
    df = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("score"))
    path = f"{shared_folder(spark)}/switched-{uuid.uuid4().hex}"
    t.switch_active(df, path)
    t.switch_active(df.withColumn("score", -F.col("score")), path)
    return t.read_active(spark, path, ["c_custkey", "score"])


@query(
    """SELECT c_custkey, c_name, c_acctbal, NULL::VARCHAR AS line FROM customer
UNION ALL SELECT NULL, NULL, NULL, line FROM (VALUES ('1,one cell too few'), ('2,name,1.5,one cell too many'), ('three,name,1.5'), ('4,name,much')) AS bad(line)"""
)
def damaged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV export with four damaged lines: the good rows, and the lines that were put aside."""
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = f"{shared_folder(spark)}/damaged-{uuid.uuid4().hex}"
    t.write_table(df, path, "csv")
    lines = ["c_custkey,c_name,c_acctbal", "1,one cell too few", "2,name,1.5,one cell too many", "three,name,1.5", "4,name,much"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("append").text(path)
    found = t.read_csv_checked(spark, path, df.schema)
    return found.rows.withColumn("line", F.lit(None).cast("string")).unionByName(found.rejects, allowMissingColumns=True)


@query("SELECT o_orderkey, o_orderdate::DATE AS d FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return t.preview(table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.to_date("o_orderdate").alias("d"))
