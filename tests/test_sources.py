import pytest
from pyspark.sql import functions as F

from fieldbook import schema
from fieldbook.plans import results as plan
from fieldbook.sources import pages as p
from fieldbook.sources import tables as t

HEAD = (
    '<h1 class="headline headline__h1 Leaderboard__Event__Title"> The <b>Open</b> &amp; Co </h1>'
    '<span class="Leaderboard__Event__Date n7">January 16 - 19, 2025</span>'
)
FALLBACK = '<div class="Leaderboard__Course__Location n8 clr-gray-04">Links - Dublin, OH</div>'


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


BOARD = (
    '<tbody class="Table__TBODY">' + row("a") + '</tbody><TBODY class="Table__TBODY x">'
    + row("", "T1", '<a href="/p">Jos&eacute; A</a>', "-3", "70", "71", "69", "70", "280", "$1,000", "100")
    + row("", "2", "B", "E", "70", "71", "69", "70") + row("", "3", "C", "E", "70", "71", "69", "70", "x", "$5") + row("", "4", "D", "E", "70", "71", "69")
    + "</TBODY>"
)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u?tournamentId=7", HEAD + FALLBACK + BOARD), (2, "u", "<p>no tables</p>"), (3, "u", "<tbody>" + row("x", "Solo") + "</tbody>"), (4, "u", None)]
    return spark.createDataFrame(rows, schema.PAGES)


def test_boards_come_from_the_largest_table(pages):
    got = p.extract_boards(pages).orderBy("row_no").collect()
    assert [(x["Position"], x["Player"], x["Total"], x["Winnings"], x["FedEx"]) for x in got] == [
        ("T1", "José A", "280", "$1,000", "100"),
        ("2", "B", None, None, None),
        ("3", "C", "x", "$5", None),
    ]


def test_boards_from_all_tables_and_by_class(pages):
    everything = p.extract_boards(pages, pick="all", min_cells=1, markup=p.Markup(block_class="Table__TBODY"))
    assert everything.count() == 5
    with pytest.raises(ValueError, match="pick"):
        p.page_rows(pages, pick="first")


def test_heads_and_field(pages):
    heads = {x["page_id"]: x for x in p.extract_event(pages).collect()}
    assert (heads[1]["Tournament"], heads[1]["Date"], heads[1]["Location"]) == ("The Open & Co", "January 16 - 19, 2025", "Links - Dublin, OH")
    assert heads[2]["Tournament"] is None and heads[4]["Location"] is None
    assert [x["Player"] for x in p.extract_field(pages).filter("page_id = 3").collect()] == ["Solo"]
    field = plan.upcoming_field(pages.filter("page_id = 1")).collect()
    assert {(x["Tournament"], x["Year"], str(x["Final_Date"])) for x in field} == {("The Open & Co", 2025, "2025-01-19")}


def test_schedule_needs_every_part(spark):
    link = '<a href="/x?tournamentId={}" class="eventAndLocation__tournamentLink">Event {}</a>'
    place = '<div class="big eventAndLocation__tournamentLocation">Kapalua, HI</div>'
    html = (
        f'<tr><td class="dateRange__col">Jan 2 - 5</td><td>{link.format(1, 1)}{place}</td></tr>'
        f'<tr><td class="dateAndTickets__col"> Jan 9 - 12 </td><td>{link.format(2, 2)}{place}</td></tr>'
        f"<tr><td>{link.format(3, 3)}{place}</td></tr><tr><td class='dateRange__col'>Feb 1 - 2</td><td>{link.format(4, 4)}</td></tr><tr><td>none</td></tr>"
    )
    got = p.extract_schedule(spark.createDataFrame([(1, "u", html)], schema.PAGES)).orderBy("tournament_id").collect()
    assert [tuple(x)[1:] for x in got] == [("1", "Kapalua, HI", "Event 1", "Jan 2 - 5"), ("2", "Kapalua, HI", "Event 2", "Jan 9 - 12")]


def test_cleaning_drops_and_renames(spark):
    base = {"Location": "L - Dublin, OH", "Year": 2025, "Date": "Jan 2 - 5", "Position": "T2", "Player": "P", "R1": "70"}
    variants = [{}, {}, {"Tournament": "Presidents Cup"}, {"Player": ""}, {"R1": None}, {"Date": "Jan 5"}, {"Position": "CUT", "Player": "Q"}, {"Position": "-", "Player": "R"}]
    columns = ["Tournament", "Location", "Year", "Date", *schema.BOARD_COLUMNS]
    rows = [tuple({"Tournament": "Sentry Tournament of Champions", **base, **v}.get(c) for c in columns) for v in variants]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` {'int' if c == 'Year' else 'string'}" for c in columns))
    got = {x["Player"]: x for x in plan.clean_results(raw).collect()}
    assert set(got) == {"P", "Q", "R"}
    assert got["P"]["Tournament"] == "The Sentry" and got["P"]["Position"] == 2.0
    assert got["Q"]["Position"] is None and got["R"]["Position"] == -1.0
    assert [tuple(x) for x in plan.rejected_positions(raw).collect()] == [("CUT", 1)]


def test_missing_and_malformed_files(spark, tmp_path):
    with pytest.raises(t.SourceError, match="file not found: /no/such"):
        t.read_csv(spark, "/no/such/file.csv", schema.FORECAST)
    with pytest.raises(t.SourceError, match="file not found"):
        t.read_table(spark, str(tmp_path / "none"))
    bad = tmp_path / "bad.csv"
    bad.write_text("Player,Predicted_Position,Normalized_Predictions\nA,1.5,1\nB,not a number,2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        t.read_csv(spark, str(bad), schema.FORECAST).collect()
    assert t.read_csv(spark, str(bad), schema.FORECAST, strict=False).count() == 2


def test_snapshots_replace_their_own_day_only(spark, tmp_path):
    path = str(tmp_path / "forecasts")
    df = spark.createDataFrame([("a", 1.0)], "Player string, Preds double")
    t.write_snapshot(df, path, "2025-05-28")
    t.write_snapshot(df.withColumn("Preds", F.lit(2.0)), path, "2025-06-04")
    t.write_snapshot(df.withColumn("Preds", F.lit(3.0)), path, "2025-06-04")
    assert t.read_snapshot(spark, path, "2025-05-28").first()["Preds"] == 1.0
    assert [x["Preds"] for x in t.read_snapshot(spark, path).collect()] == [3.0]
    t.write_snapshot(df, path)
    assert t.read_table(spark, path).select("run_date").distinct().count() == 3


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1.5, 1), (None, None, None)], schema.FORECAST)
    t.write_table(df, str(tmp_path / "out"), "csv")
    assert t.read_csv(spark, str(tmp_path / "out"), schema.FORECAST).exceptAll(df).isEmpty()


def test_schedule_pages_are_searched_once_and_spread(spark):
    from fieldbook.catalog import base

    page = '<tr><td class="dateRange__col">Jan 2 - 5</td><td><a href="?tournamentId=7" class="eventAndLocation__tournamentLink">A &amp; B</a><p class="eventAndLocation__tournamentLocation">OH</p></td></tr>'
    df = spark.createDataFrame([(1, "u", page), (2, "u", page.replace("dateRange__col", "x")), (3, "u", page + page)], "page_id long, url string, html string")
    rows = p.extract_schedule(df)
    assert sorted(r["page_id"] for r in rows.collect()) == [1, 3, 3]
    assert {tuple(r)[1:] for r in rows.collect()} == {("7", "OH", "A & B", "Jan 2 - 5")}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "tournamentLocation" in line]
    assert base.spread(spark.range(95).coalesce(1), "id", 10).rdd.getNumPartitions() == 10


def test_ingest_reads_board_pages_once(spark):
    boards = spark.createDataFrame([(1, "/leaderboard?tournamentId=7", BOARD), (2, "/leaderboard", BOARD)], "page_id long, url string, html string")
    schedule = spark.createDataFrame(
        [(5, "/season/2024", '<tr><td class="dateRange__col">Jan 2 - 5</td><td><a href="?tournamentId=7" class="eventAndLocation__tournamentLink">A</a><p class="eventAndLocation__tournamentLocation">OH</p></td></tr>')],
        "page_id long, url string, html string",
    )
    raw = plan.ingest(schedule, boards, 2025)
    got = raw.collect()
    assert {(r["Tournament"], r["Location"], r["Year"], r["Date"]) for r in got} == {("A", "OH", 2024, "Jan 2 - 5")}
    assert sorted(r["Player"] for r in got) == ["B", "C", "José A"]
    assert raw._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
