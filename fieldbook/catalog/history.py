"""Queries over history features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.catalog.base import ENTITY, ORDER, PANEL_SQL, ROUNDS_SQL, panel, query, round_all, scored_panel, table
from fieldbook.functions.numeric import row_mean, row_std
from fieldbook.operators import history as h
from fieldbook.operators.relational import fill_missed, missed_position, previous_edition, with_group_value, with_table_value
from fieldbook.operators.segments import running_totals

W = "OVER (PARTITION BY player ORDER BY d, k)"


def _frame(start: str, end: str) -> str:
    return f"OVER (PARTITION BY player ORDER BY d, k ROWS BETWEEN {start} AND {end})"


def _incl(width: int) -> str:
    return _frame(f"{width - 1} PRECEDING", "CURRENT ROW")


def _excl(width: int) -> str:
    return _frame(f"{width} PRECEDING", "1 PRECEDING")


_STREAK_SQL = f"""
numbered AS (SELECT *, row_number() {W} AS rn FROM panel),
streaks AS (
  SELECT k, CAST(rn - 1 - coalesce(max(CASE WHEN position = -1 THEN rn END)
    OVER (PARTITION BY player ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cut_streak
  FROM numbered
)"""

_TREND_SQL = """
last_five AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY d DESC, k DESC) AS age FROM panel),
trends AS (
  SELECT player, CASE WHEN count(*) = 5 THEN regr_slope(position, -age) END AS trend
  FROM last_five WHERE age <= 5 GROUP BY player
)"""


@query(
    f"""WITH {PANEL_SQL}, {_STREAK_SQL}
SELECT player, k, lag(position, 1) {W} AS last_1, date_diff('day', lag(d) {W}, d)::INT AS days_since,
       round(avg(position) {_excl(5)}, 6) AS mean_5, round(avg(CASE WHEN position = 1 THEN 1.0 ELSE 0.0 END) {_excl(10)}, 6) AS win_ratio_10,
       cut_streak
FROM panel JOIN streaks USING (k)"""
)
def form_before_event(spark: SparkSession, folder: str) -> DataFrame:
    """The form of each player before each event, in one pass."""
    wanted = [
        h.previous("last_1", "position"),
        h.days_since_previous("days_since", "d"),
        h.rolling_mean("mean_5", "position", 5, "excl"),
        h.rolling_ratio("win_ratio_10", F.col("position") == 1, 10, "excl"),
        h.Streak("cut_streak", F.col("position") == -1),
    ]
    df = h.add_history(panel(spark, folder), ENTITY, ORDER, wanted)
    return round_all(df, ["mean_5", "win_ratio_10"]).select("player", "k", *[f.name for f in wanted])


@query(f"WITH {PANEL_SQL} SELECT player, k, lag(position, 1) {W} AS last_1, lag(position, 2) {W} AS last_2, lag(position, 3) {W} AS last_3 FROM panel")
def last_finishes(spark: SparkSession, folder: str) -> DataFrame:
    wanted = [h.previous(f"last_{i}", "position", i) for i in (1, 2, 3)]
    return h.add_history(panel(spark, folder), ENTITY, ORDER, wanted).select("player", "k", "last_1", "last_2", "last_3")


@query(f"WITH {PANEL_SQL} SELECT player, k, date_diff('day', lag(d) {W}, d)::INT AS days_since FROM panel")
def days_since_last(spark: SparkSession, folder: str) -> DataFrame:
    return h.add_history(panel(spark, folder), ENTITY, ORDER, [h.days_since_previous("days_since", "d")]).select("player", "k", "days_since")


_EVENTS = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {} AND {})"


def _series_sql(widths: tuple[int, ...], incl: bool) -> str:
    cells = []
    for w in widths:
        over = _EVENTS.format(f"{w - 1} PRECEDING", "CURRENT ROW") if incl else _EVENTS.format(f"{w} PRECEDING", "1 PRECEDING")
        cells += [f"round(avg(value) {over}, 5) AS mean_{w}", f"round(stddev_samp(value) {over}, 5) AS std_{w}"]
    return f"SELECT event_id, {', '.join(cells)} FROM events"


def _series(spark: SparkSession, folder: str, widths: tuple[int, ...], frame: str) -> DataFrame:
    wanted = [f for w in widths for f in (h.rolling_mean(f"mean_{w}", "value", w, frame), h.rolling_std(f"std_{w}", "value", w, frame))]
    names = [f.name for f in wanted]
    df = h.add_history(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], wanted)
    return round_all(df, names, 5).select("event_id", *names)


@query(_series_sql((2, 3, 5, 7, 10), True))
def rolling_incl(spark: SparkSession, folder: str) -> DataFrame:
    return _series(spark, folder, (2, 3, 5, 7, 10), "incl")


@query(_series_sql((2, 3, 5), False))
def rolling_excl(spark: SparkSession, folder: str) -> DataFrame:
    return _series(spark, folder, (2, 3, 5), "excl")


@query(
    f"WITH {PANEL_SQL} SELECT player, k, "
    + ", ".join(f"round(avg(to_par) {_incl(w)}, 6) AS incl_{w}, round(avg(to_par) {_excl(w)}, 6) AS excl_{w}" for w in (2, 3, 5))
    + " FROM panel"
)
def rolling_to_par(spark: SparkSession, folder: str) -> DataFrame:
    wanted = [h.rolling_mean(f"{f}_{w}", "to_par", w, f) for w in (2, 3, 5) for f in ("incl", "excl")]
    names = [f.name for f in wanted]
    return round_all(h.add_history(panel(spark, folder), ENTITY, ORDER, wanted), names).select("player", "k", *names)


@query(
    f"""WITH {PANEL_SQL} SELECT player, k, round(avg(position) {_incl(5)} - avg(position) {_incl(10)}, 6) AS momentum_5,
    round(avg(position) {_incl(3)} - avg(position) {_incl(5)}, 6) AS momentum_3 FROM panel"""
)
def momentum(spark: SparkSession, folder: str) -> DataFrame:
    df = h.add_history(panel(spark, folder), ENTITY, ORDER, [h.rolling_mean(f"m{w}", "position", w) for w in (3, 5, 10)])
    momenta = {"momentum_5": F.col("m5") - F.col("m10"), "momentum_3": F.col("m3") - F.col("m5")}
    return round_all(df.withColumns(momenta), list(momenta)).select("player", "k", *momenta)


@query(f"WITH {PANEL_SQL} SELECT player, k, CAST(sum(CASE WHEN position <> -1 THEN 1 ELSE 0 END) {_incl(5)} AS DOUBLE) AS cuts_5 FROM panel")
def cut_count_5(spark: SparkSession, folder: str) -> DataFrame:
    made = (F.col("position") != -1).cast("double")
    return h.add_history(panel(spark, folder), ENTITY, ORDER, [h.rolling_sum("cuts_5", made, 5)]).select("player", "k", "cuts_5")


@query(f"WITH {PANEL_SQL}, {_STREAK_SQL} SELECT player, k, cut_streak FROM panel JOIN streaks USING (k)")
def cut_streak(spark: SparkSession, folder: str) -> DataFrame:
    return h.add_history(panel(spark, folder), ENTITY, ORDER, [h.Streak("cut_streak", F.col("position") == -1)]).select("player", "k", "cut_streak")


def _ratio_sql(frame) -> str:
    cells = [
        f"round(avg(CASE WHEN position {cond} THEN 1.0 ELSE 0.0 END) {frame(w)}, 6) AS {stem}_{w}"
        for stem, cond in (("win", "= 1"), ("top10", "<= 10"))
        for w in (5, 10, 20)
    ]
    return f"WITH {PANEL_SQL} SELECT player, k, {', '.join(cells)} FROM panel"


def _ratios(spark: SparkSession, folder: str, frame: str) -> DataFrame:
    conditions = {"win": F.col("position") == 1, "top10": F.col("position") <= 10}
    wanted = [h.rolling_ratio(f"{stem}_{w}", c, w, frame) for stem, c in conditions.items() for w in (5, 10, 20)]
    names = [f.name for f in wanted]
    return round_all(h.add_history(panel(spark, folder), ENTITY, ORDER, wanted), names).select("player", "k", *names)


@query(_ratio_sql(_incl))
def ratios_incl(spark: SparkSession, folder: str) -> DataFrame:
    return _ratios(spark, folder, "incl")


@query(_ratio_sql(_excl))
def ratios_excl(spark: SparkSession, folder: str) -> DataFrame:
    return _ratios(spark, folder, "excl")


_AHEAD = _frame("CURRENT ROW", "2 FOLLOWING")
_HALVES_SQL = """halves AS (SELECT *,
  CASE WHEN r1 IS NULL THEN r2 WHEN r2 IS NULL THEN r1 ELSE (r1 + r2) / 2 END AS early,
  CASE WHEN r3 IS NULL THEN r4 WHEN r4 IS NULL THEN r3 ELSE (r3 + r4) / 2 END AS late FROM scored)"""


@query(
    f"""WITH {ROUNDS_SQL}, {_HALVES_SQL}
SELECT player, k, round(avg(early) {_AHEAD}, 5) AS early_3, round(avg(late) {_AHEAD}, 5) AS late_3,
       round(avg(late) {_AHEAD} - avg(early) {_AHEAD}, 5) + 0.0 AS progression,
       {", ".join(f"round(lag(r{i}) {W}, 5) AS prior_r{i}" for i in range(1, 5))} FROM halves"""
)
def round_features(spark: SparkSession, folder: str) -> DataFrame:
    """Look-ahead round means, the rounds of the previous event, and the gain from early to late rounds."""
    df = scored_panel(spark, folder).withColumns({"early": row_mean(["r1", "r2"]), "late": row_mean(["r3", "r4"])})
    wanted = [
        h.rolling_mean("early_3", "early", 3, "lookahead"),
        h.rolling_mean("late_3", "late", 3, "lookahead"),
        *[h.previous(f"prior_r{i}", f"r{i}") for i in range(1, 5)],
    ]
    df = h.add_history(df, ENTITY, ORDER, wanted).withColumn("progression", F.col("late_3") - F.col("early_3"))
    names = [*[f.name for f in wanted], "progression"]
    return round_all(df, names, 5).select("player", "k", *names)


@query(f"WITH {PANEL_SQL}, {_TREND_SQL} SELECT p.player, p.k, round(trend, 6) + 0.0 AS trend FROM panel p JOIN trends USING (player)")
def closing_trend(spark: SparkSession, folder: str) -> DataFrame:
    df = h.add_history(panel(spark, folder), ENTITY, ORDER, [h.ClosingTrend("trend", "position")])
    return round_all(df, ["trend"]).select("player", "k", "trend")


@query(
    f"""WITH {PANEL_SQL}, numbered AS (SELECT *, row_number() {W} AS rn FROM panel)
SELECT player, k, CASE WHEN rn >= 5 THEN round(regr_slope(position, rn) {_incl(5)}, 6) + 0.0 END AS trend FROM numbered"""
)
def trend_so_far(spark: SparkSession, folder: str) -> DataFrame:
    df = h.add_history(panel(spark, folder), ENTITY, ORDER, [h.trend_so_far("trend", "position")])
    return round_all(df, ["trend"]).select("player", "k", "trend")


@query(
    f"""WITH {ROUNDS_SQL}, {_HALVES_SQL}
SELECT player, k, round(lag(early) {W}, 5) AS early_prev, round(avg(early) {_frame("4 PRECEDING", "2 PRECEDING")}, 5) AS early_3 FROM halves"""
)
def early_rounds(spark: SparkSession, folder: str) -> DataFrame:
    df = scored_panel(spark, folder).withColumn("early", row_mean(["r1", "r2"]))
    wanted = [h.previous("early_prev", "early"), h.over_rows("early_3", F.avg("early"), -4, -2)]
    return round_all(h.add_history(df, ENTITY, ORDER, wanted), ["early_prev", "early_3"], 5).select("player", "k", "early_prev", "early_3")


@query(
    f"""WITH {ROUNDS_SQL}, {_HALVES_SQL},
shifted AS (SELECT *, lag(early) OVER (ORDER BY player, d, k) AS early_prev FROM halves)
SELECT player, k, round(early_prev, 5) AS early_prev, round(avg(early_prev) {_excl(3)}, 5) AS early_3 FROM shifted"""
)
def early_rounds_carried(spark: SparkSession, folder: str) -> DataFrame:
    """As ``early_rounds``, with the last event of the player sorted before carried into the first one."""
    from fieldbook.plans import features

    df = scored_panel(spark, folder).withColumn("early", row_mean(["r1", "r2"]))
    named = df.select(F.col("player").alias("Player"), F.col("d").alias("Final_Date"), F.lit("").alias("Tournament"), F.col("k").alias("Year"), "early")
    carried = features.add_carried_rounds(named, "early", carry_over=True)
    return carried.select(
        F.col("Player").alias("player"),
        F.col("Year").alias("k"),
        F.round("Early_Rounds_Avg", 5).alias("early_prev"),
        F.round("Last_3_Early_Rounds_Avg", 5).alias("early_3"),
    )


@query(
    f"""WITH {PANEL_SQL} SELECT player, k,
    CASE WHEN position = -1 THEN max(position) OVER (PARTITION BY year, event) + 1 ELSE position END AS placed FROM panel"""
)
def placed_missed_cuts(spark: SparkSession, folder: str) -> DataFrame:
    return missed_position(panel(spark, folder), ["year", "event"], "position", "placed").select("player", "k", "placed")


@query(f"WITH {PANEL_SQL} SELECT player, k, round(avg(to_par) OVER (PARTITION BY year, event), 6) AS field_mean FROM panel")
def event_mean(spark: SparkSession, folder: str) -> DataFrame:
    df = with_group_value(panel(spark, folder), ["year", "event"], {"field_mean": F.avg("to_par")})
    return round_all(df, ["field_mean"]).select("player", "k", "field_mean")


@query(
    f"""WITH {PANEL_SQL}, first AS (
  SELECT player, event, year + 1 AS year, position, row_number() OVER (PARTITION BY player, event, year ORDER BY d, k) AS n FROM panel)
SELECT p.player, p.k, coalesce(nullif(f.position, -1), 100.0) AS previous_edition
FROM panel p LEFT JOIN first f ON f.player = p.player AND f.event = p.event AND f.year = p.year AND f.n = 1"""
)
def previous_edition_finish(spark: SparkSession, folder: str) -> DataFrame:
    df = previous_edition(panel(spark, folder), "player", "event", "year", "position", ["d", "k"], "previous_edition")
    return df.select("player", "k", "previous_edition")


@query(
    f"""WITH {ROUNDS_SQL}, worst AS (SELECT coalesce(max(CASE WHEN position <> -1 THEN to_par END) + 5, 10) AS w FROM scored)
SELECT k, CASE WHEN position = -1 THEN 0.0 ELSE r3 END AS r3, CASE WHEN position = -1 THEN 0.0 ELSE r4 END AS r4,
       CASE WHEN position = -1 THEN (SELECT w FROM worst) ELSE to_par END AS to_par FROM scored"""
)
def filled_missed_cuts(spark: SparkSession, folder: str) -> DataFrame:
    return fill_missed(scored_panel(spark, folder), F.col("position") == -1, ["r3", "r4"], "to_par").select("k", "r3", "r4", "to_par")


@query(f"WITH {PANEL_SQL} SELECT k, position - (SELECT min(position) FROM panel WHERE position > 0) AS above_best FROM panel WHERE position > 0")
def above_global_min(spark: SparkSession, folder: str) -> DataFrame:
    finished = panel(spark, folder).filter(F.col("position") > 0)
    return with_table_value(finished, {"low": F.min("position")}).select("k", (F.col("position") - F.col("low")).alias("above_best"))


@query(
    f"""WITH {ROUNDS_SQL}, cells AS (SELECT k, unnest([r1, r2, r3, r4]) AS r FROM scored)
SELECT k, round(avg(r), 5) AS mean, round(stddev_samp(r), 5) AS std FROM cells GROUP BY k"""
)
def row_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and sample deviation over the columns of a row."""
    rounds = ["r1", "r2", "r3", "r4"]
    return scored_panel(spark, folder).select("k", F.round(row_mean(rounds), 5).alias("mean"), F.round(row_std(rounds), 5).alias("std"))


_NAMELESS_SQL = PANEL_SQL + """,
nameless AS (SELECT CASE WHEN k % 3 <> 0 THEN player END AS player, d, k, position, to_par FROM panel)"""


@query(
    f"""WITH {_NAMELESS_SQL} SELECT k, player, CASE WHEN player IS NOT NULL THEN lag(position) OVER w END AS last_1,
  CASE WHEN player IS NOT NULL THEN sum(to_par) OVER w END AS so_far, CASE WHEN player IS NOT NULL THEN row_number() OVER w END AS n
FROM nameless WINDOW w AS (PARTITION BY player ORDER BY d, k)"""
)
def kept_nameless(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the rows has no player: they stay, each without a history, and are no group of their own."""
    df = panel(spark, folder).withColumn("player", F.when(F.col("k") % 3 != 0, F.col("player"))).select("k", "player", "d", "position", "to_par")
    df = h.add_history(df, ENTITY, ORDER, [h.previous("last_1", "position")], keep_null=True)
    df = running_totals(df, ORDER, {"so_far": F.col("to_par"), "n": F.lit(1).cast("bigint")}, group=ENTITY)
    return df.select("k", "player", "last_1", "so_far", "n")
