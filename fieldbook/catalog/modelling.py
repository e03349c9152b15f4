"""Queries over feature tables, preparation, models and their quality."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.catalog.base import PANEL_SQL, ROUNDS_SQL, panel, query, round_all, scored_panel, table
from fieldbook.catalog.sources import FIRST_HISTORY_SQL, RESULTS_SQL, results
from fieldbook.functions.numeric import fold_of, held_out
from fieldbook.ml import linear, metrics, oversample, prep, trees
from fieldbook.ml.stacking import Stack, certified, fit_stack
from fieldbook.operators.history import add_history, rolling_mean
from fieldbook.operators.impute import FillRules, impute
from fieldbook.plans import features as feature_plan
from fieldbook.plans import forecast as forecast_plan
from fieldbook.plans.results import add_first_history, event_rows
from fieldbook.schema import FEATURES_A, FEATURES_B
from fieldbook.session import materialise

# --- feature tables ---------------------------------------------------------------------------

_BY = "PARTITION BY player ORDER BY d, tournament, year"


def _over(start: str, end: str) -> str:
    return f"OVER ({_BY} ROWS BETWEEN {start} AND {end})"


def _width(w: int, incl: bool) -> str:
    return _over(f"{w - 1} PRECEDING", "CURRENT ROW") if incl else _over(f"{w} PRECEDING", "1 PRECEDING")


def _form_sql(position: str, incl: bool) -> list[str]:
    cells = []
    for w in (2, 3, 5):
        over = _width(w, incl)
        cells += [
            f"avg({position}) {over} AS Position_ma_{w}",
            f"stddev_samp({position}) {over} AS Position_std_{w}",
            f"avg(to_par) {over} AS TOPAR_trend_{w}",
        ]
    for stem, cond in (("Win_Ratio", "position = 1"), ("Top10_Ratio", "position <= 10")):
        cells += [f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) {_width(w, incl)} AS {stem}_{w}" for w in (5, 10, 20)]
    return cells


_MEAN_SQL = "CASE WHEN {0} IS NULL THEN {1} WHEN {1} IS NULL THEN {0} ELSE ({0} + {1}) / 2 END"
_CLOSING_SQL = """
aged AS (SELECT player, {p} AS p, row_number() OVER (PARTITION BY player ORDER BY d DESC, tournament DESC, year DESC) AS age FROM {t}),
closing AS (SELECT player, CASE WHEN count(*) = 5 THEN regr_slope(p, -age) END AS Position_Trend FROM aged WHERE age <= 5 GROUP BY player)"""

_A_ORDER = [c for c in FEATURES_A if c != "Position_Trend"]
_FEATURES_A_SQL = f"""{RESULTS_SQL},
placed AS (SELECT *, CASE WHEN position = -1 THEN max(position) OVER (PARTITION BY tournament, year) + 1 ELSE position END AS np FROM results),
worst AS (SELECT max(to_par) FILTER (position <> -1) + 5 AS w FROM results),
filled AS (SELECT * REPLACE (CASE WHEN position = -1 THEN 0.0 ELSE r3 END AS r3, CASE WHEN position = -1 THEN 0.0 ELSE r4 END AS r4,
  CASE WHEN position = -1 THEN (SELECT w FROM worst) ELSE to_par END AS to_par) FROM placed),
halves AS (SELECT *, {_MEAN_SQL.format("r1", "r2")} AS early, {_MEAN_SQL.format("r3", "r4")} AS late FROM filled),
{_CLOSING_SQL.format(p="position", t="results")},
spread AS (SELECT player, tournament, year, stddev_samp(r) AS s FROM (SELECT player, tournament, year, unnest([r1, r2, r3, r4]) AS r FROM filled) GROUP BY ALL),
rolled AS (SELECT player, tournament, year, position, np, {", ".join(_form_sql("np", True))},
  avg(np) {_width(10, True)} AS ma_10, CAST(sum(CASE WHEN position <> -1 THEN 1 ELSE 0 END) {_width(5, True)} AS DOUBLE) AS Cut_streak,
  {", ".join(f"lag(r{i}) OVER ({_BY}) AS Prior_R{i}_Avg" for i in range(1, 5))},
  avg(early) {_over("CURRENT ROW", "2 FOLLOWING")} AS Last_3_Early_Rounds_Avg, avg(late) {_over("CURRENT ROW", "2 FOLLOWING")} AS Last_3_Late_Rounds_Avg
  FROM halves),
features AS (SELECT r.*, Position_Trend, Position_ma_5 - ma_10 AS Position_momentum_5, Position_ma_3 - Position_ma_5 AS Position_momentum_3,
  Last_3_Late_Rounds_Avg - Last_3_Early_Rounds_Avg AS Round_Progression, CASE WHEN position <> -1 THEN s END AS Score_Variance
  FROM rolled r JOIN closing USING (player) JOIN spread USING (player, tournament, year))"""


def _shown_sql(columns: list[str]) -> str:
    return ", ".join(f'round("{c}", 5) + 0.0 AS "{c}"' for c in columns)


@query(f"WITH {_FEATURES_A_SQL} SELECT player, tournament, year AS season, np, {_shown_sql(FEATURES_A)} FROM features")
def feature_table_a(spark: SparkSession, folder: str) -> DataFrame:
    df = feature_plan.features_a(materialise(results(spark, folder)))
    return round_all(df, FEATURES_A, 5).select(
        F.col("Player").alias("player"), F.col("Tournament").alias("tournament"), F.col("Year").alias("season"), F.col("Normalized_Position").alias("np"), *FEATURES_A
    )


_UPCOMING_SQL = "(tournament = 'Event 07' AND year = 2001)"


def _filled_sql(column: str) -> str:
    if feature_plan.RULES.is_zero(column):
        return f'round(coalesce("{column}", 0.0), 5) + 0.0 AS "{column}"'
    return f'round(coalesce("{column}", (SELECT quantile_cont("{column}", 0.5) FROM features WHERE NOT {_UPCOMING_SQL})), 5) + 0.0 AS "{column}"'


@query(f"WITH {_FEATURES_A_SQL} SELECT player, tournament, year AS season, {', '.join(_filled_sql(c) for c in FEATURES_A)} FROM features")
def filled_features_a(spark: SparkSession, folder: str) -> DataFrame:
    """Feature table A with gaps filled from the rows outside the upcoming event."""
    df = feature_plan.fill_a(materialise(feature_plan.features_a(materialise(results(spark, folder)))), event_rows("Event 07", 2001))
    return round_all(df, FEATURES_A, 5).select(F.col("Player").alias("player"), F.col("Tournament").alias("tournament"), F.col("Year").alias("season"), *FEATURES_A)


_FEATURES_B_SQL = f"""{RESULTS_SQL}, {FIRST_HISTORY_SQL},
recoded AS (SELECT * REPLACE (CASE WHEN position = -1 THEN 100.0 ELSE position END AS position, CASE WHEN last_1 = -1 THEN 100.0 ELSE last_1 END AS last_1,
  CASE WHEN last_2 = -1 THEN 100.0 ELSE last_2 END AS last_2, CASE WHEN last_3 = -1 THEN 100.0 ELSE last_3 END AS last_3) FROM history),
filled AS (SELECT * REPLACE (CASE WHEN position = 100 THEN (SELECT max(to_par) FILTER (position <> 100) + 5 FROM recoded) ELSE to_par END AS to_par,
  coalesce(last_2, (SELECT quantile_cont(last_2, 0.5) FROM recoded)) AS last_2, coalesce(last_3, (SELECT quantile_cont(last_3, 0.5) FROM recoded)) AS last_3),
  {_MEAN_SQL.format("r1", "r2")} AS early, row_number() OVER ({_BY}) AS rn FROM recoded),
{_CLOSING_SQL.format(p="position", t="recoded")},
rolled AS (SELECT player, tournament, position, rn, CAST(year AS DOUBLE) AS "Year", last_1 AS "Last T1 Finish", last_2 AS "Last T2 Finish", last_3 AS "Last T3 Finish",
  CAST(month AS DOUBLE) AS "Month", previous AS "Previous_Year_Position", CAST(days AS DOUBLE) AS "Days_Since_Last_Tournament", {", ".join(_form_sql("position", False))},
  CAST(rn - 1 - coalesce(max(CASE WHEN position = 100 THEN rn END) OVER (PARTITION BY player ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS Cut_streak,
  lag(early) OVER ({_BY}) AS Early_Rounds_Avg, avg(early) {_over("4 PRECEDING", "2 PRECEDING")} AS Last_3_Early_Rounds_Avg FROM filled),
features AS (SELECT r.*, Position_Trend, Position_ma_3 - Position_ma_5 AS Position_momentum_3 FROM rolled r JOIN closing USING (player) WHERE "Last T1 Finish" IS NOT NULL)"""


@query(f"WITH {_FEATURES_B_SQL} SELECT player, tournament, position, {_shown_sql(FEATURES_B)} FROM features")
def feature_table_b(spark: SparkSession, folder: str) -> DataFrame:
    df = feature_plan.features_b(materialise(add_first_history(materialise(results(spark, folder)))))
    return round_all(df, FEATURES_B, 5).select(F.col("Player").alias("player"), F.col("Tournament").alias("tournament"), F.col("Position").alias("position"), *FEATURES_B)


# --- preparation ------------------------------------------------------------------------------

_ROUNDS = ["r1", "r2", "r3", "r4"]


@query(f"WITH {ROUNDS_SQL} SELECT k, " + ", ".join(f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM scored)), 5) AS {c}" for c in _ROUNDS) + " FROM scored")
def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(impute(scored_panel(spark, folder), _ROUNDS), _ROUNDS, 5).select("k", *_ROUNDS)


@query(
    f"""WITH {ROUNDS_SQL} SELECT k, round(coalesce(r1, (SELECT quantile_cont(r1, 0.5) FROM scored WHERE year < 2000)), 5) AS r1, coalesce(r2, 0.0) AS r2,
    coalesce(r3, 0.0) AS r3 FROM scored"""
)
def impute_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Zero for a named column and a prefix, the median of the training years for the rest."""
    df = scored_panel(spark, folder)
    filled = impute(df, _ROUNDS[:3], FillRules(zero_columns=("r2",), zero_prefixes=("r3",)), fit_on=df.filter(F.col("year") < 2000))
    return filled.select("k", F.round("r1", 5).alias("r1"), "r2", "r3")


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) + 0.0 AS value, 0.0::DOUBLE AS constant FROM events")
def standardised(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", "value", F.lit(7.0).alias("constant"))
    return round_all(prep.standardise(df, ["value", "constant"]), ["value"]).select("event_id", "value", "constant")


@query(
    """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 1 AS component, round((1 + r) / 2, 5) AS ratio, round((1 + r) / 2, 5) AS cumulative, true AS kept FROM r
UNION ALL SELECT 2, round((1 - r) / 2, 5), 1.0::DOUBLE, (1 + r) / 2 <= 0.95 FROM r"""
)
def explained_variance(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice"]
    df = prep.standardise(table(spark, folder, "lineitem").select(*columns), columns)
    return round_all(prep.explained_variance(df, columns), ["ratio", "cumulative"], 5)


@query("SELECT o_orderkey AS k, CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM orders")
def shuffled_folds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), fold_of(F.col("o_orderkey"), 5).alias("fold"))


@query("SELECT o_orderkey AS k, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 300 AS test FROM orders")
def hold_out(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), held_out(F.col("o_orderkey"), 0.3).alias("test"))


@query("SELECT o_orderkey AS k, CAST(ntile(7) OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) - 1 AS INT) AS fold FROM orders")
def contiguous_folds(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return prep.contiguous_folds(df, ["o_custkey", "o_orderdate", "o_orderkey"], 7).select(F.col("o_orderkey").alias("k"), "fold")


@query(
    """SELECT count(*) FILTER (quality = 0) AS negatives, count(*) FILTER (quality = 1) AS positives,
    round(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1), 6) AS ratio, round_even(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1), 0) AS rounded FROM labels"""
)
def class_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(prep.class_ratio(table(spark, folder, "labels"), "quality"), ["ratio"])


@query("SELECT doc_id, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY quality)), 6) AS weight FROM labels")
def balanced_weights(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    return labels.select("doc_id", F.round(prep.balanced_weight(labels, "quality"), 6).alias("weight"))


# --- quality ----------------------------------------------------------------------------------

_PREDICTED_SQL = """predicted AS (SELECT event_type, event_id % 5 AS fold, value AS y,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p FROM events),
quality AS (SELECT event_type AS model, fold, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
  1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2 FROM predicted WHERE p IS NOT NULL GROUP BY ALL)"""


def _fold_quality(spark: SparkSession, folder: str) -> DataFrame:
    df = add_history(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], [rolling_mean("p", "value", 5, "excl")])
    named = df.select(F.col("event_type").alias("model"), (F.col("event_id") % 5).alias("fold"), F.col("value").alias("y"), "p")
    return metrics.regression_metrics(named, "y", "p", ["model", "fold"])


@query(f"WITH {_PREDICTED_SQL} SELECT model, fold, round(rmse, 5) AS rmse, round(mae, 5) AS mae, round(r2, 5) + 0.0 AS r2 FROM quality")
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(_fold_quality(spark, folder), ["rmse", "mae", "r2"], 5)


@query(f"WITH {_PREDICTED_SQL} SELECT model, round(avg(r2), 5) + 0.0 AS r2, round(avg(mae), 5) AS mae, round(avg(rmse), 5) AS rmse FROM quality GROUP BY model")
def mean_over_folds(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(metrics.mean_over_folds(_fold_quality(spark, folder)), ["rmse", "mae", "r2"], 5)


@query(
    f"""WITH {_PREDICTED_SQL} SELECT 'rmse' AS metric, printf('RMSE: %.2f (±%.2f)', avg(rmse), stddev_pop(rmse)) AS line FROM quality
UNION ALL SELECT 'mae', printf('MAE: %.2f (±%.2f)', avg(mae), stddev_pop(mae)) FROM quality
UNION ALL SELECT 'r2', printf('R²: %.3f (±%.3f)', avg(r2), stddev_pop(r2)) FROM quality"""
)
def metric_lines(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.metric_lines(_fold_quality(spark, folder))


def _lines_sql(place: int, block: str, where: str) -> str:
    parts = (("rmse", "RMSE", 2), ("mae", "MAE", 2), ("r2", "R²", 3))
    return " UNION ALL ".join(
        f"SELECT CAST({place} AS INT) AS place, '{block}' AS block, '{m}' AS metric, printf('{t}: %.{p}f (±%.{p}f)', avg({m}), stddev_pop({m})) AS line FROM quality WHERE {where}" for m, t, p in parts
    )


@query(f"WITH {_PREDICTED_SQL} {_lines_sql(0, 'Training', 'fold < 3')} UNION ALL {_lines_sql(1, 'Test', 'fold >= 3')}")
def metric_report(spark: SparkSession, folder: str) -> DataFrame:
    """The metric lines of the training folds and of the test folds."""
    quality = materialise(_fold_quality(spark, folder))
    return metrics.metric_report({"Training": quality.filter("fold < 3"), "Test": quality.filter("fold >= 3")})


_JUDGED_SQL = "judged AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) / CAST(n_chars + 2000 AS DOUBLE) AS p FROM labels JOIN documents USING (doc_id))"
_CURVE_SQL = f"""{_JUDGED_SQL}, points AS (SELECT p, sum(y) AS hits, count(*) AS rows FROM judged GROUP BY p),
sums AS (SELECT *, sum(hits) OVER (ORDER BY p DESC) AS tp, sum(rows) OVER (ORDER BY p DESC) AS n, (SELECT sum(y) FROM judged) AS positives FROM points),
curve AS (SELECT p AS threshold, tp / n AS precision, tp / positives AS recall,
  hits / positives * (tp / n + coalesce((tp - hits) / nullif(n - rows, 0), 1.0)) / 2 AS area FROM sums)"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    score = F.col("n_chars") / (F.col("n_chars") + 2000)
    return table(spark, folder, "labels").join(documents, "doc_id").select(F.col("quality").alias("y"), score.alias("p"))


@query(f"WITH {_CURVE_SQL} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(area, 6) AS area FROM curve")
def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(metrics.pr_curve(_judged(spark, folder), "y", "p"), ["precision", "recall", "area"])


@query(f"WITH {_CURVE_SQL} SELECT round(sum(area), 6) AS pr_auc FROM curve")
def pr_area(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(metrics.pr_area(_judged(spark, folder), "y", "p"), ["pr_auc"])


@query(
    f"""WITH {_JUDGED_SQL}, called AS (SELECT y, CAST(p >= 0.35 AS INT) AS c FROM judged),
classes AS (SELECT v AS class, count(*) FILTER (y = v AND c = v) AS h, count(*) FILTER (c = v) AS q, count(*) FILTER (y = v) AS s
  FROM called, (VALUES (0), (1)) AS t(v) GROUP BY v),
scores AS (SELECT CAST(class AS VARCHAR) AS class, coalesce(h / nullif(q, 0), 0.0) AS precision, coalesce(h / nullif(s, 0), 0.0) AS recall,
  coalesce(2 * h / nullif(q + s, 0), 0.0) AS f1, s AS support, h FROM classes)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM scores
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(h) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores"""
)
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    called = _judged(spark, folder).withColumn("c", (F.col("p") >= 0.35).cast("int"))
    return round_all(metrics.class_report(called, "y", "c"), ["precision", "recall", "f1"])


# --- linear models ----------------------------------------------------------------------------


_TWO_SQL = """given AS (SELECT l_quantity / 50 AS a, l_tax * 10 AS b, l_discount * 100 + l_quantity + 20 * l_tax AS y, l_orderkey % 5 AS fold FROM lineitem)"""
_FIT_SQL = f"""{_TWO_SQL},
sums AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab,
  covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_, var_pop(y) * count(*) AS yy FROM given),
solved AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM sums),
fit AS (SELECT *, yy - wa * ay - wb * by_ AS rest FROM solved)"""


def _two_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_quantity") / 50).alias("a"), (F.col("l_tax") * 10).alias("b"),
        (F.col("l_discount") * 100 + F.col("l_quantity") + 20 * F.col("l_tax")).alias("y"), (F.col("l_orderkey") % 5).alias("fold"),
    )


@query(
    f"""WITH {_FIT_SQL},
lines AS (
  SELECT 'intercept' AS feature, my - wa * ma - wb * mb AS c, sqrt(rest / (n - 3) * (1 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)) AS e FROM fit
  UNION ALL SELECT 'a', wa, sqrt(rest / (n - 3) * bb / det) FROM fit UNION ALL SELECT 'b', wb, sqrt(rest / (n - 3) * aa / det) FROM fit)
SELECT feature, round(c, 6) AS coefficient, round(e, 6) AS std_error, round(c / e, 3) AS t_value, abs(c / e) > 1.8811 AS significant FROM lines"""
)
def least_squares(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of two features with their errors; the bound of the SQL is the t of the level for many rows."""
    found = linear.least_squares(_two_features(spark, folder), ["a", "b"], "y")
    named = found.select("feature", "coefficient", "std_error", F.round("t_value", 3).alias("t_value"), "significant")
    return round_all(named, ["coefficient", "std_error"])


@query(
    f"""WITH {_FIT_SQL}
SELECT n, CAST(2 AS INT) AS features, round(1 - rest / yy, 6) AS r2, round(1 - rest / yy * (n - 1) / (n - 3), 6) AS adjusted_r2,
  round((yy - rest) / 2 / (rest / (n - 3)), 2) AS f_value, round(sqrt(rest / (n - 3)), 6) AS residual_error FROM fit"""
)
def least_squares_fit(spark: SparkSession, folder: str) -> DataFrame:
    """How well two features explain the label: the summary of the fit."""
    found = linear.fit_summary(_two_features(spark, folder), ["a", "b"], "y")
    return round_all(round_all(found, ["r2", "adjusted_r2", "residual_error"]), ["f_value"], 2)


# Two weights: the solution has one of nine patterns of signs, and is that of the least penalised error among those which agree with their signs.
_GRID_SQL = f"""WITH {_TWO_SQL},
folds AS (SELECT DISTINCT fold AS held FROM given),
trained AS (SELECT held, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab,
  covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_ FROM given JOIN folds ON fold <> held GROUP BY held),
tested AS (SELECT fold AS held, avg(a) AS ta, avg(b) AS tb, avg(y) AS ty, var_pop(a) AS vaa, var_pop(b) AS vbb, covar_pop(a, b) AS vab,
  covar_pop(a, y) AS vay, covar_pop(b, y) AS vby, var_pop(y) AS vyy FROM given GROUP BY fold),
settings AS (SELECT model, CAST(alpha AS DOUBLE) AS alpha FROM (VALUES ('ridge'), ('lasso'), ('elastic')) AS m(model), (VALUES (0.01), (0.1), (1.0), (10.0)) AS s(alpha)),
posed AS (SELECT t.*, model, alpha, CASE model WHEN 'ridge' THEN 0 WHEN 'lasso' THEN n * alpha ELSE n * alpha * 0.5 END AS l1,
  CASE model WHEN 'ridge' THEN alpha WHEN 'lasso' THEN 0 ELSE n * alpha * 0.5 END AS l2 FROM trained t, settings),
tried AS (SELECT *, aa + l2 AS ha, bb + l2 AS hb, ay - l1 * sa AS ra, by_ - l1 * sb AS rb FROM posed, (VALUES (-1), (0), (1)) AS p(sa), (VALUES (-1), (0), (1)) AS q(sb)),
weighed AS (SELECT *, CASE WHEN sa = 0 THEN 0 WHEN sb = 0 THEN ra / ha ELSE (ra * hb - rb * ab) / (ha * hb - ab * ab) END AS wa,
  CASE WHEN sb = 0 THEN 0 WHEN sa = 0 THEN rb / hb ELSE (rb * ha - ra * ab) / (ha * hb - ab * ab) END AS wb FROM tried),
best AS (SELECT held, model, alpha, arg_min(wa, cost) AS wa, arg_min(wb, cost) AS wb, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my
  FROM (SELECT *, (ha * wa * wa + 2 * ab * wa * wb + hb * wb * wb) / 2 - ay * wa - by_ * wb + l1 * (abs(wa) + abs(wb)) AS cost FROM weighed WHERE wa * sa >= 0 AND wb * sb >= 0)
  GROUP BY held, model, alpha),
errors AS (SELECT model, alpha, vyy + wa * wa * vaa + wb * wb * vbb + 2 * wa * wb * vab - 2 * wa * vay - 2 * wb * vby
  + pow(ty - my - wa * (ta - ma) - wb * (tb - mb), 2) AS mse FROM best JOIN tested USING (held))
SELECT model, alpha, round(avg(mse), 4) AS mse FROM errors GROUP BY model, alpha"""


@query(_GRID_SQL)
def penalty_grids(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge, lasso and elastic-net grids of two features with five folds, from one scan."""
    sums = linear.moments(_two_features(spark, folder), ["a", "b"], "y", "fold")
    alphas = (0.01, 0.1, 1.0, 10.0)
    grids = {"ridge": linear.ridge_grid(alphas), "lasso": linear.lasso_grid(alphas), "elastic": [linear.Penalty(a, 0.5) for a in alphas]}
    rows = [(name, a, mse) for name, grid in grids.items() for a, _, mse in linear.search_moments(sums, ["a", "b"], grid).table]
    return round_all(spark.createDataFrame(rows, "model string, alpha double, mse double"), ["mse"], 4)


def _features_b(spark: SparkSession, folder: str) -> DataFrame:
    return feature_plan.features_b(materialise(add_first_history(materialise(results(spark, folder)))))


@query()
def linear_study(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge, lasso and elastic net on feature table B, with their errors on held-out rows."""
    model_table = forecast_plan.model_table(_features_b(spark, folder), event_rows("Event 07", 2001))
    return forecast_plan.linear_study(model_table).results


@query()
def upcoming_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Upcoming rows scored with the best ridge model, rounded, best first."""
    model_table = forecast_plan.model_table(_features_b(spark, folder), event_rows("Event 07", 2001))
    learn = prep.contiguous_folds(model_table.train, [forecast_plan.KEY], 5, "cv")
    best = linear.grid_search(learn, model_table.features, "Position", "cv", linear.ridge_grid())
    return forecast_plan.score_upcoming(model_table, best.model)


# --- trees, oversampling, stacking --------------------------------------------------------------
# All with the published numbers of trees, settings and folds, which are the defaults of the plans.


@query()
def position_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The race on feature table A in five folds, and its forecast of the upcoming event."""
    df = feature_plan.features_a(materialise(results(spark, folder)))
    return forecast_plan.forecast_positions(df, event_rows("Event 07", 2001)).forecast


def _fold_sql(key: str, folds: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {folds} AS INT)"


STEPS = ["year", "event", "to_par"]


def _stumps() -> dict:
    """A tree of one split over features of at most 32 values is the best of all splits, which SQL can search, too."""
    return {"forest": trees.forest_regressor(1, 1, 2).setBootstrap(False), "boosted": trees.boosted_regressor(2, 1)}


def _best_split_sql(name: str, label: str, source: str) -> str:
    """Per held-out fold the split that explains most of ``label`` in ``source``, and the means on its sides."""
    return f"""{name}_cells AS (SELECT held, feature, v, count(*) AS n, sum({label}) AS s
  FROM {source}, LATERAL (SELECT unnest({STEPS}) AS feature, unnest([CAST(year AS DOUBLE), CAST(event AS DOUBLE), to_par]) AS v) WHERE fold <> held GROUP BY ALL),
{name}_sums AS (SELECT held, feature, v, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER a AS n, sum(s) OVER a AS s FROM {name}_cells
  WINDOW w AS (PARTITION BY held, feature ORDER BY v), a AS (PARTITION BY held, feature)),
{name} AS (SELECT held, arg_max(feature, gain) AS feature, arg_max(v, gain) AS v, arg_max(sl / nl, gain) AS low, arg_max((s - sl) / (n - nl), gain) AS high
  FROM (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) AS gain FROM {name}_sums WHERE nl < n) GROUP BY held)"""


def _side_sql(name: str) -> str:
    return f"CASE WHEN (CASE {name}.feature WHEN 'year' THEN year WHEN 'event' THEN event ELSE to_par END) <= {name}.v THEN {name}.low ELSE {name}.high END"


_STUMPS_SQL = f"""{PANEL_SQL}, given AS (SELECT year, event, to_par, 2 * to_par + event + position / 10 AS y, {_fold_sql("k", 3)} AS fold FROM panel),
rows_ AS (SELECT given.*, held FROM given, (SELECT DISTINCT fold AS held FROM given)),
{_best_split_sql("one", "y", "rows_")},
once AS (SELECT rows_.*, {_side_sql("one")} AS f FROM rows_ JOIN one USING (held)),
{_best_split_sql("two", "2 * (y - f)", "once")},
twice AS (SELECT once.*, f + 0.05 * ({_side_sql("two")}) AS g FROM once JOIN two USING (held))"""


def _stump_rows(spark: SparkSession, folder: str) -> DataFrame:
    label = 2 * F.col("to_par") + F.col("event") + F.col("position") / 10
    df = panel(spark, folder).withColumn("fold", fold_of(F.col("k"), 3)).withColumn("label", label)
    return forecast_plan.with_features(df, STEPS)


@query(
    f"""WITH {_STUMPS_SQL}, scored AS (SELECT 'forest' AS model, fold, y, f AS p FROM twice WHERE fold = held UNION ALL SELECT 'boosted', fold, y, g FROM twice WHERE fold = held)
SELECT model, fold, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS r2
FROM scored GROUP BY model, fold"""
)
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """A forest of one split and a boosting of two, measured on every fold that they have not seen."""
    compared = trees.compare(_stump_rows(spark, folder).select("features", "label", "fold"), _stumps(), "fold")
    return round_all(compared.select("model", "fold", "rmse", "mae", "r2"), ["rmse", "mae", "r2"])


@query(
    f"""WITH {_STUMPS_SQL}, errors AS (SELECT sqrt(avg(a)) AS forest, sqrt(avg(b)) AS boosted FROM (
  SELECT fold, avg((y - f) * (y - f)) AS a, avg((y - g) * (y - g)) AS b FROM twice WHERE fold = held GROUP BY fold))
SELECT model, round(rmse, 6) AS rmse, rmse = min(rmse) OVER () AS best FROM (SELECT 'forest' AS model, forest AS rmse FROM errors UNION ALL SELECT 'boosted', boosted FROM errors)"""
)
def model_race(spark: SparkSession, folder: str) -> DataFrame:
    """The race between both: their cross-validated errors, and which of them wins."""
    won = trees.race(_stump_rows(spark, folder).select("features", "label", "fold"), _stumps(), "fold")
    rows = [(name, rmse, name == won.best) for name, rmse in won.rmse.items()]
    return round_all(spark.createDataFrame(rows, "model string, rmse double, best boolean"), ["rmse"])


@query(
    f"""WITH {PANEL_SQL}, rows_ AS (SELECT year, event, to_par, 2 * to_par + event + position / 10 AS y, 0 AS fold, 1 AS held FROM panel), {_best_split_sql("one", "y", "rows_")}
SELECT f.feature, CASE WHEN f.feature = one.feature THEN 1.0 ELSE 0.0 END::DOUBLE AS importance FROM one, (SELECT unnest({STEPS}) AS feature) f"""
)
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Importances of a forest of one split: all of it falls to the feature that explains most."""
    df = _stump_rows(spark, folder)
    return trees.importances(df, _stumps()["forest"].fit(df), STEPS)


def _label_vectors(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    words = F.size(F.split("text", r"\s+"))
    shares = [F.col("n_chars") / 10000.0, words / 2000.0, F.col("n_chars") / F.greatest(words, F.lit(1)) / 10.0]
    df = table(spark, folder, "labels").join(documents, "doc_id").select("doc_id", F.array(*shares).alias("vec"), "quality")
    return df.withColumn("fold", fold_of(F.col("doc_id"), 5))


@query(
    """WITH n AS (SELECT count(*) FILTER (quality = 0) AS a, count(*) FILTER (quality = 1) AS b FROM labels JOIN documents USING (doc_id))
SELECT CAST(0 AS INT) AS label, false AS synthetic, a AS n FROM n UNION ALL SELECT 1, false, b FROM n
UNION ALL SELECT CASE WHEN a < b THEN 0 ELSE 1 END, true, abs(a - b) FROM n"""
)
def oversampled(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per class after oversampling: both classes end equal."""
    made = oversample.smote(_label_vectors(spark, folder), "vec", "quality", "doc_id")
    return made.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id, list_distance(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e)) AS n
  FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(n AS INT) AS place, round(d, 5) AS distance FROM pairs WHERE n <= 5"""
)
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Distances to the five nearest other vectors, found block by block."""
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    near = oversample.nearest_neighbours(vectors, "e", 5, block_rows=128).select(F.col("vec").alias("e"), F.posexplode("neighbours").alias("n", "other"))
    squares = F.aggregate(F.zip_with("e", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.join(near, "e").select("vec_id", (F.col("n") + 1).alias("place"), F.round(F.sqrt(squares), 5).alias("distance"))


@query()
def tuned_classifiers(spark: SparkSession, folder: str) -> DataFrame:
    """F1 of each of the forest's and the boosting's grid settings on oversampled, weighted rows in five folds."""
    rows = oversample.smote(_label_vectors(spark, folder), "vec", "quality", "doc_id").withColumn("features", array_to_vector("vec"))
    rows = rows.withColumn("fold", fold_of(F.col("vec").cast("string"), 5)).withColumn("label", F.col("label").cast("double"))
    rows = materialise(rows.withColumn("weight", prep.balanced_weight(rows, "label")).select("features", "label", "fold", "weight"))
    forest, boosted = trees.forest_classifier(weight="weight"), trees.boosted_classifier()
    found = []
    for name, estimator, grid in (("forest", forest, trees.forest_grid(forest)), ("boosted", boosted, trees.boosted_grid(boosted))):
        fitted = trees.tune_classifier(rows, estimator, grid, "fold")
        found += [(name, ", ".join(sorted(f"{p.name} {v}" for p, v in g.items())), float(f)) for g, f in zip(grid, fitted.avgMetrics)]
    return spark.createDataFrame(found, "model string, setting string, f1 double")


def _stacked(spark: SparkSession, folder: str) -> Stack:
    bases = {"forest": trees.forest_classifier(), "boosted": trees.boosted_classifier()}
    return fit_stack(materialise(_label_vectors(spark, folder)), "vec", "quality", "doc_id", "fold", bases)


@query()
def stacked_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every labelled document with the out-of-fold scores of both base models and of the model over them."""
    return _stacked(spark, folder).out_of_fold.select("doc_id", "quality", "fold", "forest", "boosted", "Preds")


@query(f"SELECT doc_id, quality, {_fold_sql('doc_id', 5)} AS fold, 0.0::DOUBLE AS off_model, 0.0::DOUBLE AS residuals, 0.0::DOUBLE AS slope_forest, 0.0::DOUBLE AS slope_boosted FROM labels JOIN documents USING (doc_id)")
def stack_optimum(spark: SparkSession, folder: str) -> DataFrame:
    """The certificate of the stacked scores: each is the model's value of the two scores beside it, and the model's slope is 0 in every weight."""
    stack = _stacked(spark, folder)
    return certified(stack, "quality").select("doc_id", "quality", "fold", "off_model", "residuals", "slope_forest", "slope_boosted")


@query()
def top_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of a top-ten finish for every row of the upcoming event, with base models tuned on their grids."""
    model_table = forecast_plan.model_table(_features_b(spark, folder), event_rows("Event 07", 2001))
    return forecast_plan.forecast_top(model_table, forecast_plan.tuned_bases(model_table)).forecast
