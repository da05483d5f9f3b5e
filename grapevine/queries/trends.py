"""Queries: weekly counts, detector, alerts, planted spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import is_negative_with_issue
from ..functions.numbers import week_index, week_label, week_start
from ..operators import sets
from ..operators import trends as t
from ..operators.aggregates import detector_scores
from ..operators.joins import literal_table, match_planted
from ..operators.planted import backtest, plant_spikes
from ..operators.reviews import alert_table, negative_with_issue
from ..plans import trends as jobs
from .registry import query
from .standins import ORDER_REVIEWS, order_reviews, table

SCORED = "group, week, week_start, count, prev_week, wow_delta, baseline_mean, z, flag_z, flag_ewma".split(", ")

NEGATIVE = "SELECT issue_category AS g, review_date AS d FROM order_reviews WHERE sentiment = 'negative'"
OWN_HORIZON = "SELECT min(d) AS t0, (date_diff('day', min(d), max(d)) // 7 + 1)::INTEGER AS nw FROM ev"
ALL_HORIZON = (
    "SELECT min(review_date) AS t0, (date_diff('day', min(review_date), max(review_date)) // 7 + 1)::INTEGER AS nw "
    "FROM order_reviews"
)


def detector(events: str, horizon: str, base: str = "", window: int = 4) -> str:
    """CTEs down to ``scored``, one row per group and scored week."""
    return f"""WITH {base + ', ' if base else ''}ev AS ({events}), hz AS ({horizon}),
wk AS (SELECT g, (date_diff('day', t0, d) // 7)::INTEGER AS w, count(*) AS c FROM ev, hz GROUP BY ALL),
gr AS (SELECT g, w FROM (SELECT DISTINCT g FROM ev), (SELECT unnest(range(0, nw))::INTEGER AS w FROM hz)),
dn AS (SELECT g, w, coalesce(c, 0) AS c FROM gr LEFT JOIN wk USING (g, w)),
sc AS (
  SELECT g, w, c, avg(c) OVER b AS mu, stddev_samp(c) OVER b AS sd, lag(c) OVER o AS prev, list(c::DOUBLE) OVER o AS xs,
    avg(c) FILTER (WHERE w < {window}) OVER (PARTITION BY g) AS m0
  FROM dn
  WINDOW b AS (PARTITION BY g ORDER BY w ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING),
    o AS (PARTITION BY g ORDER BY w)),
zz AS (
  SELECT *, greatest(sd, sqrt(greatest(mu, 1.0::DOUBLE))) AS sp,
    list_reduce(list_prepend(m0, xs),
      lambda acc, v: 0.3::DOUBLE * v + 0.7::DOUBLE * acc) AS ew
  FROM sc),
scored AS (
  SELECT g AS "group", w AS week, (t0 + w * 7)::DATE::VARCHAR AS week_start, c AS count, prev AS prev_week,
    c - prev AS wow_delta, round_even(mu, 6) AS baseline_mean, round_even((c - mu) / sp, 6) AS z,
    ((c - mu) / sp >= 3.5 AND c >= 8) AS flag_z,
    (ew > mu + 3.0::DOUBLE * sp * sqrt(0.3::DOUBLE / 1.7::DOUBLE) AND c >= 8) AS flag_ewma, nw
  FROM zz, hz WHERE w >= {window})
"""


ORDERS_DETECTOR = detector(NEGATIVE, OWN_HORIZON, ORDER_REVIEWS)
BOARD_DETECTOR = detector(NEGATIVE, ALL_HORIZON, ORDER_REVIEWS)
COLUMNS = '"group", week, week_start, count, prev_week, wow_delta, baseline_mean, z, flag_z, flag_ewma'


def _negative(spark: SparkSession, folder: str) -> DataFrame:
    return order_reviews(spark, folder).where(F.col("sentiment") == "negative")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.trends(_negative(spark, folder), "issue_category", "review_date", digits=6)


def _text_dates(rows: DataFrame) -> DataFrame:
    return rows.withColumn("week_start", F.col("week_start").cast("string"))


@query(f"{ORDERS_DETECTOR} SELECT {COLUMNS} FROM scored")
def trends(spark, folder):
    return _text_dates(_scored(spark, folder)).select(*SCORED)


@query(
    detector("SELECT l_returnflag AS g, l_shipdate::DATE AS d FROM lineitem", OWN_HORIZON) + f"SELECT {COLUMNS} FROM scored"
)
def trends_by_return_flag(spark, folder):
    return _text_dates(jobs.trends(table(spark, folder, "lineitem"), "l_returnflag", "l_shipdate", digits=6)).select(*SCORED)


@query(detector("SELECT event_type AS g, ts::DATE AS d FROM events", OWN_HORIZON) + f"SELECT {COLUMNS} FROM scored")
def trends_by_event_type(spark, folder):
    return _text_dates(jobs.trends(table(spark, folder, "events"), "event_type", "ts", digits=6)).select(*SCORED)


@query(f"{ORDERS_DETECTOR} SELECT {COLUMNS} FROM scored WHERE week = nw - 1")
def latest_week(spark, folder):
    latest = jobs.latest_scores(_negative(spark, folder), "issue_category", "review_date", digits=6)
    return _text_dates(latest).select(*SCORED)


ALERT_SQL = (
    'SELECT week_start, "group" AS issue_category, count, prev_week, wow_delta, baseline_mean, z FROM scored '
    "WHERE flag_z AND week >= nw - {lookback}"
)


@query(BOARD_DETECTOR + ALERT_SQL.format(lookback=200))
def trend_alerts(spark, folder):
    return _text_dates(jobs.trend_alerts(order_reviews(spark, folder), lookback=200, digits=6))


@query(BOARD_DETECTOR + f"SELECT {COLUMNS} FROM scored WHERE week >= nw - 12")
def lookback_filter(spark, folder):
    reviews = order_reviews(spark, folder)
    board = jobs._board(reviews)
    counts = t.weekly_counts(board.cells.where("group is not null"), board.horizon["first_date"])
    flags = t.detect_spikes(counts, board.horizon["n_weeks"], digits=6)
    recent = t.lookback_filter(flags, board.horizon["n_weeks"], 12)
    return _text_dates(t.with_week_start(recent, board.horizon["first_date"])).select(*SCORED)


# the message shows two decimals without a trailing ".0"
_SHORT = "regexp_replace(round_even({0}, 2)::VARCHAR, '\\.0$', '')"


@query(
    BOARD_DETECTOR
    + f""", al AS (SELECT * FROM scored WHERE flag_z AND week >= nw - 200)
SELECT count(*) AS alerts, '*Negative review spike detected* (' || count(*) ||
  CASE WHEN count(*) = 1 THEN ' issue' ELSE ' issues' END || ')' || chr(10) ||
  string_agg('- *' || "group" || '*: ' || count || ' negative reviews in the week of ' || week_start || ' (baseline ' ||
    {_SHORT.format("baseline_mean")} || ', z ' || {_SHORT.format("z")} || ', ' ||
    CASE WHEN wow_delta >= 0 THEN '+' ELSE '' END || wow_delta || ' vs previous week)', chr(10)
    ORDER BY round_even(z, 2) DESC, "group", week_start) AS message
FROM al"""
)
def alert_message(spark, folder):
    return jobs.alert_message(jobs.trend_alerts(order_reviews(spark, folder), lookback=200))


@query(
    BOARD_DETECTOR
    + """SELECT (SELECT count(*) FROM order_reviews) AS reviews_read, (SELECT count(*) FROM ev) AS negative_with_issue,
  (SELECT nw FROM hz) AS weeks, (SELECT count(DISTINCT g) FROM ev) AS issues,
  count(*) FILTER (WHERE flag_z AND week >= nw - 200) AS alerts,
  CASE WHEN count(*) FILTER (WHERE flag_z AND week >= nw - 200) > 0 THEN 'alerts_found' ELSE 'not_needed' END AS status
FROM scored"""
)
def trend_run_summary(spark, folder):
    return jobs.trend_run_summary(order_reviews(spark, folder), lookback=200)


@query(
    f"""WITH {ORDER_REVIEWS}, ev AS ({NEGATIVE})
SELECT min(d)::VARCHAR AS first_date, max(d)::VARCHAR AS last_date,
  (date_diff('day', min(d), max(d)) // 7 + 1)::INTEGER AS n_weeks, count(*) AS events FROM ev"""
)
def time_horizon(spark, folder):
    daily = t.daily_counts(_negative(spark, folder), "issue_category", "review_date")
    rows = t.time_horizon(daily)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query(f"WITH {ORDER_REVIEWS}, ev AS ({NEGATIVE}), hz AS ({OWN_HORIZON}) SELECT nw AS n_weeks FROM hz WHERE nw >= 5")
def require_history(spark, folder):
    daily = t.daily_counts(_negative(spark, folder), "issue_category", "review_date")
    return t.time_horizon(daily).select(t.require_history(F.col("n_weeks")).alias("n_weeks"))


def _weekly(spark: SparkSession, folder: str):
    daily = t.daily_counts(_negative(spark, folder), "issue_category", "review_date")
    horizon = t.horizon_value(daily)
    return t.weekly_counts(daily, horizon["first_date"]), horizon


@query(f"{ORDERS_DETECTOR} SELECT g AS \"group\", w AS week, c AS count FROM wk")
def weekly_counts(spark, folder):
    return _weekly(spark, folder)[0]


@query(f"{ORDERS_DETECTOR} SELECT g AS \"group\", w AS week, c AS count FROM dn")
def dense_grid(spark, folder):
    counts, horizon = _weekly(spark, folder)
    return t.dense_grid(counts, horizon["n_weeks"])


@query(f"{ORDERS_DETECTOR} SELECT g AS \"group\", w AS week, round(mu, 6) AS baseline, round(sd, 6) AS deviation FROM sc")
def trailing_baseline(spark, folder):
    counts, horizon = _weekly(spark, folder)
    rows = t.trailing_baseline(t.dense_grid(counts, horizon["n_weeks"]))
    return rows.select("group", "week", F.round("baseline", 6).alias("baseline"), F.round("deviation", 6).alias("deviation"))


@query(f"{ORDERS_DETECTOR} SELECT g AS \"group\", w AS week, round(sp, 6) AS spread FROM zz WHERE w >= 4")
def poisson_floor(spark, folder):
    counts, horizon = _weekly(spark, folder)
    rows = t.trailing_baseline(t.dense_grid(counts, horizon["n_weeks"])).where(F.col("week") >= 4)
    spread = t.poisson_floor(F.col("deviation"), F.col("baseline"))
    return rows.select("group", "week", F.round(spread, 6).alias("spread"))


@query(f"{ORDERS_DETECTOR} SELECT g AS \"group\", w AS week, ew AS ewma FROM zz")
def ewma(spark, folder):
    counts, horizon = _weekly(spark, folder)
    return t.with_ewma(t.week_series(counts, horizon["n_weeks"], ["group"]), ["group"]).drop("count")


@query(f"{ORDERS_DETECTOR} SELECT g AS \"group\", w AS week, c AS count, prev AS prev_week, c - prev AS wow_delta FROM sc")
def week_over_week(spark, folder):
    counts, horizon = _weekly(spark, folder)
    return t.week_over_week(t.dense_grid(counts, horizon["n_weeks"]))


@query(
    f"""WITH {ORDER_REVIEWS}, hz AS ({ALL_HORIZON})
SELECT review_id, (date_diff('day', t0, review_date) // 7)::INTEGER AS week,
  (t0 + (date_diff('day', t0, review_date) // 7)::INTEGER * 7)::DATE::VARCHAR AS week_start,
  printf('W%02d', (date_diff('day', t0, review_date) // 7)::INTEGER + 1) AS week_label
FROM order_reviews, hz"""
)
def week_index_and_label(spark, folder):
    rows = order_reviews(spark, folder)
    origin = rows.agg(F.min("review_date")).scalar()
    return rows.select("review_id", week_index(F.col("review_date"), origin).alias("week")).select(
        "review_id", "week", week_start(F.col("week"), origin).cast("string").alias("week_start"),
        week_label(F.col("week")).alias("week_label"),
    )


@query(
    f"""WITH {ORDER_REVIEWS}
SELECT review_id, issue_category FROM order_reviews WHERE sentiment = 'negative' AND issue_category <> ''"""
)
def negative_with_issue_filter(spark, folder):
    return negative_with_issue(order_reviews(spark, folder)).select("review_id", "issue_category")


@query(f"{ORDERS_DETECTOR} SELECT \"group\", week, z FROM scored ORDER BY z DESC, \"group\", week LIMIT 7")
def top_k_by_z(spark, folder):
    return t.top_k_by_z(_scored(spark, folder), 7).select("group", "week", "z")


@query(f"{ORDERS_DETECTOR} SELECT \"group\", week, z FROM scored WHERE flag_z ORDER BY z DESC, \"group\", week")
def sort_alerts(spark, folder):
    return t.sort_alerts(_scored(spark, folder).where("flag_z")).select("group", "week", "z")


@query(
    f"""{ORDERS_DETECTOR} SELECT "group" AS issue_category, week_start, count, prev_week, wow_delta, baseline_mean, z
FROM scored WHERE flag_z"""
)
def rename_reorder(spark, folder):
    return _text_dates(alert_table(_scored(spark, folder).where("flag_z")))


@query(
    f"""{ORDERS_DETECTOR}, fl AS (SELECT DISTINCT "group" AS g FROM scored WHERE flag_z),
ch AS (SELECT g FROM fl UNION ALL
  (SELECT g FROM (SELECT DISTINCT g FROM wk) WHERE NOT EXISTS (SELECT 1 FROM fl) ORDER BY g LIMIT 4))
SELECT g AS issue, printf('W%02d', w + 1) AS week, c AS "negative reviews" FROM wk WHERE g IN (SELECT g FROM ch)"""
)
def chart_groups(spark, folder):
    return jobs.spike_report(order_reviews(spark, folder))["chart"]


@query(
    f"""{ORDERS_DETECTOR} SELECT "group" AS issue, week_start AS "week starting", count AS "negative reviews",
  prev_week AS "previous week", wow_delta AS change, round_even(baseline_mean, 2) AS baseline, round_even(z, 2) AS z
FROM scored WHERE flag_z"""
)
def spike_report(spark, folder):
    rows = jobs.spike_report(order_reviews(spark, folder))["table"]
    return rows.withColumn("week starting", F.col("week starting").cast("string"))


PLANTED = [("F", 100, 5.0), ("O", 200, 3.0), ("P", 150, 4.0)]
_PAIRS = "(VALUES ('F', 100), ('O', 200), ('P', 150), ('F', 33)) p(g, w)"
PAIRS = [("F", 100), ("O", 200), ("P", 150), ("F", 33)]


def _pairs(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PAIRS, "group string, week int")


@query(
    f"""{ORDERS_DETECTOR}, f AS (SELECT "group" AS g, week AS w FROM scored WHERE flag_z), p AS (SELECT * FROM {_PAIRS})
SELECT coalesce(f.g, p.g) AS "group", coalesce(f.w, p.w) AS week,
  CASE WHEN p.g IS NULL THEN 'fp' WHEN f.g IS NULL THEN 'fn' ELSE 'tp' END AS outcome
FROM f FULL OUTER JOIN p ON f.g = p.g AND f.w = p.w"""
)
def match_planted_pairs(spark, folder):
    return match_planted(_scored(spark, folder).where("flag_z"), _pairs(spark), ["group", "week"])


@query(
    f"""{ORDERS_DETECTOR}, f AS (SELECT "group" AS g, week AS w FROM scored WHERE flag_z), p AS (SELECT * FROM {_PAIRS}),
k AS (SELECT g, w FROM (SELECT "group" AS g, week AS w, z FROM scored ORDER BY z DESC, g, w LIMIT 4)),
n AS (SELECT (SELECT count(*) FROM f JOIN p USING (g, w)) AS tp, (SELECT count(*) FROM f) AS nf,
  (SELECT count(*) FROM k JOIN p USING (g, w)) AS hit)
SELECT 'flag_z' AS rule, tp, nf - tp AS fp, 4 - tp AS fn, nf AS n_flagged,
  round(tp / nullif(nf, 0), 6) AS "precision", round(tp / 4, 6) AS recall, round(hit / 4, 6) AS precision_at_k FROM n"""
)
def detector_scores_of_rule(spark, folder):
    rows = detector_scores(_scored(spark, folder), PAIRS, "flag_z")
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "precision_at_k")})


@query(f"""{ORDERS_DETECTOR} SELECT "group", week FROM scored WHERE flag_z INTERSECT
SELECT "group", week FROM scored WHERE flag_ewma""")
def intersect_pairs(spark, folder):
    scored = _scored(spark, folder)
    return sets.intersect_pairs(scored.where("flag_z"), scored.where("flag_ewma"), "group", "week")


@query(f"""{ORDERS_DETECTOR} SELECT "group", week FROM scored WHERE flag_z EXCEPT
SELECT "group", week FROM scored WHERE flag_ewma""")
def except_pairs(spark, folder):
    scored = _scored(spark, folder)
    return sets.except_pairs(scored.where("flag_z"), scored.where("flag_ewma"), "group", "week")


@query(
    f"""WITH {ORDER_REVIEWS}, hz AS ({ALL_HORIZON}), wk AS (
  SELECT issue_category AS g, (date_diff('day', t0, review_date) // 7)::INTEGER AS w, nw FROM order_reviews, hz),
p AS (SELECT * FROM (VALUES ('F', 100, 5.0::DOUBLE), ('O', 200, 3.0::DOUBLE), ('P', 150, 4.0::DOUBLE)) v(g, w, f)),
s AS (SELECT wk.g, count(*) AS n, count(*) FILTER (WHERE wk.w = p.w) AS already, any_value(f) AS f, any_value(nw) AS nw
  FROM wk JOIN p ON wk.g = p.g GROUP BY wk.g)
SELECT g AS "group", n AS rows_in_group,
  (already + least(greatest(round_even(f * n / nw, 0)::BIGINT - already, 0), n - already))::BIGINT AS in_target_week FROM s"""
)
def plant_spikes_totals(spark, folder):
    rows = order_reviews(spark, folder)
    edges = rows.agg(F.struct(F.min("review_date").alias("a"), F.max("review_date").alias("b"))).scalar()
    dated = rows.withColumn("week", week_index(F.col("review_date"), edges["a"]))
    n_weeks = week_index(edges["b"], edges["a"]) + 1
    moved = plant_spikes(dated, "issue_category", "review_id", PLANTED, n_weeks, seed=3)
    target = F.lit(None).cast("int")
    for group, week, _ in PLANTED:
        target = F.when(F.col("issue_category") == group, week).otherwise(target)
    return moved.groupBy(F.col("issue_category").alias("group")).agg(
        F.count("*").alias("rows_in_group"), F.count_if(F.col("week") == target).alias("in_target_week")
    )


# all timelines, one per seed: rows move in the order of their seeded digests; seed -1 has no plant
BACKTEST = f"""WITH {ORDER_REVIEWS},
ev AS (SELECT review_id AS id, issue_category AS g, review_date AS d FROM order_reviews WHERE sentiment = 'negative'), hz AS ({OWN_HORIZON}),
rw AS (SELECT id, g, (date_diff('day', t0, d) // 7)::INTEGER AS w FROM ev, hz),
sp AS (SELECT g, (nw - 1 - back)::INTEGER AS target, factor FROM (VALUES ('F', 40, 5.0::DOUBLE), ('O', 25, 4.0), ('P', 10, 3.0)) v(g, back, factor), hz),
sz AS (SELECT g, target, factor, count(*) AS n, count(*) FILTER (WHERE w = target) AS already FROM rw JOIN sp USING (g) GROUP BY ALL),
nd AS (SELECT g, target, least(greatest(round_even(factor * n / nw, 0)::BIGINT - already, 0), n - already) AS need FROM sz, hz),
sd AS (SELECT unnest(range(0, 200))::INTEGER AS seed),
mv AS (SELECT seed, g, w, target FROM rw JOIN nd USING (g), sd WHERE w <> target
  QUALIFY row_number() OVER (PARTITION BY seed, g ORDER BY substr(md5(id || '|' || seed), 1, 15)) <= need),
ct AS (SELECT seed, g, w, sum(c)::BIGINT AS c FROM (
  SELECT seed, g, w, count(*) AS c FROM rw, sd GROUP BY ALL UNION ALL SELECT seed, g, w, -count(*) FROM mv GROUP BY ALL
  UNION ALL SELECT seed, g, target, count(*) FROM mv GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT -1, g, w, count(*) FROM rw GROUP BY ALL),
gr AS (SELECT seed, g, w FROM (SELECT DISTINCT seed, g FROM ct), (SELECT unnest(range(0, nw))::INTEGER AS w FROM hz)),
dn AS (SELECT seed, g, w, coalesce(c, 0) AS c FROM gr LEFT JOIN ct USING (seed, g, w)),
sc AS (SELECT seed, g, w, c, avg(c) OVER b AS mu, stddev_samp(c) OVER b AS sd, avg(c) FILTER (WHERE w < 4) OVER (PARTITION BY seed, g) AS m0,
    sum(0.3::DOUBLE * c * 0.7::DOUBLE ** (-w - 1)) OVER o AS grown
  FROM dn WINDOW b AS (PARTITION BY seed, g ORDER BY w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY seed, g ORDER BY w)),
zz AS (SELECT *, greatest(sd, sqrt(greatest(mu, 1.0::DOUBLE))) AS spread, 0.7::DOUBLE ** (w + 1) * (m0 + grown) AS ew FROM sc WHERE w >= 4),
fl AS (SELECT seed, zz.g, w, (c - mu) / spread AS z, ((c - mu) / spread >= 3.5 AND c >= 8) AS fz,
    (ew > mu + 3.0::DOUBLE * spread * sqrt(0.3::DOUBLE / 1.7::DOUBLE) AND c >= 8) AS fe, sp.g IS NOT NULL AS planted
  FROM zz LEFT JOIN sp ON sp.g = zz.g AND sp.target = zz.w),
top AS (SELECT seed, count(*) FILTER (WHERE planted) AS hits FROM (
  SELECT seed, planted FROM fl QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round_even(z, 2) DESC, g, w) <= 3) GROUP BY seed),
per AS (SELECT seed, 'flag_z' AS rule, count(*) FILTER (WHERE fz AND planted) AS tp, count(*) FILTER (WHERE fz AND NOT planted) AS fp FROM fl GROUP BY seed
  UNION ALL SELECT seed, 'flag_ewma', count(*) FILTER (WHERE fe AND planted), count(*) FILTER (WHERE fe AND NOT planted) FROM fl GROUP BY seed)
SELECT rule, round(avg(tp / nullif(tp + fp, 0)), 9) AS "precision", round(avg(tp / 3), 9) AS recall, round(avg(hits / 3), 9) AS precision_at_k,
  round(avg(fp), 9) AS false_alarms FROM per JOIN top USING (seed) WHERE seed >= 0 GROUP BY rule
UNION ALL SELECT 'quiet', NULL, NULL, NULL, count(*) FILTER (WHERE fz)::DOUBLE FROM fl WHERE seed = -1"""


@query(BACKTEST)
def detector_backtest(spark, folder):
    """Precision, recall and false alarms of both rules over 200 seeded plants in the reviews."""
    rows = _negative(spark, folder)
    edges = rows.agg(F.struct(F.min("review_date").alias("a"), F.max("review_date").alias("b"))).scalar()
    dated = rows.withColumn("week", week_index(F.col("review_date"), edges["a"]))
    last = rows.select(week_index(edges["b"], edges["a"])).first()[0]
    spikes = [("F", last - 40, 5.0), ("O", last - 25, 4.0), ("P", last - 10, 3.0)]
    found = backtest(dated, "issue_category", "review_id", spikes, last + 1, runs=200)
    return found.select("rule", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "precision_at_k", "false_alarms")])


@query(
    f"""WITH {ORDER_REVIEWS}
SELECT sentiment, count(*) AS n, count(*) FILTER (WHERE sentiment = 'negative' AND issue_category <> '') AS with_issue
FROM order_reviews GROUP BY sentiment"""
)
def negative_issue_counts(spark, folder):
    hit = is_negative_with_issue(F.col("sentiment"), F.col("issue_category"))
    return order_reviews(spark, folder).groupBy("sentiment").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("with_issue")
    )
