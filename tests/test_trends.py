import datetime as dt

import pytest
from pyspark.sql import functions as F

from grapevine.operators import trends as t
from grapevine.plans import trends as jobs

START = dt.date(2026, 6, 1)


def events(spark, **counts):
    rows = [
        (group, START + dt.timedelta(days=7 * week + i % 7))
        for group, series in counts.items()
        for week, n in enumerate(series)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "cluster string, date date")


def series(spark, **counts):
    rows = [(g, w, n) for g, xs in counts.items() for w, n in enumerate(xs)]
    return spark.createDataFrame(rows, "`group` string, week int, `count` bigint")


def test_spike_is_flagged_with_its_week_start(spark):
    scored = jobs.trends(events(spark, late=[5, 6, 5, 4, 6, 5, 27, 5]))
    flagged = scored.where("flag_z").collect()
    assert [(r.week, r.week_start) for r in flagged] == [(6, dt.date(2026, 7, 13))]
    rows = {r.week: r for r in scored.collect()}
    assert {w: r.z for w, r in rows.items()} == {4: 0.45, 5: -0.11, 6: 9.84, 7: -0.5}
    assert rows[6].flag_ewma and rows[6].wow_delta == 22 and rows[6].prev_week == 5


def test_short_history_is_an_error_that_names_the_weeks(spark):
    with pytest.raises(Exception, match="need at least 5 weeks.*got 3"):
        jobs.trends(events(spark, x=[5, 5, 5])).collect()


def test_exactly_five_weeks_are_enough(spark):
    assert jobs.trends(events(spark, x=[5] * 5)).count() == 1


def test_quiet_series_and_small_counts_never_flag(spark):
    flat = [6, 5, 7, 6, 6, 8, 5, 6, 7, 6, 5, 6]
    small = [0] * 8 + [5, 0, 0, 0]
    scored = t.detect_spikes(series(spark, flat=flat, small=small), F.lit(12))
    assert scored.where("flag_z or flag_ewma").count() == 0
    assert scored.agg(F.min("week")).first()[0] == 4


def test_missing_weeks_count_as_zero_before_between_and_after(spark):
    counts = spark.createDataFrame([("a", 2, 3), ("a", 5, 1)], "`group` string, week int, `count` bigint")
    grid = t.dense_grid(counts, F.lit(8)).orderBy("week").collect()
    assert [r["count"] for r in grid] == [0, 0, 3, 0, 0, 1, 0, 0]


def test_ewma_follows_the_recurrence(spark):
    xs = [4, 6, 5, 7, 9, 2, 30]
    value = sum(xs[:4]) / 4
    expected = []
    for x in xs:
        value = 0.3 * x + (1 - 0.3) * value
        expected.append(value)
    rows = t.with_ewma(t.week_series(series(spark, a=xs), F.lit(7), ["group"]), ["group"]).orderBy("week").collect()
    assert [r.ewma for r in rows] == pytest.approx(expected, abs=1e-12)


def test_published_alert_scores(spark):
    """Count and baseline of the published alerts give the published z under the floor sqrt(mean)."""
    cases = [(27, 3.5, 12.56), (19, 2.75, 9.8), (12, 3.5, 4.54), (12, 3.75, 4.26)]
    rows = spark.createDataFrame(cases, "c int, m double, z double")
    z = (F.col("c") - F.col("m")) / t.poisson_floor(F.lit(0.5), F.col("m"))
    got = rows.select(F.bround(z, 2).alias("got"), "z").collect()
    assert [r.got for r in got] == [r.z for r in got]


def test_a_window_of_one_week_is_refused(spark):
    with pytest.raises(ValueError):
        t.trailing_baseline(series(spark, a=[1, 2, 3]), window=1)


def board(spark, *groups):
    rows = []
    for group, xs in groups:
        rows += [("negative", group, START + dt.timedelta(days=7 * w)) for w, n in enumerate(xs) for _ in range(n)]
    return rows


REVIEWS = "sentiment string, issue_category string, review_date date"


def test_alert_weeks_run_over_all_reviews(spark):
    rows = board(spark, ("late", [0, 0, 2, 3, 2, 2, 20]))
    rows += [("positive", "late", START), ("negative", None, START), ("negative", "", START + dt.timedelta(days=69))]
    reviews = spark.createDataFrame(rows, REVIEWS)
    alerts = jobs.trend_alerts(reviews).collect()
    assert [(a.week_start, a["count"]) for a in alerts] == [(START + dt.timedelta(days=42), 20)]
    summary = jobs.trend_run_summary(reviews).first()
    assert (summary.reviews_read, summary.negative_with_issue, summary.weeks, summary.issues) == (32, 29, 10, 1)
    assert (summary.alerts, summary.status) == (1, "alerts_found")
    assert jobs.trend_alerts(reviews, lookback=3).count() == 0


def test_message_counts_and_signs(spark):
    reviews = spark.createDataFrame(board(spark, ("late", [2, 3, 2, 2, 20])), REVIEWS)
    text = jobs.alert_message(jobs.trend_alerts(reviews)).first().message
    assert text.startswith("*Negative review spike detected* (1 issue)\n- *late*: 20 negative reviews in the week of 2026-06-29")
    assert "+18 vs previous week" in text
    both = board(spark, ("late", [2, 3, 2, 2, 20]), ("torn", [2, 2, 2, 2, 30]))
    two = jobs.alert_message(jobs.trend_alerts(spark.createDataFrame(both, REVIEWS))).first()
    assert two.alerts == 2 and "(2 issues)" in two.message
    assert two.message.index("*torn*") < two.message.index("*late*")


def test_no_alert_gives_an_empty_table_with_all_columns(spark):
    reviews = spark.createDataFrame(board(spark, ("late", [5] * 6)), REVIEWS)
    alerts = jobs.trend_alerts(reviews)
    assert alerts.count() == 0 and alerts.columns[0] == "week_start"
    assert jobs.trend_run_summary(reviews).first().status == "not_needed"
    report = jobs.spike_report(reviews)
    assert report["table"].count() == 0 and report["chart"].select("issue").distinct().count() == 1


def test_stricter_thresholds_find_fewer(spark):
    reviews = spark.createDataFrame(board(spark, ("late", [3, 3, 3, 3, 13, 3, 3, 3, 3, 30])), REVIEWS)
    assert jobs.spike_report(reviews)["table"].count() == 2
    assert jobs.spike_report(reviews, 6.0, 15)["table"].count() == 1
    weeks = {r.week for r in jobs.spike_report(reviews)["chart"].collect()}
    assert weeks == {f"W{i:02d}" for i in range(1, 11)}
