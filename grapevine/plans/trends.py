"""Trend jobs: spikes, alerts with a message, and the chart report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LOOKBACK_WEEKS, MIN_COUNT, WINDOW, Z_THRESHOLD
from ..functions.labels import is_negative_with_issue
from ..functions.numbers import week_label
from ..operators import trends as t
from ..operators.reviews import alert_table, negative_with_issue
from ..storage import materialise


def trends(
    events: DataFrame, group: str = "cluster", date: str = "date", window: int = WINDOW, digits: int = 2, **rule_options
) -> DataFrame:
    """Score of every group and week; weeks count from the earliest event. Short histories are an error.

    A started last week counts as a week.
    """
    daily = t.daily_counts(events, group, date)
    horizon = t.horizon_value(daily)
    n_weeks = t.require_history(horizon["n_weeks"], window)
    counts = t.weekly_counts(daily, horizon["first_date"])
    flags = t.detect_spikes(counts, n_weeks, window=window, digits=digits, **rule_options)
    return t.with_week_start(flags, horizon["first_date"])


def latest_scores(events: DataFrame, group: str = "cluster", date: str = "date", **rule_options) -> DataFrame:
    """Scores of the last week, highest z first."""
    scored = trends(events, group, date, **rule_options)
    horizon = t.horizon_value(t.daily_counts(events, group, date))
    return t.sort_alerts(t.latest_week(scored, horizon["n_weeks"]))


@dataclass(frozen=True)
class _Board:
    cells: DataFrame  # (group, date, events); group null = a review that is not a negative with an issue
    horizon: Column


def _board(reviews: DataFrame) -> _Board:
    """Daily counts per issue and the horizon of all reviews, from one pass over three columns.

    The counts are written: a filter on them would otherwise reach the reviews and make a second pass of the horizon.
    """
    issue = F.when(is_negative_with_issue(F.col("sentiment"), F.col("issue_category")), F.col("issue_category"))
    cells = (
        reviews.groupBy(issue.alias("group"), F.col("review_date").cast("date").alias("date"))
        .agg(F.count("*").alias("events"))
    )
    cells = materialise(cells, name="daily-counts")
    return _Board(cells, t.horizon_value(cells))


def trend_alerts(
    reviews: DataFrame,
    window: int = WINDOW,
    z_threshold: float = Z_THRESHOLD,
    min_count: int = MIN_COUNT,
    lookback: int = LOOKBACK_WEEKS,
    digits: int = 2,
    board: _Board | None = None,
) -> DataFrame:
    """Alerts of the last ``lookback`` weeks, highest z first.

    Weeks run over all dated reviews, not only the negative ones. ``board`` holds daily counts that are there already.
    """
    board = board or _board(reviews)
    origin, n_weeks = board.horizon["first_date"], board.horizon["n_weeks"]
    observed = board.cells.where(F.col("group").isNotNull() & F.col("date").isNotNull())
    counts = t.weekly_counts(observed, origin)
    flags = t.detect_spikes(
        counts, n_weeks, window=window, z_threshold=z_threshold, min_count=min_count, digits=digits
    )
    recent = t.lookback_filter(flags.where("flag_z"), n_weeks, lookback)
    return t.sort_alerts(alert_table(t.with_week_start(recent, origin)), "issue_category", "week_start")


def alert_message(alerts: DataFrame, link: str | None = None) -> DataFrame:
    """One row: number of alerts and the message, one line per alert, highest z first; no alert, no message.

    Alerts are few by nature: a flag needs a week far above its own baseline.
    """
    def number(column: str) -> Column:
        return F.regexp_replace(F.col(column).cast("string"), r"\.0$", "")

    sign = F.when(F.col("wow_delta") >= 0, "+").otherwise("")
    line = F.concat(
        F.lit("- *"), F.col("issue_category"), F.lit("*: "), F.col("count").cast("string"),
        F.lit(" negative reviews in the week of "), F.col("week_start").cast("string"),
        F.lit(" (baseline "), number("baseline_mean"), F.lit(", z "), number("z"), F.lit(", "),
        sign, F.col("wow_delta").cast("string"), F.lit(" vs previous week)"),
    )
    item = F.struct((-F.col("z")).alias("o"), "issue_category", "week_start", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda i: i["line"])
    noun = F.when(F.col("alerts") == 1, " issue").otherwise(" issues")
    head = F.concat(F.lit("*Negative review spike detected* ("), F.col("alerts").cast("string"), noun, F.lit(")\n"))
    tail = F.lit(f"\n{link}" if link else "")
    return alerts.agg(F.count("*").alias("alerts"), lines.alias("lines")).select(
        "alerts", F.when(F.col("alerts") > 0, F.concat(head, F.array_join("lines", "\n"), tail)).alias("message")
    )


def trend_run_summary(reviews: DataFrame, **alert_options) -> DataFrame:
    """One row: reviews read, negatives with issue, weeks, issues, alerts, and what to do about them."""
    board = _board(reviews)
    alerts = trend_alerts(reviews, board=board, **alert_options).agg(F.count("*")).scalar()
    totals = board.cells.agg(
        F.sum("events").alias("reviews_read"),
        F.coalesce(F.sum(F.when(F.col("group").isNotNull(), F.col("events"))), F.lit(0)).alias("negative_with_issue"),
        F.count_distinct("group").alias("issues"),
    )
    status = F.when(F.col("alerts") > 0, "alerts_found").otherwise("not_needed")
    return totals.select(
        "reviews_read", "negative_with_issue", board.horizon["n_weeks"].alias("weeks"), "issues", alerts.alias("alerts")
    ).withColumn("status", status)


def chart_groups(weekly: DataFrame, flagged: DataFrame, fallback: int = 4) -> DataFrame:
    """Weekly series of the flagged groups; when none is flagged, of the first groups by name."""
    names = flagged.select("group").distinct()
    any_flag = names.agg(F.count("*")).scalar()
    first = weekly.select("group").distinct().orderBy("group").limit(fallback)
    chosen = names.where(any_flag > 0).unionByName(first.where(any_flag == 0))
    return weekly.join(chosen, "group", "left_semi")


def spike_report(
    reviews: DataFrame, z_threshold: float = Z_THRESHOLD, min_count: int = MIN_COUNT
) -> dict[str, DataFrame]:
    """``message`` (one row), ``table`` (alerts) and ``chart`` (weekly counts of the groups to draw)."""
    negative = negative_with_issue(reviews)
    scored = materialise(
        trends(negative, "issue_category", "review_date", z_threshold=z_threshold, min_count=min_count), name="scores"
    )
    spikes = scored.where("flag_z")
    table = t.sort_alerts(spikes).select(
        F.col("group").alias("issue"), F.col("week_start").alias("week starting"), F.col("count").alias("negative reviews"),
        F.col("prev_week").alias("previous week"), F.col("wow_delta").alias("change"),
        F.col("baseline_mean").alias("baseline"), "z",
    )
    daily = t.daily_counts(negative, "issue_category", "review_date")
    weekly = t.weekly_counts(daily, t.horizon_value(daily)["first_date"])
    chart = chart_groups(weekly, spikes).select(
        F.col("group").alias("issue"), week_label(F.col("week")).alias("week"), F.col("count").alias("negative reviews")
    )
    text = F.concat(
        F.col("n").cast("string"),
        F.lit(f" spike(s) found (z >= {z_threshold}, at least {min_count} reviews in the week, {WINDOW}-week baseline)."),
    )
    message = spikes.agg(F.count("*").alias("n")).select(text.alias("message"))
    return {"message": message, "table": table, "chart": chart}
