"""Weekly counts per group and the spike detector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import EWMA_ALPHA, EWMA_LIMIT, MIN_COUNT, WINDOW, Z_THRESHOLD
from ..functions.numbers import round_even, week_index, week_start


def daily_counts(events: DataFrame, group: str, date: str) -> DataFrame:
    """Events per (group, day).

    Everything below works on this table. Its size is groups x days whatever the number of events, and
    a hot group is combined before the shuffle.
    """
    return (
        events.where(F.col(group).isNotNull() & F.col(date).isNotNull())
        .groupBy(F.col(group).alias("group"), F.col(date).cast("date").alias("date"))
        .agg(F.count("*").alias("events"))
    )


def time_horizon(daily: DataFrame) -> DataFrame:
    """First and last day, number of weeks (a started week counts) and number of events."""
    bounds = daily.agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("events").alias("events")
    )
    weeks = week_index(F.col("last_date"), F.col("first_date")) + 1
    return bounds.select("first_date", "last_date", weeks.alias("n_weeks"), "events")


def horizon_value(daily: DataFrame) -> Column:
    """The horizon as one struct value that other columns can use.

    It is a scalar subquery over the daily table, so Spark reuses that table's shuffle instead of
    reading the events again.
    """
    row = time_horizon(daily)
    return row.select(F.struct(*[F.col(c) for c in row.columns])).scalar()


def require_history(n_weeks: Column, window: int = WINDOW) -> Column:
    """``n_weeks``, or an error when there is no full baseline plus a current week."""
    needed = window + 1
    message = F.concat(
        F.lit(f"need at least {needed} weeks of data ({window}-week baseline + current); got "),
        n_weeks.cast("string"),
    )
    return F.when(n_weeks >= needed, n_weeks).otherwise(F.raise_error(message).cast("int"))


def weekly_counts(daily: DataFrame, origin: Column) -> DataFrame:
    """Observed (group, week) cells; weeks without events are absent."""
    return (
        daily.withColumn("week", week_index(F.col("date"), origin))
        .groupBy("group", "week")
        .agg(F.sum("events").alias("count"))
    )


def week_series(counts: DataFrame, n_weeks: Column, keys: Sequence[str]) -> DataFrame:
    """One row per group with its zero-filled counts as an array of ``n_weeks`` elements.

    The array is bounded by the number of weeks, never by the number of events.
    """
    cells = F.array_sort(F.collect_list(F.struct("week", "count")))
    grouped = counts.groupBy(*keys).agg(cells.alias("cells")).withColumn("n_weeks", n_weeks.cast("int"))
    zero = F.lit(0).cast("bigint")

    def append(series: Column, cell: Column) -> Column:
        gap = cell["week"] - F.size(series)
        return F.concat(series, F.array_repeat(zero, gap), F.array(cell["count"]))

    filled = F.aggregate("cells", F.array().cast("array<bigint>"), append)
    padded = F.concat(
        F.col("filled"), F.array_repeat(zero, F.greatest(F.col("n_weeks") - F.size("filled"), F.lit(0)))
    )
    return grouped.withColumn("filled", filled).select(*keys, padded.alias("counts"))


def dense_grid(counts: DataFrame, n_weeks: Column, keys: Sequence[str] = ("group",)) -> DataFrame:
    """Every (group, week) with week 0..n_weeks-1; the count is 0 where nothing was seen.

    No join and no product of groups and weeks: each group is expanded on its own.
    """
    series = week_series(counts, n_weeks, keys)
    return series.select(*keys, F.posexplode("counts").alias("week", "count"))


def with_ewma(
    series: DataFrame, keys: Sequence[str], window: int = WINDOW, alpha: float = EWMA_ALPHA
) -> DataFrame:
    """Rows (keys, week, count, ewma) from one array of counts per group.

    The average starts at the mean of the first ``window`` counts and then runs over all weeks, those
    included. One pass over the array per group.
    """
    head = F.aggregate(F.slice("counts", 1, window), F.lit(0).cast("bigint"), lambda total, x: total + x)
    start = head.cast("double") / F.lit(float(window))

    def step(values: Column, x: Column) -> Column:
        previous = F.coalesce(F.try_element_at(values, F.lit(-1)), F.col("start"))
        return F.concat(values, F.array(F.lit(alpha) * x + F.lit(1 - alpha) * previous))

    smoothed = F.aggregate("counts", F.array().cast("array<double>"), step)
    return (
        series.withColumn("start", start)
        .withColumn("ewma", smoothed)
        .select(*keys, F.posexplode(F.arrays_zip("counts", "ewma")).alias("week", "cell"))
        .select(*keys, "week", F.col("cell.counts").alias("count"), F.col("cell.ewma").alias("ewma"))
    )


def trailing_baseline(rows: DataFrame, keys: Sequence[str] = ("group",), window: int = WINDOW) -> DataFrame:
    """Mean and sample deviation of the ``window`` weeks before each week.

    A deviation needs two values, so a window of one is refused.
    """
    if window < 2:
        raise ValueError("the baseline window must span at least 2 weeks")
    before = Window.partitionBy(*keys).orderBy("week").rowsBetween(-window, -1)
    return rows.withColumns(
        {
            "baseline": F.avg("count").over(before),
            "deviation": F.stddev_samp("count").over(before),
        }
    )


def poisson_floor(deviation: Column, baseline: Column) -> Column:
    """Spread that is at least the square root of the mean (and of 1), so quiet groups do not jump."""
    return F.greatest(deviation, F.sqrt(F.greatest(baseline, F.lit(1.0))))


def week_over_week(rows: DataFrame, keys: Sequence[str] = ("group",)) -> DataFrame:
    previous = F.lag("count", 1).over(Window.partitionBy(*keys).orderBy("week"))
    return rows.withColumn("prev_week", previous).withColumn("wow_delta", F.col("count") - F.col("prev_week"))


def detect_spikes(
    counts: DataFrame,
    n_weeks: Column,
    keys: Sequence[str] = ("group",),
    window: int = WINDOW,
    z_threshold: float = Z_THRESHOLD,
    min_count: int = MIN_COUNT,
    alpha: float = EWMA_ALPHA,
    limit: float = EWMA_LIMIT,
    digits: int = 2,
) -> DataFrame:
    """Score every group and week that has a full baseline.

    ``counts`` holds (keys, week, count), sparse or dense. ``flag_z``: z at least ``z_threshold``.
    ``flag_ewma``: the moving average above its control limit. Both also need ``min_count``. The flags use exact values;
    ``baseline_mean`` and ``z`` are rounded afterwards. All windows share one exchange and one sort.
    """
    series = week_series(counts, n_weeks, keys)
    return score_series(series, keys, window, z_threshold, min_count, alpha, limit, digits)


def score_series(
    series: DataFrame,
    keys: Sequence[str] = ("group",),
    window: int = WINDOW,
    z_threshold: float = Z_THRESHOLD,
    min_count: int = MIN_COUNT,
    alpha: float = EWMA_ALPHA,
    limit: float = EWMA_LIMIT,
    digits: int = 2,
) -> DataFrame:
    """``detect_spikes`` for rows that already hold one zero-filled array ``counts`` per group."""
    keys = list(keys)
    rows = with_ewma(series, keys, window, alpha)
    scored = week_over_week(trailing_baseline(rows, keys, window), keys).where(F.col("week") >= window)
    spread = poisson_floor(F.col("deviation"), F.col("baseline"))
    ceiling = F.col("baseline") + F.lit(limit) * F.col("spread") * F.sqrt(F.lit(alpha / (2 - alpha)))
    enough = F.col("count") >= min_count
    return (
        scored.withColumn("spread", spread)
        .withColumn("raw_z", (F.col("count") - F.col("baseline")) / F.col("spread"))
        .select(
            *keys,
            "week",
            "count",
            "prev_week",
            "wow_delta",
            round_even("baseline", digits).alias("baseline_mean"),
            round_even("raw_z", digits).alias("z"),
            ((F.col("raw_z") >= z_threshold) & enough).alias("flag_z"),
            ((F.col("ewma") > ceiling) & enough).alias("flag_ewma"),
        )
    )


def with_week_start(flags: DataFrame, origin: Column) -> DataFrame:
    return flags.withColumn("week_start", week_start(F.col("week"), origin))


def latest_week(flags: DataFrame, n_weeks: Column) -> DataFrame:
    """Rows of the last week."""
    return flags.where(F.col("week") == n_weeks - 1)


def lookback_filter(flags: DataFrame, n_weeks: Column, lookback: int) -> DataFrame:
    """Rows of the last ``lookback`` weeks."""
    return flags.where(F.col("week") >= n_weeks - lookback)


def sort_alerts(alerts: DataFrame, group: str = "group", week: str = "week") -> DataFrame:
    """Highest z first; group and week break ties."""
    return alerts.orderBy(F.desc("z"), F.asc(group), F.asc(week))


def top_k_by_z(flags: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest z values, on the rounded z of the detector."""
    return sort_alerts(flags).limit(k)
