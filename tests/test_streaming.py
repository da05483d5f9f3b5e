import datetime as dt

from pyspark.sql import functions as F

from grapevine.operators import trends as t
from grapevine.storage import folders, new_folder
from grapevine.streaming import weekly as w

MONDAY = dt.datetime(2026, 6, 1)


def write(spark, folder, name, weeks):
    """One file with the events of some weeks: {week: {group: n}}."""
    rows = [
        (f"{name}-{week}-{group}-{i}", MONDAY + dt.timedelta(days=7 * week, hours=i % 160), group)
        for week, groups in weeks.items() for group, n in groups.items() for i in range(n)
    ]
    spark.createDataFrame(rows, "id string, ts timestamp, g string").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("id string, ts timestamp, g string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_counts_equal_the_batch_counts(spark):
    source, home = new_folder(spark, "events"), new_folder(spark, "counts")
    write(spark, source, "a", {0: {"x": 5, "y": 1}, 1: {"x": 2}})
    write(spark, source, "b", {1: {"x": 4, "y": 2}, 2: {"y": 7}})
    w.run_weekly_counts(w.stream_weekly_counts(stream(spark, source), "ts", "g"), home).awaitTermination()
    write(spark, source, "c", {2: {"y": 1}, 3: {"x": 3}})
    w.run_weekly_counts(w.stream_weekly_counts(stream(spark, source), "ts", "g"), home).awaitTermination()
    got = {(r.week_start, r.group): r["count"] for r in w.current_counts(spark, home).collect()}
    batch = spark.read.parquet(source).groupBy(F.to_date(F.date_trunc("week", "ts")).alias("d"), "g").count().collect()
    assert got == {(r.d, r.g): r["count"] for r in batch}


def test_each_week_alerts_once_and_as_the_batch_does(spark):
    source, home = new_folder(spark, "events"), new_folder(spark, "alerts")
    calm = {"late": 5, "torn": 3}
    steps = [
        {week: calm for week in range(5)},
        {5: {"late": 30}, 6: calm},
        {7: {"late": 4, "torn": 25}, 8: calm, 9: {}, 10: calm},
        {11: calm, 12: calm, 13: {"late": 28}, 16: calm},
    ]
    for i, weeks in enumerate(steps):
        write(spark, source, f"s{i}", weeks)
        w.run_alerts(w.stream_weekly_counts(stream(spark, source), "ts", "g"), home, lookback=2).awaitTermination()
    sent = w.read_alerts(spark, home).collect()
    events = spark.read.parquet(source).where("ts < timestamp'2026-09-14'")
    daily = t.daily_counts(events, "g", "ts")
    horizon = t.horizon_value(daily)
    batch = t.with_week_start(
        t.detect_spikes(t.weekly_counts(daily, horizon["first_date"]), horizon["n_weeks"]).where("flag_z"), horizon["first_date"]
    ).collect()
    assert sorted((r.group, r.week_start, r["count"], r.z) for r in sent) == sorted((r.group, r.week_start, r["count"], r.z) for r in batch)
    assert len(sent) == 3
    kept = folders(spark, f"{home}/trailing/batch=*")
    rows = spark.read.parquet(kept[-1]).where("week_start IS NOT NULL")
    assert len(kept) <= 2 and rows.select("week_start").distinct().count() <= 2 + 4 + 1  # lookback, window, the last week
    # a batch that is run again starts from the one before it
    before = {tuple(r) for r in w.read_alerts(spark, home).collect()}
    w.run_alerts(w.stream_weekly_counts(stream(spark, source), "ts", "g"), home, lookback=2).awaitTermination()
    assert {tuple(r) for r in w.read_alerts(spark, home).collect()} == before


def test_counts_of_many_batches_are_read_from_few_runs(spark):
    source, home = new_folder(spark, "events"), new_folder(spark, "counts")
    for i in range(9):
        write(spark, source, f"f{i}", {i // 3: {"x": 2, "y": 1}})
    w.run_weekly_counts(w.stream_weekly_counts(stream(spark, source), "ts", "g"), home).awaitTermination()
    got = {(str(r.week_start), r.group): r["count"] for r in w.current_counts(spark, home).collect()}
    assert got == {(f"2026-06-{1 + 7 * k:02d}", g): n for k in range(3) for g, n in (("x", 6), ("y", 3))}
    assert len(folders(spark, f"{home}/counts/level=*/first=*/last=*")) <= 8


def test_repeated_ids_are_dropped(spark):
    source, home = new_folder(spark, "events"), new_folder(spark, "ingest")
    write(spark, source, "a", {0: {"x": 5}})
    write(spark, source, "a", {0: {"x": 8}})
    w.run_ingest(w.stream_ingest(stream(spark, source), "id", "ts"), home).awaitTermination()
    assert spark.read.parquet(f"{home}/rows").count() == 8
