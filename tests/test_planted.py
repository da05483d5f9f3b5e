from pyspark.sql import functions as F

from grapevine.operators import aggregates as a
from grapevine.operators import planted as p
from grapevine.queries import trends
from grapevine.storage import materialise


def timeline(spark, n=60, weeks=12):
    return spark.range(2 * n).select("id", (F.col("id") % 2).cast("int").alias("group"), (F.col("id") / 2 % weeks).cast("int").alias("week"))


def test_spike_reaches_its_target_and_moves_nothing_else(spark):
    rows = timeline(spark)
    moved = p.plant_spikes(rows, "group", "id", [(0, 7, 5.0)], 12, seed=1)
    counts = {(r.group, r.week): r["count"] for r in moved.groupBy("group", "week").count().collect()}
    assert counts[0, 7] == 25 and sum(n for (g, _), n in counts.items() if g == 0) == 60
    assert [counts[1, w] for w in range(12)] == [5] * 12
    same = p.plant_spikes(rows.repartition(5), "group", "id", [(0, 7, 5.0)], 12, seed=1)
    assert same.exceptAll(moved).isEmpty()


def test_no_more_rows_move_than_there_are(spark):
    moved = p.plant_spikes(timeline(spark), "group", "id", [(0, 7, 50.0), (1, 2, 0.0)], 12)
    assert moved.where("group = 0 and week = 7").count() == 60
    assert moved.where("group = 1 and week = 2").count() == 5


def test_two_spikes_of_one_group_apply_in_order(spark):
    moved = p.plant_spikes(timeline(spark), "group", "id", [(0, 7, 3.0), (0, 9, 4.0)], 12)
    counts = {r.week: r["count"] for r in moved.where("group = 0").groupBy("week").count().collect()}
    assert counts[9] == 20 and counts[7] <= 15 and sum(counts.values()) == 60


def reviews(spark, groups=4, n=240, weeks=12):
    return spark.range(groups * n).select(
        F.col("id").alias("rid"), F.concat(F.lit("g"), F.col("id") % groups).alias("topic"), (F.col("id") / groups % weeks).cast("int").alias("week"))


SPIKES = [("g0", 7, 5.0), ("g1", 9, 4.0), ("g2", 10, 3.5)]


def test_planted_counts_keep_totals_and_follow_the_plant(spark):
    got = p.planted_counts(reviews(spark), "topic", "rid", SPIKES, 12, runs=6).collect()
    totals = {}
    for r in got:
        totals[r.seed, r.topic] = totals.get((r.seed, r.topic), 0) + r["count"]
    assert len(totals) == 24 and set(totals.values()) == {240}
    assert {r["count"] for r in got if (r.topic, r.week) == ("g0", 7)} == {100}
    assert {r["count"] for r in got if r.topic == "g3"} == {20}
    one = p.plant_spikes(reviews(spark), "topic", "rid", SPIKES, 12, seed=4).groupBy("topic", "week").count().collect()
    assert {(r.topic, r.week, r["count"]) for r in one} == {(r.topic, r.week, r["count"]) for r in got if r.seed == 4 and r["count"]}


def test_backtest_of_clear_spikes(spark):
    got = {r.rule: r for r in p.backtest(reviews(spark), "topic", "rid", SPIKES, 12, runs=10).collect()}
    assert got["flag_z"].recall == 1.0 and got["flag_z"].precision > 0.9 and got["flag_z"].precision_at_k == 1.0
    assert got["quiet"].false_alarms == 0.0 and got["quiet"].precision is None


def test_registered_backtest_has_all_timelines(spark, monkeypatch):
    seeds = []

    def seen(rows, group, id_column, spikes, n_weeks, runs):
        seeds.append(runs)
        counts = p.planted_counts(rows, group, id_column, spikes, n_weeks, runs)
        none = [F.lit(None).cast("double").alias(c) for c in ("precision", "recall", "precision_at_k", "false_alarms")]
        return counts.select(F.col("seed").alias("rule"), *none).distinct()

    monkeypatch.setattr(trends, "backtest", seen)
    got = trends.detector_backtest(spark, "/root/testdata/sf0.001")
    assert seeds == [200] and got.count() == 200


def test_planted_counts_read_ever_smaller_blocks(spark, monkeypatch):
    once = {tuple(r) for r in p.planted_counts(reviews(spark), "topic", "rid", SPIKES, 12, runs=4).collect()}
    monkeypatch.setattr(p, "BLOCK_ROWS", 1 / 100)  # as if groups were larger: three passes
    assert {tuple(r) for r in p.planted_counts(reviews(spark), "topic", "rid", SPIKES, 12, runs=4).collect()} == once


def stored_names(monkeypatch):
    names = []

    def seen(df, path=None, name="table"):
        names.append((name, "md5(" in df._jdf.queryExecution().optimizedPlan().toString()))
        return materialise(df, path, name)

    monkeypatch.setattr(p, "materialise", seen)
    return names


def test_rows_meet_the_seeds_once(spark, monkeypatch):
    names = stored_names(monkeypatch)
    rows = reviews(spark, n=4800)
    got = {tuple(r) for r in p.planted_counts(rows, "topic", "rid", SPIKES, 12, runs=5).collect()}
    assert [name for name, hashed in names if hashed] == ["near-cuts"]
    monkeypatch.setattr(p, "REACH", -8)  # no cut-off is where it should be: all are found from blocks
    names.clear()
    assert {tuple(r) for r in p.planted_counts(rows, "topic", "rid", SPIKES, 12, runs=5).collect()} == got
    assert len([name for name, hashed in names if hashed]) > 1


def test_rows_without_an_id_stay_and_count_as_the_first(spark):
    rows = reviews(spark).withColumn("rid", F.when(F.col("rid") % 8 != 0, F.col("rid")))  # g0: all rows of even weeks are without
    some = rows.where("rid IS NOT NULL OR week < 2")  # g0: 140 rows, 20 a week, those of week 0 without an id
    moved = {r.week: r["count"] for r in p.planted_counts(some, "topic", "rid", SPIKES[:1], 12, runs=1).where("topic = 'g0'").collect()}
    need = round(5 * 140 / 12) - 20
    assert moved[7] == 20 + need - 20 and moved[0] == 20 and sum(moved.values()) == 140


def test_rows_that_repeat_an_id_move_together(spark):
    rows = reviews(spark).withColumn("rid", F.lit(1))
    got = {(r.topic, r.week): r["count"] for r in p.planted_counts(rows, "topic", "rid", SPIKES[:1], 12, runs=1).collect()}
    assert got["g0", 7] == 240 and got["g1", 7] == 20


def test_scores_without_any_flag(spark):
    flags = spark.createDataFrame([("a", 5, 1.0, False)], "`group` string, week int, z double, flag_z boolean")
    row = a.detector_scores(flags, [("a", 5), ("b", 6)], "flag_z").first()
    assert (row.tp, row.fp, row.fn, row.n_flagged, row.precision, row.recall) == (0, 0, 2, 0, None, 0.0)
    assert row.precision_at_k == 0.5
