import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from grapevine.operators import positions as p
from grapevine.operators import sampling as s
from grapevine.storage import new_folder


def test_positions_over_sparse_and_negative_ordinals(spark):
    values = sorted([-5_000_000_000, -3, -1, 0, 7, 65_536, 65_537, 10**12])
    rows = spark.createDataFrame([(v,) for v in reversed(values)], "o bigint")
    got = p.with_position(rows, F.col("o")).orderBy("o").collect()
    assert [(r.o, r.position) for r in got] == [(v, i) for i, v in enumerate(values)]


def test_positions_within_a_hot_and_a_null_group(spark):
    rows = spark.range(30_000).withColumn("g", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, "cold"))
    got = p.with_position(rows, F.xxhash64("id"), ["g"], shift=p.HASH_SHIFT)
    spans = {r.g: (r.n, r.low, r.high, r.d) for r in got.groupBy("g").agg(
        F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high"),
        F.count_distinct("position").alias("d"),
    ).collect()}
    assert spans == {"hot": (20_000, 0, 19_999, 20_000), "cold": (5_000, 0, 4_999, 5_000), None: (5_000, 0, 4_999, 5_000)}


def test_total_before_is_exact_across_blocks(spark):
    rows = spark.range(200_000).withColumn("c", F.lit("0.000001").cast("decimal(18,6)"))
    got = p.with_total_before(rows, F.col("id"), F.col("c")).where("id in (0, 1, 65536, 199999)").orderBy("id").collect()
    assert [r.total_before for r in got] == [None, Decimal("0.000001"), Decimal("0.065536"), Decimal("0.199999")]


def test_first_n_keeps_exactly_the_smallest(spark):
    rows = spark.range(10_000).withColumn("g", F.when(F.col("id") < 9_000, "hot").otherwise(F.lit(None)))
    got = p.first_n(rows, ["g"], [F.col("id").desc()], 3, [F.col("id")])
    assert {(r.g, r.id) for r in got.collect()} == {("hot", 8999), ("hot", 8998), ("hot", 8997), (None, 9999), (None, 9998), (None, 9997)}


def test_first_n_with_a_quota_column(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = p.first_n(rows, ["g"], [F.col("id")], F.col("g") + 1).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {0: 1, 1: 2, 2: 3}


@pytest.mark.parametrize("n", [1, 500, 5000])
def test_nth_value_cuts_off_exactly_n_rows(spark, n):
    rows = spark.range(10_000).withColumn("g", F.lit("all")).withColumn("n", F.lit(n))
    cuts = p.nth_value(rows, ["g"], F.xxhash64("id"), "n")
    assert rows.join(cuts, "g").where(F.xxhash64("id") <= F.col("cut")).count() == n


def test_split_marks_the_first_eight_in_file_order(spark):
    rows = spark.range(100).select(F.col("id").alias("ordinal"), (F.col("id") % 2).alias("lang"))
    got = s.dev_test_split(rows, ["lang"], "ordinal")
    assert {r.ordinal for r in got.where("split = 'dev'").collect()} == set(range(16))


def test_strict_sample_refuses_a_short_stratum(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, id bigint")
    assert s.stratified_sample(rows, ["g"], "id", 2).count() == 3
    with pytest.raises(ValueError, match="fewer than 2"):
        s.stratified_sample(rows, ["g"], "id", 2, strict=True)


def test_large_samples_keep_their_sizes(spark):
    rows = spark.range(30_000).withColumn("g", F.when(F.col("id") < 25_000, "hot"))
    got = s.stratified_sample(rows, ["g"], "id", 12_000).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"hot": 12_000, None: 5_000}
    quota = F.when(F.col("g") == "hot", 20_000).otherwise(7)
    got = s.sample_per_group(rows, ["g"], "id", quota).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"hot": 20_000, None: 7}
    assert s.sample_n(rows, "id", 15_000).count() == 15_000 and s.sample_n(rows, "id", 10**9).count() == 30_000


def test_samples_repeat_with_their_seed(spark):
    rows = spark.range(500)
    one = {r.id for r in s.sample_n(rows, "id", 20, 1).collect()}
    assert one == {r.id for r in s.sample_n(rows.repartition(7), "id", 20, 1).collect()}
    assert one != {r.id for r in s.sample_n(rows, "id", 20, 2).collect()}


def test_folds_differ_by_at_most_one_row(spark):
    rows = spark.range(103).withColumn("label", F.when(F.col("id") < 80, "x").otherwise("y"))
    sizes = s.stratified_folds(rows, "label", "id").groupBy("label", "fold").count().collect()
    for label in ("x", "y"):
        counts = [r["count"] for r in sizes if r.label == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_budget_gate_checks_before_the_call(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "o bigint").withColumn("c", F.lit("0.4").cast("decimal(18,6)"))
    got = s.budget_gate(rows, "o", "c", cap_usd=1.0).orderBy("o").collect()
    assert [r.admission for r in got] == ["admit", "admit", "admit", "deferred", "deferred"]
    at_cap = s.budget_gate(rows, "o", "c", cap_usd=0.8).orderBy("o").collect()
    assert [r.admission for r in at_cap] == ["admit", "admit", "deferred", "deferred", "deferred"]
    spent = s.budget_gate(rows, "o", "c", cap_usd=1.0, spent=1.0)
    assert spent.where("admission = 'admit'").count() == 0


def ranked(rows, strata, seed, quota):
    """Plainly: the first ids of each stratum in the order of their hashes."""
    found = {}
    for row in rows:
        found.setdefault(tuple(row[c] for c in strata), []).append(row.id)
    order = lambda i: (int(hashlib.md5(f"{i}|{seed}".encode()).hexdigest()[:15], 16), i)
    return {key: sorted(ids, key=order)[:quota(key)] for key, ids in found.items()}


def test_samples_by_cut_off_have_the_ranked_members(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.col("id") % 2).alias("h"), F.repeat(F.lit("x"), 50).alias("body"))
    everything = rows.collect()
    for n in (0, 1, 7, 300, 10_000):
        got = {}
        for row in s.stratified_sample(rows, ["g", "h"], "id", n, seed=3).collect():
            got.setdefault((row.g, row.h), []).append(row.id)
        expected = {k: v for k, v in ranked(everything, ["g", "h"], 3, lambda _, n=n: n).items() if v}
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    quota = F.when(F.col("g") == "hot", 9).when(F.col("h") == 1, 2)
    got = s.sample_per_group(rows, ["g"], "id", F.when(F.col("g") == "hot", 9).when(F.col("g") == "g1", 2), seed=1).collect()
    assert sorted(r.g for r in got) == ["g1"] * 2 + ["hot"] * 9
    assert s.sample_per_group(rows.where("h = 1"), ["g", "h"], "id", quota, seed=1).where("g = 'g1'").count() == 2
    assert sorted(r.id for r in s.sample_n(rows, "id", 100, seed=5).collect()) == sorted(ranked(everything, [], 5, lambda _: 100)[()])
    assert s.sample_n(rows, "id", 6000).count() == 5000 and s.sample_n(rows.limit(0), "id", 5).count() == 0


def test_samples_of_repeated_ids_keep_their_size(spark):
    rows = spark.range(900).select((F.col("id") % 3).alias("id"), F.lit("a").alias("g"))
    assert s.sample_n(rows, "id", 350).count() == 350
    assert s.stratified_sample(rows, ["g"], "id", 301).count() == 301


def test_samples_move_keys_only(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 4).alias("g"), F.repeat(F.lit("x"), 99).alias("body"))
    path = new_folder(spark, "sample-rows")
    rows.write.parquet(path)
    for sample in (s.stratified_sample(spark.read.parquet(path), ["g"], "id", 12), s.sample_n(spark.read.parquet(path), "id", 12)):
        text = sample._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in text and "Window" not in text
    cuts = p.cut_points(spark.read.parquet(path), ["g"], p.seeded_hash(F.col("id"), 1), F.lit(12))
    assert "body" not in cuts._jdf.queryExecution().executedPlan().toString()


def test_the_rows_of_a_split_are_marked_where_they_lie(spark):
    rows = spark.createDataFrame([(i, "en", "text") for i in range(30)], "id bigint, lang string, text string")
    plan = s.dev_test_split(rows, ["lang"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
