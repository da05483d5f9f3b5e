"""Shapes of physical plans that must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from grapevine.operators import joins as j
from grapevine.operators import positions as p
from grapevine.plans import trends as jobs
from grapevine.queries import QUERIES
from grapevine.queries.standins import order_reviews, reviews, table

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PRODUCTS = ["CartesianProduct", "BroadcastNestedLoopJoin"]


@pytest.mark.parametrize(
    "name",
    ["trends", "trend_alerts", "dense_grid", "verified_enrich", "category_lookup", "dev_test_split", "classification_report",
     "cluster_summary", "budget_gate", "batch_number", "plant_spikes_totals", "pick_playbook", "label_lookup", "pick_by_keyword",
     "trend_run_summary", "chart_groups", "human_acceptance", "judge_means"],
)
def test_no_product_of_tables(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not [word for word in PRODUCTS if word in text]


def test_detector_windows_share_one_sort(spark):
    text = plan(jobs.trends(order_reviews(spark, FOLDER), "issue_category", "review_date"))
    main = text.split("Subquery")[0] if text.startswith("Adaptive") else text
    assert text.count("+- Window [") == 1 and main


def test_trend_scan_reads_three_columns_and_pushes_filters(spark):
    negative = order_reviews(spark, FOLDER).where("sentiment = 'negative'")
    text = plan(jobs.trends(negative, "issue_category", "review_date"))
    assert "ReadSchema: struct<o_orderstatus:string,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text
    assert "IsNotNull(o_orderdate)" in text and "o_totalprice" not in text


def test_first_rows_are_cut_before_the_shuffle(spark):
    rows = reviews(spark, FOLDER)
    text = plan(p.first_n(rows, ["detected_language"], [F.col("ordinal")], 8))
    first_exchange = text.rindex("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text[first_exchange:]


def test_daily_counts_are_shuffled_once_for_all_uses(spark):
    df = jobs.trends(order_reviews(spark, FOLDER), "issue_category", "review_date")
    df.collect()
    text = plan(df)
    assert "ReusedExchange" in text or "ReusedSubquery" in text


def test_only_literal_tables_are_marked_for_broadcast(spark):
    text = j.category_lookup(
        table(spark, FOLDER, "documents").select(F.col("doc_id").cast("string").alias("id")),
        table(spark, FOLDER, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("x").alias("product_category")), "id",
    )._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in text.lower()


def test_texts_stay_where_they_lie_when_their_stored_vectors_are_read(spark, tmp_path):
    rows = spark.range(40).select("id", F.format_string("doc %d", "id").alias("doc"))
    rows.select(F.col("id").alias("doc_id"), F.col("doc").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables too large for it
    try:
        found = QUERIES["embedding_store_of_changed_texts"](spark, str(tmp_path))
        lines = plan(found).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    below = [lines[i + 1] for i, line in enumerate(lines[:-1]) if "Exchange hashpartitioning" in line]
    assert below and not [line for line in below if re.search(r"AS text#|(\[|, )text#\d+(,|\])", line)]
    assert {(r.spaces, r.versions) for r in found.collect()} == {(1, 1), (3, 2)}
