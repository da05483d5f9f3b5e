"""Queries: splits, samples, folds, batches, budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as s
from ..operators import spend
from ..operators.joins import pending_rows
from .registry import query
from .standins import LEDGER, PREDICTIONS, PRICES, REVIEWS, ledger, predictions, reviews, seeded_sql, table

STRATA = ["detected_language", "rating"]


@query(
    f"""WITH {REVIEWS} SELECT review_id, CASE WHEN row_number() OVER (PARTITION BY detected_language, rating ORDER BY ordinal) <= 8
  THEN 'dev' ELSE 'test' END AS split FROM reviews"""
)
def dev_test_split(spark, folder):
    return s.dev_test_split(reviews(spark, folder), STRATA, "ordinal").select("review_id", "split")


@query(
    f"""WITH {REVIEWS} SELECT detected_language, rating, review_id FROM reviews
QUALIFY row_number() OVER (PARTITION BY detected_language, rating ORDER BY {seeded_sql("review_id", 42)}) <= 12"""
)
def stratified_sample(spark, folder):
    return s.stratified_sample(reviews(spark, folder), STRATA, "review_id", 12).select(*STRATA, "review_id")


@query(
    f"""WITH {REVIEWS} SELECT detected_language, rating, review_id FROM reviews
QUALIFY row_number() OVER (PARTITION BY detected_language, rating ORDER BY {seeded_sql("review_id", 0)})
  <= CASE WHEN rating <= 2 THEN 4 ELSE 2 END"""
)
def sample_per_group(spark, folder):
    quota = F.when(F.col("rating") <= 2, 4).otherwise(2)
    return s.sample_per_group(reviews(spark, folder), STRATA, "review_id", quota).select(*STRATA, "review_id")


@query(f"WITH {REVIEWS} SELECT review_id FROM reviews QUALIFY row_number() OVER (ORDER BY {seeded_sql('review_id', 1)}) <= 100")
def sample_n(spark, folder):
    return s.sample_n(reviews(spark, folder), "review_id", 100).select("review_id")


@query(f"WITH {REVIEWS} SELECT review_id FROM reviews WHERE rating = 3 AND stars_estimate > 4 ORDER BY ordinal LIMIT 6")
def first_examples(spark, folder):
    bad = (F.col("rating") == 3) & (F.col("stars_estimate") > 4)
    return s.first_examples(reviews(spark, folder), bad, "ordinal").select("review_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 3")
def top_groups(spark, folder):
    return s.top_groups(table(spark, folder, "documents"), "source", 3)


@query(
    f"""WITH {REVIEWS} SELECT review_id, rating,
  ((row_number() OVER (PARTITION BY rating ORDER BY {seeded_sql("review_id", 0)}) - 1) % 5)::INTEGER AS fold FROM reviews"""
)
def stratified_folds(spark, folder):
    return s.stratified_folds(reviews(spark, folder), "rating", "review_id").select("review_id", "rating", "fold")


@query(f"WITH {REVIEWS} SELECT review_id, ((row_number() OVER (ORDER BY ordinal) - 1) // 10)::BIGINT AS batch FROM reviews")
def batch_number(spark, folder):
    return s.batch_number(reviews(spark, folder), "ordinal", 10).select("review_id", "batch")


NAMES = {"en": ["Ann", "Bob", "Cy", "Di"], "de": ["Anna", "Lukas", "Sabine", "Jonas"], "es": ["Marta", "Diego", "Luz", "Pau"]}


@query(
    f"""WITH {REVIEWS}, p AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS i FROM reviews)
SELECT review_id, CASE detected_language WHEN 'en' THEN ['Ann', 'Bob', 'Cy', 'Di'][i % 4 + 1]
  WHEN 'de' THEN ['Anna', 'Lukas', 'Sabine', 'Jonas'][i % 4 + 1]
  WHEN 'es' THEN ['Marta', 'Diego', 'Luz', 'Pau'][i % 4 + 1] END AS customer_name FROM p"""
)
def assign_round_robin(spark, folder):
    rows = s.assign_round_robin(reviews(spark, folder), "ordinal", "detected_language", NAMES, "customer_name")
    return rows.select("review_id", "customer_name")


@query(f"WITH {LEDGER} SELECT ordinal, (micro / 1e6)::DOUBLE AS cost_usd FROM ledger")
def call_cost(spark, folder):
    calls = spend.with_call_cost(ledger(spark, folder), spend.price_table(spark, PRICES))
    return calls.select("ordinal", F.col("cost_usd").cast("double").alias("cost_usd"))


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS}, t AS (SELECT count(*) AS n FROM reviews WHERE review_id NOT IN (SELECT id FROM predictions))
SELECT n AS pending, ceil(n / 10)::BIGINT AS calls, round(n * 355 / 1e6::DOUBLE, 6) AS est_cost_usd,
  n * 355 / 1e6 > 0.5 AS needs_confirmation FROM t"""
)
def estimate_cost(spark, folder):
    known = predictions(spark, folder).select(F.col("id").alias("review_id"))
    return spend.estimate_cost(pending_rows(reviews(spark, folder), known, "review_id"))


@query(
    f"""WITH {LEDGER}, t AS (SELECT ordinal, coalesce(sum(micro) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ledger)
SELECT ordinal, CASE WHEN before + 10000 < 150000 THEN 'admit' ELSE 'deferred' END AS admission FROM t"""
)
def budget_gate(spark, folder):
    calls = spend.with_call_cost(ledger(spark, folder), spend.price_table(spark, PRICES))
    return s.budget_gate(calls, "ordinal", "cost_usd", cap_usd=0.15, spent=0.01).select("ordinal", "admission")
