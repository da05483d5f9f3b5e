"""Queries: model stages with rule models, on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import ISSUE_CHARS
from ..operators.infer import call_ledger
from ..plans import stages as jobs
from ..plans.issues import cached_issue_phrases as cached
from ..storage import new_folder
from . import rules
from .ingest import _raw, strip_sql
from .registry import query
from .standins import CLUSTER_ROWS, REVIEWS, cluster_rows, estimate_sql, reviews, seeded_sql, table, topic_sql

_STRAY = "[" + ", ".join(f"'{t}'" for t in rules.STRAY) + "]"
N = "length(review_text)"
STARS = f"({N} % 12 / 2.0)::DOUBLE"
ANSWERED = f"{N} % 13 > 0"


def answered(value: str, condition: str = ANSWERED) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


CLASSIFIED = f"""{answered(estimate_sql(STARS))} AS sentiment, {answered(STARS)} AS stars_estimate,
  {answered(topic_sql(f"{_STRAY}[{N} % 8 + 1]"))} AS topic, {answered(f"({N} % 100 / 100.0)::DOUBLE")} AS confidence,
  {answered(f"['negative', 'neutral', 'positive'][{N} % 3 + 1]")} AS model_label"""


def _plain(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).select("review_id", "ordinal", "review_text", "detected_language")


@query(
    f"""WITH {REVIEWS} SELECT review_id, {CLASSIFIED}, CASE WHEN NOT ({ANSWERED}) THEN 'not classified' END AS error FROM reviews"""
)
def classify(spark, folder):
    rows, _ = jobs.classify(_plain(spark, folder), rules.caller(rules.classify))
    return rows.drop("ordinal", "review_text", "detected_language")


SHORT = f"least({N}, 700)"


@query(f"WITH {REVIEWS} SELECT review_id, CASE WHEN {SHORT} % 5 > 0 THEN 'issue ' || ({SHORT} % 7) END AS issue FROM reviews")
def issue_phrase(spark, folder):
    rows, _ = jobs.issue_phrases(_plain(spark, folder), rules.caller(rules.issue))
    return rows.select("review_id", "issue")


@query(
    f"""WITH {REVIEWS}, a AS (SELECT review_id, CASE WHEN {SHORT} % 11 > 0 THEN 'issue ' || ({SHORT} % 7) END AS issue,
  CASE WHEN {SHORT} % 11 > 0 THEN ({SHORT} % 14 - 1)::INTEGER END AS category FROM reviews)
SELECT review_id, issue, category, CASE WHEN category = -1 THEN 'none' ELSE label END AS cluster_label
FROM a LEFT JOIN (VALUES {", ".join(f"({k}, '{v}')" for k, v in jobs.ISSUE_CATEGORIES.items())}) v(id, label) ON id = category"""
)
def assign_issue(spark, folder):
    rows, _ = jobs.assign_issues(_plain(spark, folder), rules.caller(rules.assign), length=ISSUE_CHARS)
    return rows.select("review_id", "issue", "category", "cluster_label")


TRANSLATED = f"""CASE WHEN detected_language = 'en' THEN review_text ELSE {answered("'EN: ' || review_text")} END"""
T_STATUS = f"CASE WHEN detected_language = 'en' THEN 'not_needed' WHEN {ANSWERED} THEN 'ok' ELSE 'failed' END"


@query(
    f"""WITH {REVIEWS} SELECT review_id, md5({TRANSLATED}) AS translated_md5,
  CASE WHEN detected_language = 'en' THEN 'en' ELSE {answered(f"['de', 'es', 'fr'][{N} % 3 + 1]")} END AS translation_language,
  {T_STATUS} AS translation_status,
  CASE WHEN detected_language <> 'en' AND NOT ({ANSWERED}) THEN 'missing from response' END AS translation_error,
  CASE WHEN detected_language <> 'en' THEN 'translate_v1' END AS translation_prompt,
  CASE WHEN detected_language <> 'en' THEN 'rule-small' END AS translation_model FROM reviews"""
)
def translate(spark, folder):
    rows, _ = jobs.translate_all(_plain(spark, folder), rules.caller(rules.translate))
    return rows.select(
        "review_id", F.md5("translated_text").alias("translated_md5"), "translation_language", "translation_status",
        "translation_error", "translation_prompt", "translation_model",
    )


@query(
    f"""WITH {CLUSTER_ROWS} SELECT cluster, count(*) AS size, 'group of ' || count(*) AS label, {_STRAY}[count(*) % 8 + 1] AS topic
FROM cluster_rows GROUP BY cluster"""
)
def label_clusters(spark, folder):
    rows = cluster_rows(spark, folder).withColumn("review_text", F.concat(F.lit("text "), F.col("review_id").cast("string")))
    named, _ = jobs.label_clusters(rows, rules.caller(rules.name_clusters), "cluster")
    return named.drop("error")


@query(
    """WITH t AS (SELECT length(to_json(text)::VARCHAR) + length('rv-' || doc_id) + 19 AS tokens_in, length(text) % 13 > 0 AS ok,
    length(to_json('EN: ' || text)::VARCHAR) + length('rv-' || doc_id) AS said FROM documents WHERE lang <> 'en')
SELECT 'translate' AS purpose, 'translate_v1' AS prompt_version, 'rule-small' AS model, tokens_in, tokens_out, count(*) AS calls,
  round(sum(tokens_in + 5 * tokens_out) / 1e6, 6)::DOUBLE AS cost_usd
FROM (SELECT tokens_in::BIGINT AS tokens_in, (CASE WHEN ok THEN said + 73 ELSE 32 END)::BIGINT AS tokens_out FROM t) GROUP BY tokens_in, tokens_out"""
)
def call_ledger_of_stage(spark, folder):
    """Ledger of a translation run with one text per call: tokens and cost, which the rule model counts in characters."""
    who = rules.caller(rules.translate)
    others = _plain(spark, folder).where(F.col("detected_language") != "en")
    _, responses = jobs.translate(others, who, size=1)
    ledger = call_ledger(responses, who, "translate_v1")
    return ledger.groupBy("purpose", "prompt_version", "model", "tokens_in", "tokens_out").agg(
        F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("review_id"), F.col("text").alias("review_text"))


@query(
    """SELECT conv_id || '-' || turn AS review_id, 'deferred: spend cap reached' AS error, NULL::VARCHAR AS sentiment FROM conversations"""
)
def no_call_below_zero_budget(spark, folder):
    """With a cap of zero every request is deferred."""
    done, _ = jobs.classify(_turns(spark, folder), rules.caller(rules.classify, cap_usd=0.0, est_call_usd=0.01))
    return done.select("review_id", "error", "sentiment")


@query(
    """WITH c AS (SELECT count(*) AS n, ceil(count(*) / 2)::BIGINT AS cap FROM conversations)
SELECT unnest(['answered or failed', 'deferred']) AS state, unnest([least(n, cap), greatest(n - cap, 0)])::BIGINT AS n FROM c"""
)
def spend_cap_in_the_middle(spark, folder):
    """One call per turn, a budget for half of them: as many are sent as the budget pays, the others wait."""
    rows = _turns(spark, folder).withColumns(
        {"reply": F.lit("ok"), "sentiment": F.lit("neutral"), "topic": F.lit("other"), "customer_name": F.lit("Kim")}
    )
    half = -(-rows.count() // 2)
    done, _ = jobs.judge_replies(rows, rules.caller(rules.judge, cap_usd=half * 0.01, est_call_usd=0.01))
    waits = F.coalesce(F.col("error") == "deferred: spend cap reached", F.lit(False))
    return done.groupBy(F.when(waits, "deferred").otherwise("answered or failed").alias("state")).agg(F.count("*").alias("n"))


@query(
    f"""WITH s AS (SELECT * FROM documents
  QUALIFY row_number() OVER (PARTITION BY lang, (doc_id * 7 + n_chars) % 5 ORDER BY {seeded_sql("doc_id", 42)}) <= 25)
SELECT lang AS detected_language, CASE WHEN lang = 'en' THEN 'not_needed' WHEN length({strip_sql("text")}) % 13 > 0 THEN 'ok' ELSE 'failed' END AS state,
  count(*) AS n FROM s GROUP BY ALL"""
)
def ingest_translate(spark, folder):
    from ..plans.ingest import ingest_translate as job

    rows, _ = job(_raw(spark, folder), rules.caller(rules.translate), per_star=25)
    return rows.groupBy("detected_language", F.col("translation_status").alias("state")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {CLUSTER_ROWS}, t AS (SELECT cluster, topic, count(*) AS n FROM cluster_rows GROUP BY ALL),
d AS (SELECT cluster, topic, n FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, topic) = 1),
s AS (SELECT cluster, count(*) AS size FROM cluster_rows GROUP BY ALL)
SELECT cluster, size, topic AS dominant_topic, round_even(n / size, 2) AS topic_purity, 'group of ' || size AS label,
  {_STRAY}[size % 8 + 1] AS model_topic FROM s JOIN d USING (cluster)"""
)
def label_summary(spark, folder):
    from ..plans.issues import label_summary as job

    rows = cluster_rows(spark, folder).withColumn("review_text", F.concat(F.lit("text "), F.col("review_id").cast("string")))
    return job(rows, rules.caller(rules.name_clusters))


@query(f"WITH {REVIEWS} SELECT review_id, CASE WHEN {SHORT} % 5 > 0 THEN 'issue ' || ({SHORT} % 7) END AS issue FROM reviews")
def cached_issue_phrases(spark, folder):
    """Half of the reviews first, then all: the second run asks for what is not cached, with another model it would ask for all."""
    path, rows = new_folder(spark, "issue-cache"), _plain(spark, folder)
    who = rules.caller(rules.issue)
    cached(rows.where(F.col("ordinal") % 2 == 0), who, path, "issue_v1", seq=1)
    return cached(rows, who, path, "issue_v1", seq=2).select("review_id", "issue")
